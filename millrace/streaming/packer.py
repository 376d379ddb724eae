"""Streaming: documents packed into fixed-length rows with a pending tail that survives restarts, and a step log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "source_id string, row long, tokens array<int>"
STATE = "pending array<int>, next_row long"


def pack(stream: DataFrame, length: int) -> DataFrame:
    """(source_id, row, tokens): full rows of each source's tokens, in the order of doc_seq within a micro-batch.

    stream has source_id, doc_seq, tokens. What doesn't fill a row waits in the state store, so a query that is restarted from
    its checkpoint goes on with the same tail. The tail of a source is always shorter than a row.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, row = state.get if state.exists else ([], 0)
        arrived = pd.concat(list(batches), ignore_index=True).sort_values("doc_seq", kind="stable")
        ids = [int(t) for t in pending] + [int(t) for tokens in arrived["tokens"] for t in tokens]
        full = len(ids) // length
        state.update((ids[full * length :], row + full))
        if full:
            yield pd.DataFrame({"source_id": [key[0]] * full, "row": range(row, row + full), "tokens": [ids[k * length : (k + 1) * length] for k in range(full)]})

    return stream.groupBy("source_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def log_steps(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to a JSON-lines log, in a folder of its own: a repeated batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").json(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
