"""Connected components of a link table by alternating stars, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Room


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node's smallest neighbour (or itself) takes its larger (large) or its smaller neighbours."""
    both = edges.union(edges.select("b", "a"))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        down = both.where("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("m").alias("a"), F.explode(F.array("b", "a")).alias("b"))
    return out.where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", room: Room | None = None) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node that links reach.

    Each round is written to the shared folder; rounds end when the edges no longer change, by their number, the exact sum and
    the exclusive or of their 64-bit hashes. Repeated and self links are fine.
    """
    room = room or Room(links.sparkSession)
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()
    edges, before = room.stored(edges, "edges"), None
    hashed = F.xxhash64("a", "b")
    while True:
        state = edges.agg(F.count("*"), F.sum(hashed.cast("decimal(20,0)")), F.bit_xor(hashed)).first()
        if state == before or not state[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
        before, last = state, edges
        edges = room.stored(_star(_star(edges, True), False), "edges")
        room.drop(last)
