"""Every query of the engine by name, and its SQL where it has any (oracles.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import maths, options
from millrace.functions import text as T
from millrace.functions.tables import spread
from millrace.operators import contamination as C
from millrace.operators import contracts, interleave, matching, metrics, orders, packing, segments, tensors
from millrace.plans import oracles
from millrace.plans.settings import BENCHMARK, CHUNK, CHUNKS, COVERAGE_STEPS, LENGTH, MTP_WEIGHTS, RECENT, SEED, STEP, VALID
from millrace.sources import benchmarks, indexes, interleaved, manifests, text_files, windows
from millrace.sources import shards as token_shards
from millrace.sources.folders import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL = oracles.SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places: sums of floats depend on the order in which partitions come."""
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


# Text


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_nfkc(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def norm_chars(spark, sf_dir):
    return normal(spark, sf_dir).select("doc_id", T.chars_of(F.col("nfkc")).alias("chars"))


@query
def norm_words(spark, sf_dir):
    return normal(spark, sf_dir).select("doc_id", F.array_join(T.words_of(F.col("nfkc")), " ").alias("words"))


@query
def is_cjk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_cjk(F.col("text")).alias("is_cjk"))


@query
def line_documents(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("line", "text"))
    return lines.where(~T.is_blank(F.col("text"))).select("doc_id", F.col("line").cast("long").alias("line"), "text")


@query
def file_lines(spark, sf_dir):
    """Lines of documents, written to text files one after the other and read back with their numbers."""
    path = shared_folder(spark)
    every = F.posexplode(T.lines_of(F.translate("text", "\r", "")))
    written = table(spark, sf_dir, "documents").select("doc_id", every.alias("i", "line"))
    written.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), "line")).write.text(path)
    read = text_files.lines(spark, path).withColumn("doc_id", F.substring_index("value", "\t", 1).cast("long"))
    first = F.min("line").over(Window.partitionBy("path", "doc_id"))
    return read.select("doc_id", (F.col("line") - first).alias("line"), F.expr("substr(value, instr(value, '\t') + 1)").alias("text"))


@query
def record_keys(spark, sf_dir):
    return records(spark, sf_dir).select("record_id", "key", F.char_length("key").cast("long").alias("key_chars"))


@query
def text_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.records(table(spark, sf_dir, "benchmark"), BENCHMARK)


def grams_query(script: str):
    def run(spark, sf_dir):
        g = C.grams.exploded(records(spark, sf_dir), "record_id", scripts=(script,))
        return g.select("record_id", "pos", "gram")

    return run


QUERIES["char_ngrams"], QUERIES["word_ngrams"] = grams_query("cjk"), grams_query("latin")


@query
def index_stats(spark, sf_dir):
    return rounded(C.index_stats(records(spark, sf_dir)))


# Contamination


@query
def contamination_span(spark, sf_dir):
    return C.check_documents(table(spark, sf_dir, "documents"), records(spark, sf_dir), None)


@query
def contamination_screen(spark, sf_dir):
    return C.check_documents(table(spark, sf_dir, "documents"), records(spark, sf_dir)).select("doc_id", "distinct", "span", "script")


@query
def contamination_word_span(spark, sf_dir):
    """Words only."""
    index = C.index_grams(records(spark, sf_dir)).where("script = 'latin'")
    return C.spans(C.grams.hits(table(spark, sf_dir, "documents"), index), None).select("doc_id", "distinct", "span")


@query
def exact_record(spark, sf_dir):
    """Documents with a line that is, as a whole, a line of a benchmark record."""
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.lines_of(F.col("text"))).alias("text"))
    recs = C.records(lines, BENCHMARK)
    keys = recs.where(F.char_length("key") >= T.MIN_SHORT_KEY).select("key").distinct()
    return C.exact_records(table(spark, sf_dir, "documents"), keys)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.analyse(table(spark, sf_dir, "documents"), records(spark, sf_dir), matching.rules(spark))


@query
def record_coverage(spark, sf_dir):
    return rounded(findings(spark, sf_dir).select("doc_id", "record_id", "record_ngrams", "matched", "coverage", "contaminated"))


@query
def record_longest_run(spark, sf_dir):
    pairs = matching.runs(table(spark, sf_dir, "documents"), records(spark, sf_dir), matching.rules(spark))
    return rounded(pairs.select("doc_id", "record_id", "contiguous_ngrams", "contiguous_units", "contiguous_fraction", "matched_text"))


@query
def record_substring(spark, sf_dir):
    return findings(spark, sf_dir).where("substring").select("doc_id", "record_id", "record_chars")


@query
def short_record_substring(spark, sf_dir):
    """Records too short for a gram, here every four words of the benchmark, inside documents."""
    words = F.col("w")
    every = F.transform(F.sequence(F.lit(0), F.expr("size(w) div 4").cast("int")), lambda i: F.struct((F.col("item_id") * 10_000 + i).alias("item_id"), F.array_join(F.slice(words, i * 4 + 1, 4), " ").alias("text")))
    b = table(spark, sf_dir, "benchmark").select("item_id", T.words_of(F.col("text")).alias("w"))
    recs = C.records(b.select(F.explode(every).alias("x")).select("x.*"), BENCHMARK)
    keys = matching.short_keys(matching.record_facts(recs).join(matching.rules(spark), "benchmark"))
    docs = T.with_nfkc(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return matching.short_records(docs, keys).select("doc_id", "record_id", "record_chars")


@query
def best_finding(spark, sf_dir):
    return rounded(matching.best(findings(spark, sf_dir)).select("doc_id", "record_id", "benchmark", "coverage", "contiguous_units"))


@query
def part_selection(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    named = b.select(F.element_at(F.array(*map(F.lit, ("gsm8k", "humaneval", "mbpp", "jnli"))), (F.col("item_id") % 4 + 1).cast("int")).alias("benchmark"), "text", F.substring_index("text", ".", 1).alias("first"), F.element_at(F.split("text", r"\."), -1).alias("second"))
    return matching.parts(named).groupBy("benchmark").agg(F.count("*").alias("records"), F.sum(F.char_length("text")).alias("chars"))


def examples(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables like the benchmarks' files, each field a few words of a record."""
    words = table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("w"))

    def cut(i: int) -> Column:
        return F.array_join(F.slice("w", 4 * i + 1, 4), " ")

    def fields(*names: str) -> DataFrame:
        return words.select(*(cut(i).alias(n) for i, n in enumerate(names)))

    def tagged(tag: str, i: int) -> Column:
        return F.concat(F.lit(f"<{tag}> "), F.regexp_replace(cut(i), "[^A-Za-z ]", ""), F.lit(f" </{tag}>"))

    def answer(i: int) -> Column:
        return F.struct(cut(i).alias("text"))

    asked = F.struct(cut(1).alias("question"), F.array(answer(2), answer(3)).alias("answers"))
    article = F.array(F.struct(F.array(F.struct(cut(0).alias("context"), F.array(asked).alias("qas"))).alias("paragraphs")))
    return {
        "jcommonsenseqa": fields("question", *(f"choice{i}" for i in range(5))), "jnli": fields("sentence1", "sentence2"), "jmmlu": fields("question", "A", "B", "C", "D"),
        "jsquad": words.select(article.alias("data")), "niilc": words.select(F.concat(F.lit("<question>"), tagged("text", 0), F.lit("<answers>"), tagged("answer", 1), tagged("answer", 2), F.lit("</answers></question>")).alias("xml")),
        "gsm8k": fields("question", "answer"), "humaneval": fields("prompt", "canonical_solution"), "mbpp": fields("text", "code"),
    }


@query
def canonical_records(spark, sf_dir):
    return benchmarks.canonical(examples(spark, sf_dir)).select("benchmark", "text")


@query
def canonical_parts(spark, sf_dir):
    return matching.parts(benchmarks.canonical(examples(spark, sf_dir)))


@query
def record_lines(spark, sf_dir):
    text = F.translate("text", ".,", "\x0b\u2028")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(benchmarks.split_lines(text)).alias("line", "text"))
    return lines.where(~T.is_blank(F.col("text"))).select("doc_id", F.col("line").cast("long").alias("line"), "text")


@query
def rule_decisions(spark, sf_dir):
    """All rules at once: each record belongs to one of the benchmarks."""
    name = F.element_at(F.array(*map(F.lit, matching.RULES)), (F.col("item_id") % len(matching.RULES) + 1).cast("int"))
    recs = C.records(table(spark, sf_dir, "benchmark").withColumn("benchmark", name))
    return matching.analyse(table(spark, sf_dir, "documents"), recs, matching.rules(spark)).select("doc_id", "record_id", "benchmark", "substring", "contaminated")


@query
def stored_gram_index(spark, sf_dir):
    """Verdicts by an index that was written and read again."""
    path = shared_folder(spark)
    indexes.save_grams(records(spark, sf_dir), path)
    grams, keys, _ = indexes.load_grams(spark, path)
    return C.check_against(table(spark, sf_dir, "documents"), grams.where("script = 'latin'"), keys, None).select("doc_id", "distinct", "span")


@query
def stored_record_index(spark, sf_dir):
    """Facts of records that were written and read again."""
    path = shared_folder(spark)
    indexes.save_records(records(spark, sf_dir), path)
    return matching.record_facts(indexes.load_records(spark, path)).select("record_id", "record_chars", "record_ngrams")


# Packing


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.tokenised(spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text")), "source", "doc_id", "text")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.hashed_lengths(spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text")), "source", "doc_id", "text")


@query
def pack_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select("source_id", "doc_seq", F.array_join("tokens", " ").alias("tokens"))


@query
def pack_offsets(spark, sf_dir):
    return packing.offsets(lengths(spark, sf_dir))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_seq") % 10 == 0, "validation").otherwise("train")
    return packing.shard_totals(lengths(spark, sf_dir), split)


@query
def shard_totals(spark, sf_dir):
    return shards(spark, sf_dir)


@query
def split_totals(spark, sf_dir):
    return packing.split_totals(shards(spark, sf_dir))


@query
def source_weights(spark, sf_dir):
    return rounded(packing.source_weights(shards(spark, sf_dir).where("split = 'train'")), 9)


@query
def source_upsert(spark, sf_dir):
    s = shards(spark, sf_dir)
    new = s.where("split = 'train'").where("documents % 2 = 0").withColumn("tokens", F.col("tokens") + 1)
    return packing.upserted(s, new, ["path"]).select("split", "source_id", "tokens", "documents", "path")


@query
def manifest_violations(spark, sf_dir):
    s = packing.source_weights(shards(spark, sf_dir))
    bad = s.select("source_id", F.when(F.col("tokens") % 3 == 0, 0.0).otherwise(F.col("weight")).alias("weight"), F.when(F.col("tokens") % 5 != 0, F.col("major")).alias("major"), "tokens")
    return packing.violations(bad)


@query
def legacy_source(spark, sf_dir):
    return shards(spark, sf_dir).select("path", T.legacy_source_id(F.col("path"), "train").alias("source_id"))


def manifest(spark: SparkSession, sf_dir: str, interleaved: bool = False) -> DataFrame:
    """The packed corpus's manifest as one row, by way of its JSON. A row per shard is gathered, none per document."""
    s = shards(spark, sf_dir)
    entry = F.struct("path", F.regexp_replace("path", r"\.bin$", ".idx").alias("index"), "tokens", "documents", "source_id")
    splits = s.groupBy("split").agg(F.struct(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"), F.array_sort(F.collect_list(entry)).alias("shards")).alias("v"))
    declared = s.where("split = 'validation' and documents % 2 = 0").agg(F.map_from_entries(F.collect_list(F.struct("source_id", F.col("documents").cast("double")))).alias("validation_source_weights"))
    row = splits.agg(F.map_from_entries(F.collect_list(F.struct("split", "v"))).alias("splits")).join(declared, F.lit(True))  # one row each
    if interleaved:
        sources = packing.manifest_rows(s, packing.source_weights(s))
        row = row.join(sources.agg(F.struct(F.array_sort(F.collect_list(F.struct("source_id", "weight", "major", "shards"))).alias("sources")).alias("interleave")), F.lit(True))
    return manifests.read(row.withColumn("format", F.lit(manifests.FORMAT)).select(F.to_json(F.struct("*")).alias("value")))


@query
def manifest_legacy(spark, sf_dir):
    return rounded(manifests.adapted(manifest(spark, sf_dir)).drop("place"), 9)


@query
def manifest_canonical(spark, sf_dir):
    return rounded(manifests.adapted(manifest(spark, sf_dir, True)).drop("place"), 9)


@query
def manifest_validation(spark, sf_dir):
    return manifests.validation_sources(manifest(spark, sf_dir))


# Interleaving


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHUNKS draws or, where these leave tokens of a source out, as many as every source takes to pass one epoch."""
    weights = packing.source_weights(shards(spark, sf_dir)).select("source_id", "tokens", F.round("weight", 9).alias("weight"))
    sources = weights.orderBy("source_id").collect()  # a row per source
    n = interleave.draws_for_all([r.tokens for r in sources], [r.weight for r in sources], SEED, CHUNK, CHUNKS)
    return interleave.schedule(spark, spark.createDataFrame(sources, weights.schema), SEED, n)


def stream(spark: SparkSession, sf_dir: str, p: DataFrame) -> DataFrame:
    return interleave.streams(lengths(spark, sf_dir), p, CHUNK, interleave.portable_order(SEED))


@query
def interleave_schedule(spark, sf_dir):
    return plan(spark, sf_dir)


@query
def chunk_assembly(spark, sf_dir):
    p = plan(spark, sf_dir)
    return interleave.pieces(stream(spark, sf_dir, p), p, CHUNK)


@query
def first_locations(spark, sf_dir):
    p = plan(spark, sf_dir)
    return interleave.first_locations(interleave.pieces(stream(spark, sf_dir, p), p, CHUNK))


@query
def source_accounting(spark, sf_dir):
    p = plan(spark, sf_dir)
    return interleave.accounting(stream(spark, sf_dir, p), p, CHUNK)


@query
def step_composition(spark, sf_dir):
    return interleave.composition(plan(spark, sf_dir), CHUNK, STEP)


@query
def major_coverage(spark, sf_dir):
    s = packing.source_weights(shards(spark, sf_dir))
    return interleave.missing_majors(interleave.composition(plan(spark, sf_dir), CHUNK, STEP), s, COVERAGE_STEPS)


@query
def sequence_pieces(spark, sf_dir):
    p = plan(spark, sf_dir)
    return interleave.sequences(interleave.pieces(stream(spark, sf_dir, p), p, CHUNK), CHUNK, 1024).select("seq_id", "seq_offset", "source_id", "epoch", "doc_seq", "doc_offset", "n_tokens")


@query
def shard_order_pieces(spark, sf_dir):
    """Chunks over shards and documents that are each permuted anew in every epoch."""
    p = plan(spark, sf_dir)
    stream = orders.streams(orders.in_shards(lengths(spark, sf_dir)), p, CHUNK, SEED)
    return interleave.pieces(stream, p, CHUNK, ("shard", "place"))


@query
def resumable_stream(spark, sf_dir):
    """The chunks that the streaming source reads from the packed corpus, as many as hold all its tokens, with a digest of each."""
    data, out = shared_folder(spark), shared_folder(spark)
    token_shards.write_shards(tokens(spark, sf_dir), data)
    total = sum(s.tokens for s in interleaved.sources_of(data))
    read = interleaved.stream(spark, data, SEED, CHUNK, -(-total // CHUNK)).withColumn("sha256", F.sha2(F.concat_ws(",", "tokens"), 256))
    interleaved.to_the_end(read.drop("tokens"), f"{out}/chunks", f"{out}/checkpoint", -(-total // CHUNK))
    return spark.read.parquet(f"{out}/chunks")


# Segments


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.row_arrays(packing.offsets(tokens(spark, sf_dir)), LENGTH)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def ignored(targets: Column) -> Column:
    return F.size(F.filter(targets, lambda t: t == segments.IGNORED)).cast("long")


def exploded(df: DataFrame, values: Column, name: str) -> DataFrame:
    return df.select("source_id", "row", F.posexplode(values).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


@query
def packed_rows(spark, sf_dir):
    return exploded(rows(spark, sf_dir), F.col("tokens"), "token")


@query
def segment_ids(spark, sf_dir):
    return exploded(rows(spark, sf_dir), segments.segments_of(F.col("tokens")), "segment")


@query
def masked_targets(spark, sf_dir):
    t = rows(spark, sf_dir).select("source_id", "row", segments.targets_of(F.col("tokens")).alias("t"))
    return t.select("source_id", "row", total(F.col("t")).alias("targets"), ignored(F.col("t")).alias("ignored"), F.size("t").cast("long").alias("positions"))


@query
def mtp_triples(spark, sf_dir):
    t = rows(spark, sf_dir).select("source_id", "row", segments.triples_of(F.col("tokens")).alias("t"))
    products = F.transform("t", lambda x: x["token"].cast("long") * x["next"])
    return t.select("source_id", "row", total(F.col("t.target")).alias("targets"), total(products).alias("products"), ignored(F.col("t.target")).alias("ignored"))


@query
def cu_seqlens(spark, sf_dir):
    r = rows(spark, sf_dir)
    starts = r.select("source_id", "row", F.explode(segments.starts_of(F.col("tokens"))).alias("start"))
    ends = r.groupBy("source_id").agg(((F.max("row") + 1) * LENGTH).alias("offset"))
    return starts.select("source_id", (F.col("row") * LENGTH + F.col("start")).alias("offset")).union(ends)


@query
def document_mask(spark, sf_dir):
    return rows(spark, sf_dir).select("source_id", "row", segments.mask_of(F.col("tokens")).alias("m")).select("source_id", "row", "m.pairs", F.col("m.keys_sum").alias("keys"))


@query
def lagged_sum(spark, sf_dir):
    values = F.transform("tokens", lambda t: t.cast("double"))
    lagged = rows(spark, sf_dir).withColumn("values", values).select("source_id", "row", segments.lagged_of(F.col("values"), F.col("tokens"), MTP_WEIGHTS).alias("lagged"))
    return rounded(lagged.select("source_id", "row", F.aggregate("lagged", F.lit(0.0), lambda a, v: a + v).alias("lagged")), 3)


@query
def segment_boundaries(spark, sf_dir):
    return rows(spark, sf_dir).select("source_id", "row", (F.size(segments.starts_of(F.col("tokens"))) - 1).cast("long").alias("boundaries"))


# Metrics


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query
def tensor_stats(spark, sf_dir):
    return rounded(metrics.tensor_stats(values(spark, sf_dir), ["label"], "v"))


@query
def buffer_stats(spark, sf_dir):
    """tensor_stats over whole arrays, without a row for each value."""
    e = table(spark, sf_dir, "embeddings").select("label", "embedding")
    q = tensors.buffer_quantiles(e, ["label"], "embedding").withColumnRenamed("label", "__label")
    m = tensors.moments(e, ["label"], "embedding")
    return rounded(m.join(q, m["label"].eqNullSafe(q["__label"])).drop("__label"))


@query
def gate_stats(spark, sf_dir):
    return rounded(metrics.gate_stats(values(spark, sf_dir).withColumn("v", 1 / (1 + F.exp(-F.col("v") * 4))), ["label"], "v"))


@query
def optimizer_summary(spark, sf_dir):
    v = values(spark, sf_dir).select(F.when(F.col("i") < 32, "momentum").otherwise("variance").alias("name"), F.col("vec_id").alias("tensor_id"), F.col("v").alias("value"))
    return rounded(metrics.optimizer_summary(v))


@query
def head_variation(spark, sf_dir):
    heads = values(spark, sf_dir).groupBy("label", "vec_id").agg(maths.rms(F.col("v")).alias("r"))
    return rounded(heads.groupBy("label").agg(maths.variation(F.col("r")).alias("variation")))


@query
def route_stats(spark, sf_dir):
    v = values(spark, sf_dir).withColumn("w", F.exp("v"))
    total = F.sum("w").over(Window.partitionBy("vec_id"))
    return rounded(metrics.route_stats(v.withColumn("p", F.col("w") / total), ["vec_id"], "p", "v", "w"))


@query
def vector_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = e.join(o, "vec_id")
    return rounded(j.select("vec_id", maths.cosine(F.col("embedding"), F.col("other")).alias("cosine"), maths.relative_error(F.get("embedding", F.lit(0)).cast("double"), F.get("other", F.lit(0)).cast("double")).alias("relative_error")), 5)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    loss = F.abs(F.col("value")) / 100
    return metrics.source_metrics(e.select("event_type", loss.alias("loss"), (F.col("event_id") % 3 == 0).alias("correct"), (F.col("value") / 7).alias("margin")), "event_type", "loss", "correct", "margin")


@query
def source_metrics(spark, sf_dir):
    return rounded(measured(spark, sf_dir))


@query
def weighted_validation(spark, sf_dir):
    weights = table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct().where("length(source) % 2 = 0").withColumn("weight", F.length("source").cast("double"))
    return rounded(metrics.weighted(measured(spark, sf_dir), weights))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    windows = e.groupBy(F.floor(F.col("event_id") / 500).alias("shard"), (F.floor(F.col("event_id") / 10) % 50).alias("window")).agg(F.sum(F.abs("value")).alias("loss_sum"), F.count("*").alias("valid"), F.max("event_id").alias("e"))
    return windows.withColumn("source", F.concat(F.lit("s"), F.col("shard") % 4))


@query
def validation_nll(spark, sf_dir):
    return rounded(metrics.validation_nll(losses(spark, sf_dir), VALID), 5)


@query
def validation_by_source(spark, sf_dir):
    return rounded(metrics.source_nll(losses(spark, sf_dir), VALID), 5)


@query
def validation_windows(spark, sf_dir):
    """What a validation of the packed corpus reads within its budget: windows and valid targets of each source."""
    data = shared_folder(spark)
    token_shards.write_shards(tokens(spark, sf_dir), data, "validation")
    read = windows.read_windows(spark, data, LENGTH, VALID)
    return read.groupBy("source").agg(F.count("*").alias("windows"), F.sum("valid").alias("valid"), F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + t)).alias("ids"))


@query
def steady_throughput(spark, sf_dir):
    return rounded(metrics.steady_throughput(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", "value", 95.0))


@query
def recent_records(spark, sf_dir):
    return contracts.recent(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], RECENT).select("user_id", "event_id")


@query
def lr_schedule(spark, sf_dir):
    """The rate at the step of each order, four orders to a step."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey div 4").alias("step"))
    return rounded(o.select("o_orderkey", "step", maths.learning_rate(F.col("step"), 200, 3000, 3e-4, 3e-5).alias("lr")), 10)


@query
def parameter_report(spark, sf_dir):
    """Sizes by the first word of a name, and of all: parts stand for parameters."""
    parts = table(spark, sf_dir, "part").select(F.concat_ws(".", "p_type", "p_brand").alias("name"), F.col("p_size").cast("long").alias("size"))
    return metrics.totals_by_prefix(parts, "name", "size", ["ECONOMY.", "LARGE.", "MEDIUM.", "PROMO.", "SMALL.", "STANDARD."])


@query
def target_steps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", maths.target_step(F.col("o_orderkey") * 1_000_003 + 1, F.lit(65_536)).alias("steps"))


@query
def activations(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    v = F.col("value") / 50
    return rounded(e.select("event_id", maths.gate(v).alias("gate"), maths.softcap(v).alias("softcap"), maths.perplexity(v).alias("perplexity")), 5)


# Contracts


@query
def compare_screen(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    arm = o.select(F.floor(F.col("o_orderkey") / 8).alias("pair"), (F.col("o_orderkey") % 2).alias("side"), "o_orderkey", "o_totalprice")
    arm = arm.groupBy("pair", "side").agg(F.max("o_orderkey").alias("k"), F.round(F.max("o_totalprice") / 1000, 0).alias("weighted_nll"))
    status = F.when(F.col("k") % 11 == 0, "failed").when(F.col("k") % 17 != 0, "complete")
    scope = F.when(F.col("k") % 13 == 0, "diagnostic").otherwise("full")
    arm = arm.select("pair", "side", status.alias("status"), scope.alias("scope"), (F.floor(F.col("pair") / 4) * 200_000 + 60_000_000).alias("tokens_done"), "weighted_nll").withColumn("validation_tokens_done", F.col("tokens_done"))
    return contracts.screen(arm.where("side = 0"), arm.where("side = 1"), ["pair"], ("normal", "routed"))


@query
def contract_mismatch(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    left = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("v"))
    right = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit("X")).when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("v"))
    return contracts.mismatches(left, right, ["o_orderkey"], "v")


@query
def retain_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    names = o.select("o_custkey", F.concat(F.lit("step_"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 8, "0")).alias("name")).distinct()
    return contracts.retained(names, "o_custkey", "name")


@query
def latest_validation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    names = o.select("o_custkey", F.concat(F.lit("validation_final_step"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.when(F.col("o_orderkey") % 2 == 0, "_diagnostic.json").otherwise(".json")).alias("name"))
    return contracts.latest(names, "o_custkey", "name")


@query
def missing_weights(spark, sf_dir):
    s = shards(spark, sf_dir)
    return contracts.missing(s, s.where("split = 'validation' and documents % 2 = 1"), "source_id")


@query
def controlled_stop(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    steps = e.select("user_id", "event_id", F.when(F.col("value") > 250, float("nan")).otherwise(F.col("value")).alias("loss"), (F.col("event_id") % 7 + 1).alias("tokens"))
    return contracts.controlled_stops(steps, "user_id", "event_id", "loss", "tokens", RECENT).withColumn("recent_successful_steps", F.array_join("recent_successful_steps", ","))


@query
def source_maps(spark, sf_dir):
    """Chunks and tokens of each step by source, as maps in the order of the sources."""
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("chunks"), (F.count("*") * CHUNK).alias("tokens"))
    maps = per.groupBy("user_id").agg(options.sorted_map("event_type", "chunks").alias("chunks"), options.sorted_map("event_type", "tokens").alias("tokens"))
    return maps.select("user_id", *(F.to_json(c).alias(c) for c in ("chunks", "tokens")))


@query
def run_options(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    words = F.concat(F.array(F.lit("train"), F.lit("--seed"), key), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.concat(F.lit("--lr="), key), F.lit("x"))).otherwise(F.array(F.lit("--lrs"), F.lit("y"))), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("--lr"), F.lit("2"), F.lit("z"))).otherwise(F.array().cast("array<string>")))
    return o.select("o_orderkey", options.option_value(words, "--lr", "none").alias("lr"), options.option_value(words, "--seed").alias("seed"), F.array_join(options.replace_option(words, "--lr", "0.5"), " ").alias("words"))
