"""Secret scans through an incremental blob ledger, with DataFrame functions only.

A blob is a text under its SHA-256. The ledger holds a row for each pair of a blob and a rule version that was ever scanned, with
its spans. A scan hashes all versions of all paths, takes the distinct blobs, drops the pairs in the ledger, scans the rest,
and joins findings back to every path and version. Content that is repeated, moved, or seen in an earlier run isn't scanned again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, scratch, stored

#: Fixed values of the contract: kind -> (pattern as the scan uses it, least characters of its last group).
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run matches whole or not at all, so these two carry their least length themselves.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the operator adds to the base kinds: private key headers and signed web tokens.
KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
KINDS = ("assign", "access", "hex", "key", "jwt")
BASE = KINDS[:3]
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, KEY, JWT), strict=True))
#: How Spark looks for web tokens: from the start of a run, its first "eyJ" alone. If that doesn't lead to a token, no later one of
#: the run does, so no run is read twice. The hit has what stands before the "eyJ" too.
JWT_SCAN = r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
#: Follows from the patterns; the ledger keeps results of each version apart.
VERSION = hashlib.sha256("\n".join(f"{k} {p}" for k, p in PATTERNS.items()).encode()).hexdigest()[:16]
#: Matches whose lengths are summed up together.
BLOCK = 128
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Texts without any of these hold no span: a first test in one pass.
HINT = r"""(?i)passw|secret|token|api_?key|akia[a-z0-9]|[0-9a-f]{32}|-----BEGIN |eyJ"""


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once; inside a lambda it would else be worked out for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, fold: Callable[[Column], Column], both: Callable[[Column, Column], Column], use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(before), where before(i) is the fold of the first i values (integers, 0 for none).

    Folds over blocks of BLOCK and over the blocks before each are made once, so before(i) looks at one block at most.
    """
    cut = lambda v, b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
    count = lambda v: F.greatest(F.lit(0), F.ceil(F.size(v) / BLOCK) - 1).cast("int")
    blocks = lambda v: F.transform(F.sequence(F.lit(0), count(v)), lambda b: fold(cut(v, b)))
    bases = lambda v, s: F.transform(F.sequence(F.lit(0), count(v)), lambda b: fold(F.slice(s, F.lit(1), b)))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    before = lambda v, base: lambda i: both(F.get(base, block(i)), fold(F.slice(v, block(i) * BLOCK + 1, i % BLOCK)))
    return bound(values, lambda v: bound(blocks(v), lambda s: bound(bases(v, s), lambda base: use(before(v, base)))))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0), lambda a, x: a + x)


def _most(v: Column) -> Column:
    return F.coalesce(F.array_max(v), F.lit(0))


def spans_of(text: Column, kind: str) -> Column:
    """Spans (start, kind, end) of one kind: leftmost, non-overlapping, in code points, end exclusive.

    The texts between matches and the matches alternate, so a match starts at the sum of the lengths before it.
    """
    pattern = JWT_SCAN if kind == "jwt" else PATTERNS[kind]
    skip = (lambda hit: F.locate("eyJ", hit) - 1) if kind == "jwt" else (lambda hit: F.lit(0))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "assign" else found
    zipped = F.filter(F.arrays_zip(between.alias("gap"), found.alias("hit"), value.alias("value")), lambda z: z["hit"].isNotNull())
    sizes = F.transform(zipped, lambda z: F.struct(F.char_length(z["gap"]).alias("gap"), F.char_length(z["hit"]).alias("hit"), F.char_length(z["value"]).alias("value"), skip(z["hit"]).alias("skip")))

    def placed(z: Column) -> Column:
        at = lambda before, s, i: F.struct((before(i) + s["gap"] + s["skip"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (before(i) + s["gap"] + s["hit"]).alias("end"), s["value"].alias("value"))
        return running(F.transform(z, lambda s: s["gap"] + s["hit"]), _sum, lambda a, b: a + b, lambda before: F.transform(z, lambda s, i: at(before, s, i)))

    long_enough = F.filter(bound(sizes, placed), lambda s: s["value"] >= (8 if kind == "assign" else 1))
    return F.transform(long_enough, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def spans(text: Column) -> Column:
    """All spans of a text, by start and then by kind in the order of KINDS."""
    return F.array_sort(F.concat(*(F.when(text.rlike(JWT_SCAN if k == "jwt" else PATTERNS[k]), spans_of(text, k)).otherwise(F.array().cast(SPAN)) for k in KINDS)))


def joined(found: Column, kinds: int) -> Column:
    """kind:start:end of the spans of the first kinds, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    own = F.filter(found, lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scanned(blobs: DataFrame, version: str = VERSION) -> DataFrame:
    """Ledger rows (blob, version, spans) of blobs (blob, text)."""
    found = F.when(F.col("text").rlike(HINT), spans(F.col("text"))).otherwise(F.array().cast(SPAN))
    return blobs.select("blob", F.lit(version).alias("version"), found.alias("spans"))


def unseen(df: DataFrame, ledger: DataFrame | None, text: str = "text", version: str = VERSION) -> DataFrame:
    """Distinct blobs (blob, text) of df without a ledger row under this version.

    Groups of copies are first reduced within each task, so a text travels at most once from each.
    """
    blobs = df.groupBy(blob(F.col(text)).alias("blob")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return blobs if ledger is None else blobs.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")


def update(df: DataFrame, path: str | None, text: str = "text", version: str = VERSION) -> DataFrame:
    """Scan what the ledger at path lacks, append it there, and return the ledger's rows under this version.

    Without a path, or before anything is written there, all blobs are new. A run that is stopped before its append leaves the
    ledger as it was.
    """
    spark = df.sparkSession
    if path is None:
        return stored(scanned(unseen(df, None, text, version), version), scratch(spark, "ledger"))
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    scanned(unseen(df, old, text, version), version).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).where(F.col("version") == version)


def findings(df: DataFrame, ledger: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of every row of df plus blob and spans. Rows with null text have those of the empty text. Repeated rows each
    give a row, an empty table none; texts of any length are scanned whole. A kept column named as a result comes out as
    input_<name>."""
    hits = ledger.where(F.size("spans") > 0).select("blob", "spans")
    chosen = df.select(*kept(df, keep, "blob", "spans"), blob(df[text]).alias("blob"))
    return chosen.join(hits, "blob", "left").select(*chosen.columns[:-1], "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, counts of the base kinds, base_sha256 and spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found.select(*keep, *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(F.col("spans"), len(BASE)), 256).alias("base_sha256"), joined(F.col("spans"), len(KINDS)).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by [kind]; overlapping spans become one, named after the first.

    Pieces are cut from four bytes a character, so that a cut needn't count the characters before it.
    """
    names = F.array(*map(F.lit, KINDS))

    def pieces(wide: Column, spans: Column, before: Callable[[Column], Column]) -> Column:
        piece = lambda a, n: F.decode(F.substring(wide, a * 4 + 1, n * 4), "UTF-32")
        own = lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(before(i), s["start"] - before(i)), F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(spans, own), ""), piece(before(F.size(spans)), F.length(wide)))

    whole = bound(F.encode(text, "UTF-32"), lambda wide: running(F.transform(found, lambda s: s["end"]), _most, F.greatest, lambda before: pieces(wide, found, before)))
    return F.when(F.size(found) == 0, text).otherwise(whole)
