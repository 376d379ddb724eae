import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sql.execute(catalogue.SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    a = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    b = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in got.fetchall())
    assert a == b


CONTAMINATION = {"contamination_span", "contamination_screen"}


def test_the_rest_find_what_the_words_alone_find(spark):
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == CONTAMINATION | {"shard_order_pieces", "resumable_stream", "validation_windows"}
    rest = {name: catalogue.QUERIES[name](spark, SF).select("doc_id").distinct().collect() for name in CONTAMINATION}
    words = {r.doc_id for r in catalogue.QUERIES["contamination_word_span"](spark, SF).collect()}
    assert words and words <= {r.doc_id for r in rest["contamination_span"]}
