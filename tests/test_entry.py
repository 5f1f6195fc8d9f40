import math

import duckdb
import pytest

import __spark_entry__ as entry
from siftstone import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def same(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_its_sql(spark, sf, db, name):
    got = queries.queries()[name](spark, sf)
    wanted = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(map(same, r)) for r in got.select(*columns).collect()), key=str)
    assert rows == sorted((tuple(map(same, r)) for r in wanted.fetchall()), key=str)


@pytest.mark.parametrize("texts", [[""], ["a"], ["\n"], [None], ["", "a", None, "ab", "é", "€", "😀", *("x" * n + "😀" * 3 for n in range(4080, 4098)), *("x" * n for n in (4095, 4096, 4097))]], ids=["empty", "letter", "line", "null", "many"])
def test_binary_sniff_of_odd_texts_equals_its_sql(spark, tmp_path, texts):
    """Texts so short that bad bytes before them stand at the end, no text, texts of about the sample's size."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rows = queries.queries()["binary_sniff"](spark, str(tmp_path)).select("shape", "binary", "short", "n").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(c.execute(f'select shape, "binary", short, n from ({queries.oracle_sql()["binary_sniff"]})').fetchall(), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_are_narrow_and_pruned(spark, sf):
    """Chunking shuffles nothing; a scan of vectors reads no other column; filters reach the scan."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(queries.line_window_chunks(spark, sf)) and "Python" not in plan(queries.bm25_topk(spark, sf))
    assert "label" not in plan(queries.vector_cosine_scan(spark, sf))
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,0)]" in plan(queries.read(spark, sf, "embeddings").where("vec_id = 0"))
