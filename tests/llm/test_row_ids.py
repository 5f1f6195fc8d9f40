"""Results don't depend on how scans are split, even if that changes between two jobs of one operator, as when an executor comes or goes."""

import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftstone.llm import common, components, fingerprints, jaccard, repeats, warc

SPLITS = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes")


@pytest.fixture(scope="module")
def docs(spark, sf, tmp_path_factory):
    """Documents with copies and repeated ids, in files of several row groups."""
    at = str(tmp_path_factory.mktemp("rows") / "documents.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    near = d.withColumn("text", F.concat("text", F.lit(" and an end"))).withColumn("doc_id", F.col("doc_id") + 7)
    d.unionByName(near).repartition(3, "doc_id").sortWithinPartitions("doc_id", "n_chars").write.option("parquet.block.size", 30_000).parquet(at)
    return spark.read.parquet(at)


@pytest.fixture
def changing(spark, monkeypatch):
    """Turns on that each table is written with scans split in another way than the last one."""
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    splits, used = itertools.cycle([("1", "128m"), ("7", "20k"), ("3", "50k"), ("5", "9k")]), []

    def turn_on():
        real = common.written

        def written(df, name):
            used.append(name)
            for k, v in zip(SPLITS, next(splits), strict=True):
                spark.conf.set(k, v)
            return real(df, name)

        for module in (common, components, fingerprints, jaccard, repeats, warc, corpus_pipeline):
            monkeypatch.setattr(module, "written", written)
        return used

    yield turn_on
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_row_ids_are_places(spark, docs):
    a = common.with_rid(common.texts(docs)).select("rid", "doc_id", F.sha2("text", 256))
    one = rows_of(a)
    spark.conf.set(SPLITS[1], "9k")
    try:
        assert a.rdd.getNumPartitions() and rows_of(common.with_rid(common.texts(docs)).select("rid", "doc_id", F.sha2("text", 256))) == one == rows_of(a)
    finally:
        spark.conf.unset(SPLITS[1])
    assert len({r[0] for r in one}) == len(one) == docs.count()


@pytest.mark.parametrize("op", [fingerprints.fingerprint, repeats.remove_repeats, jaccard.join, jaccard.deduplicated, repeats.without_repeats], ids=lambda f: f.__name__)
def test_operators(docs, changing, op):
    want = rows_of(op(docs))
    used = changing()
    assert rows_of(op(docs)) == want and (used or op is fingerprints.fingerprint)


def test_warc(spark, sf, changing):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.unionByName(pages.limit(9))
    want = rows_of(warc.round_trip(pages))
    changing()
    assert rows_of(warc.round_trip(pages)) == want


def test_pipeline(spark, sf, docs, changing):
    def kept():
        now = docs
        for name, stage in corpus_pipeline.STAGES[:3]:
            now = corpus_pipeline.written(stage(spark, now, sf), name)
        return rows_of(now)

    want = kept()
    changing()
    assert kept() == want
