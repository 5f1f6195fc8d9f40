import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftstone.llm import toxicity
from siftstone.llm.common import written
from siftstone.llm.queries import oracle_sql, queries
from test_jaccard import plain as jaccard_plain


def without_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows):
        data, gone = t.encode(), None
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            if w in seen:
                gone[k : k + length] = [True] * length
            seen.add(w)
        out.append((i, bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def test_stages_equal_brute_force(spark, sf):
    """Each stage's decisions against a plain version over its own input, and run() gives the last stage's rows."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        if name == "toxicity":
            rows = {i: t for i, t in rows.items() if not scores[i]}
        elif name == "ngram_jaccard_join":
            rows = {i: rows[i] for i in {c for _, c, _ in jaccard_plain(list(rows.items()))}}
        else:
            rows = dict(without_repeats(rows.items()))
        assert {r.doc_id: r.text for r in docs.collect()} == rows, name
    assert docs.where(F.length("text") != F.col("n_chars")).isEmpty()
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, sf)
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in rows.items()}


def test_stages_take_odd_rows(spark, odd, empty, sf):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert name == "packing" or out.columns == odd.columns
        assert out.count() > 0 and stage(spark, empty.withColumn("h", F.lit(1)), sf).count() == 0


def test_registered():
    assert sorted(queries(), key=lambda q: int(q[2:].split("_")[0])) == [f for n in range(1, 11) for f in queries() if f.startswith(f"op{n}_")] and oracle_sql() == {} and corpus_pipeline.ORACLE_SQL is None
