import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import toxicity


@pytest.fixture(scope="module")
def scored(spark, sf):
    at = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    return toxicity.score(docs, labels).cache(), labels, docs


def test_held_out_accuracy(scored):
    rows = scored[0].join(scored[1], "doc_id").where("held_out").toPandas()
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert len(rows) > 500 and hit / rows.toxic.sum() >= 0.8 and hit / rows.predicted.sum() >= 0.9


def test_columns(scored):
    for r in scored[0].sample(0.02, 1).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert scored[0].count() == scored[2].count()


def test_held_out_labels_have_no_part(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    pick = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert pick(toxicity.score(docs, labels)) == pick(toxicity.score(docs, turned))


def test_odd_rows(spark, odd, empty, sf):
    labels = spark.createDataFrame([(5, 1, 0), (3, 0, 0), (None, 1, 1), (9, None, 0), (8, 7, 0), (7, 0, 1), (7, 1, 1), (2, 0, 0), (1, 1, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.score(odd, labels)
    assert got.count() == 12 and all(math.isfinite(r.score) and 0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(empty, labels).isEmpty()
    none = toxicity.score(odd, labels.where("toxic = 0"))
    assert {r.score for r in none.collect()} == {0.0}
    kept = toxicity.without_toxic(odd, labels.where("toxic = 0"))
    assert kept.columns == odd.columns and kept.count() == 12


def test_probabilities_of_a_class_sum_to_one():
    ws = [b"ab", b"abc", b"b", b"ba"]
    k = toxicity.KneserNey(ws, np.array([3, 0, 1, 2]), np.array([1, 5, 0, 2]))
    key, _ = toxicity.windows([b"ab"])
    for ctx in key >> np.uint64(8):
        grams = (np.full(256, ctx, np.uint64) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        p = k.backoff(grams)
        n, h = k.grams(grams), k.contexts(grams >> np.uint64(8))
        for c in (0, 1):
            if h[0, c]:
                assert np.isclose(((np.maximum(n[:, c] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * h[:, 2 + c] * p) / h[:, c]).sum(), 1, atol=1e-6)


def test_evidence_of_stems():
    ws = [f"badword{x}".encode() for x in "abcdef"] + [f"plain{x}".encode() for x in "abcdef"]
    k = toxicity.KneserNey(ws, np.array([9] * 6 + [3] * 6), np.array([0] * 6 + [9] * 6))
    bad, plain, new = k.evidence([b"badwordzz", b"plaina", b"qqq"])
    assert bad > 2 > 0.5 > plain and abs(new) < bad


def plain_evidence(types, word):
    """By definition, with dictionaries: types is {word: (toxic, ordinary) documents}."""
    order, shared, d = toxicity.ORDER, sorted(toxicity.SHARED_ORDERS), toxicity.DISCOUNT
    grams_of = lambda w: [(b"\0" * order + w + b" ")[i + 1 : i + 1 + order] for i in range(len(w) + 1)]
    own, kinds = {}, set()
    for w, counts in types.items():
        for g in grams_of(w):
            kinds.add(g)
            for c in (0, 1):
                own[g, c] = own.get((g, c), 0) + counts[c]

    def backoff(g):
        p = 1 / 256
        for m in shared:
            longer = {k[-m - 1 :] for k in kinds}
            followers = [k[1:] for k in longer if k[1:-1] == g[-m:-1]]
            if followers:
                p = (max(followers.count(g[-m:]) - d, 0) + d * len(set(followers)) * p) / len(followers)
        return p

    logs = [0.0, 0.0]
    for g in grams_of(word):
        p = backoff(g)
        for c in (0, 1):
            after = {k: own[k, c] for k in kinds if k[:-1] == g[:-1]}
            total, seen = sum(after.values()), sum(v > 0 for v in after.values())
            logs[c] += math.log((max(own.get((g, c), 0) - d, 0) + d * seen * p) / total if total else p)
    return logs[0] - logs[1]


def test_evidence_equals_brute_force():
    types = {b"idiot": (5, 0), b"idiots": (2, 1), b"ideal": (0, 4), b"plain": (3, 7), b"aaaaaaaaaaaa": (1, 1), "grün".encode(): (0, 2), b"x": (1, 0)}
    k = toxicity.KneserNey(list(types), *(np.array([n[c] for n in types.values()]) for c in (0, 1)))
    asked = [*types, b"idio", b"unseen", b"aaaaaaaaaaaaaaaaab", b"plainly"]
    assert np.allclose(k.evidence(asked), [plain_evidence(types, w) for w in asked], atol=1e-5)
    weights = np.array([-1.0, 2.0, 0.5, 0.25])
    text = "Idiot plain, ideal! plainly GRÜN"
    e = np.array([plain_evidence(types, w) for w in (b"idiot", b"plain", b"ideal", b"plainly", "grün".encode())])
    x = np.array([1, np.maximum(e - np.median(e) - toxicity.MARGIN, 0).mean(), np.sort(e)[-3:].mean(), e.max()]) @ weights
    assert np.isclose(toxicity.Scorer(k, weights)([text])[0], 1 / (1 + math.exp(-x)), atol=1e-5)


def test_the_length_normalised_ratio_alone_tells_held_out_rows_apart(scored):
    _, labels, docs = scored
    scorer = toxicity.learn(docs, labels.select("doc_id", "toxic"), 4, 2)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).select("text", "toxic").toPandas()
    ratio = scorer.features(rows.text.fillna("").tolist())[:, 1]
    rank = np.empty(len(ratio))
    rank[np.argsort(ratio, kind="stable")] = np.arange(len(ratio))
    toxic = (rows.toxic == 1).to_numpy()
    assert (rank[toxic].mean() - (toxic.sum() - 1) / 2) / (~toxic).sum() >= 0.95
