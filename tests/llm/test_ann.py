import numpy as np
import pytest

from siftstone.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 0.5) for i, v in rows], SCHEMA)


def plain(rows, every=50, k=5):
    """The k nearest of each query, by definition."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in sorted({i: min(tuple(v) for j, v in good if j == i) for i, _ in good if i % every == 0}.items()):
        q, best = np.array(q), {}
        for j, v in good:
            if j != i and len(v) == len(q):
                s = float(q @ v / (np.linalg.norm(q) * np.linalg.norm(v)))
                best[j] = max(s, best.get(j, -2))
        out += [(i, r + 1, j, s) for r, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k])]
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def recall(got, want):
    have = {(q, v) for q, _, v, _ in got}
    return sum((q, v) in have for q, _, v, _ in want) / len(want)


@pytest.mark.parametrize("dim", [64, 50])
def test_recall_on_vectors_without_structure(spark, dim):
    r = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(4000, dim)).tolist())]
    got, want = rows_of(ann.search(frame(spark, rows).repartition(4))), plain(rows)
    assert recall(got, want) >= 0.9
    scores = {(q, v): s for q, _, v, s in want}
    assert all(abs(s - scores[q, v]) < 1e-12 for q, _, v, s in got if (q, v) in scores)


def test_embeddings_table(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got, want = rows_of(ann.search(e)), plain([(r.vec_id, r.embedding) for r in e.collect()])
    assert len(got) == len(want) and recall(got, want) >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1, 0, 0]), (50, [0, 1, 0]), (1, [1, 1, 0]), (2, [1, 1, 0]), (3, None), (4, []), (5, [0, 0, 0]), (6, [None, 1, 1]), (7, [float("nan"), 1, 1]), (8, [float("inf"), 1, 1]), (None, [1, 0, 0]), (9, [1, 0]), (100, [1, 0]), (150, [3e38, 1e38, 0]), (10, [1e-38, 0, 0]), (1, [0, 0, 1]), (50, [0, 1, 0]), (200, [5])]
    got, want = rows_of(ann.search(frame(spark, rows).repartition(3))), plain(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_few_candidates_and_blocks(spark):
    r = np.random.default_rng(5)
    rows = [(i * 50, v) for i, v in enumerate(r.normal(size=(6, 64)).tolist())]
    want = plain(rows)
    assert [g[:3] for g in rows_of(ann.search(frame(spark, rows), block=4))] == [w[:3] for w in want] and len(want) == 30
    assert ann.search(frame(spark, rows[:1])).isEmpty() and ann.search(frame(spark, [])).isEmpty() and ann.search(frame(spark, [(1, [1, 0])])).isEmpty()


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(20, 50))
    h = ann.CrossPolytope(50, 2, 3)
    assert np.allclose(np.linalg.norm(h.rotated(x, 2), axis=1), np.linalg.norm(x, axis=1)) and h.axes == 128
    codes, (table, bucket) = h.codes(x), h.probes(x, 300)
    assert all((codes[i, t], t) in set(zip(bucket[i].tolist(), table[i].tolist(), strict=True)) for i in range(20) for t in range(3))


def test_buckets_follow_the_number_of_rows():
    assert [ann.CrossPolytope.of(64, n).functions for n in (1, 500, 10_000, 1_000_000, 10**9)] == [1, 1, 2, 3, 4]


def test_few_vectors_are_compared():
    """Without any structure, the hardest case: about a tenth of the vectors, for nine tenths of the neighbours at least."""
    x = np.random.default_rng(9).normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    hashes, some = ann.CrossPolytope.of(64, len(x)), np.arange(0, len(x), 100)
    seen = ann.Probed(hashes, x[some], ann.measured(hashes, x[::2], 5, len(x))).candidates(hashes.codes(x))
    near = x[some] @ x.T
    near[np.arange(len(some)), some] = -2
    assert seen.mean() <= 0.12 and np.take_along_axis(seen, np.argsort(-near, 1)[:, :5], 1).mean() >= 0.9


def test_probes_are_few_enough_for_the_driver():
    """With three functions, which suit 600,000 rows, vectors without structure would take 122,880 probes each: 4 GB of keys a block of 4096 queries."""
    x = np.random.default_rng(4).normal(size=(8000, 64))
    assert ann.CrossPolytope.of(64, 600_000).functions == 3
    hashes, probes = ann.fitted(x, 64, 5, 600_000)
    assert hashes.functions == 2 and probes <= ann.MOST_PROBES


def test_blocks_hold_a_bounded_number_of_probes(spark, monkeypatch):
    sizes, plain_init = [], ann.Probed.__init__

    def init(self, hashes, unit, n):
        plain_init(self, hashes, unit, n)
        if self.keys is not None:
            sizes.append(len(self.owners))

    rows = [(i * 10, v) for i, v in enumerate(np.random.default_rng(6).normal(size=(400, 64)).tolist())]
    want = rows_of(ann.search(frame(spark, rows)))  # 80 queries in one block
    monkeypatch.setattr(ann.Probed, "__init__", init)
    monkeypatch.setattr(ann, "ENTRIES", 10_000, raising=False)
    assert rows_of(ann.search(frame(spark, rows))) == want and len(want) == 400
    assert sizes and max(sizes) <= 10_000
