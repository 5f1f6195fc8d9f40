import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftstone.llm import jaccard


def shingles(text):
    ws = (text or "").lower().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def plain(rows, threshold=0.8):
    """doc_id, class_id, n_links of all rows, by definition."""
    sets, up, links = [shingles(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)
    holding, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for g in s:
            holding[g].append(k)
    for ks in holding.values():
        shared.update(itertools.combinations(ks, 2))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append((i is not None, i or 0, i))
    return sorted(((i, min(least[root(k)])[2], links[k]) for k, (i, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "class_id", "n_links").collect()), key=str)


def near_copies(seed, n=50):
    r = random.Random(seed)
    text = lambda k: [f"w{r.randint(0, 400)}" for _ in range(k)]
    passage, rows = text(40), []
    for base in range(n):
        ws = text(r.choice([1, 4, 5, 6, 20, 90, 150])) + (passage if base % 3 == 0 else [])
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(ws)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = "EDIT" + str(r.randint(0, 3))
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(docs_of, seed):
    rows = near_copies(seed)
    want = plain(rows)
    assert rows_of(jaccard.join(docs_of(rows).repartition(3))) == want and sum(w[2] for w in want) > 50


def test_large_groups_are_cut_into_blocks(docs_of, monkeypatch):
    rows = near_copies(3, 15) + [(1000 + k, " ".join(f"c{i}" if i != k * 2 else "x" for i in range(90))) for k in range(40)]
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 7)
    monkeypatch.setattr(jaccard, "COLUMNS", 50)
    assert rows_of(jaccard.join(docs_of(rows))) == plain(rows)


def test_documents(documents, texts):
    assert rows_of(jaccard.join(documents)) == plain(texts)


def test_odd_rows(docs_of, odd, empty):
    assert rows_of(jaccard.join(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()])
    rows = [(1, "a b"), (2, "A  b"), (2, "a\nb"), (None, "a b"), (3, "a b c"), (4, None), (5, None), (6, "")]
    assert rows_of(jaccard.join(docs_of(rows))) == plain(rows)
    assert jaccard.join(empty).isEmpty() and jaccard.deduplicated(empty).isEmpty()


def test_one_document_of_a_class_stays(docs_of):
    rows = near_copies(4) + [(None, "lone row without an id"), (7000, None), (7001, None)]
    kept = jaccard.deduplicated(docs_of(rows))
    want = Counter(i for i in {c: c for _, c, _ in plain(rows)})
    got = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs_of(rows).columns and got == want


def test_pruning_follows_the_posterior():
    least = jaccard.least_matches()
    for n, m in zip(range(32, 161, 32), least, strict=True):
        grid = (np.arange(200_000) + 0.5) / 200_000
        density = grid**np.float64(m) * (1 - grid) ** np.float64(n - m)
        below = grid ** np.float64(m - 1) * (1 - grid) ** np.float64(n - m + 1)
        assert density[grid >= 0.8].sum() / density.sum() >= 1e-6 > below[grid >= 0.8].sum() / below.sum()
    miss = sum(sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) for n, m in zip(range(32, 161, 32), least, strict=True))
    assert miss < 1e-5 and (1 - 0.8**jaccard.ROWS) ** jaccard.BANDS < 4e-6


def test_minhash_estimates_similarity():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 62, 900, dtype=np.uint64), r.integers(0, 1 << 62, 100, dtype=np.uint64)
    x, y = jaccard.minhash(a), jaccard.minhash(np.concatenate([a, b]))
    assert abs((x == y).mean() - 0.9) < 0.1 and (jaccard.band_keys(np.stack([x, x]))[0] == jaccard.band_keys(np.stack([x, x]))[1]).all()
