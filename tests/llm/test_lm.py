import math
import zlib
from collections import Counter

import numpy as np
import pytest

from siftstone.llm import lm
from siftstone.llm.common import crc_mod


def plain(rows):
    """Base columns by definition."""
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, out(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, tokens, strict=True)]


def columns(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


def test_base_columns_equal_the_definition(documents, texts):
    got = lm.score(documents, own=200).cache()
    assert [r[:5] for r in columns(got)] == [r[:5] for r in sorted(plain(texts), key=str)]
    for a, b in zip(columns(got), sorted(plain(texts), key=str), strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-4)
    held = got.where("held_out").toPandas()
    assert held.score.sum() > held.base_score.sum()  # the model knows more than the counts


def test_rare_words_are_joined(documents, texts, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 50)
    for a, b in zip(columns(lm.score(documents, own=20)), sorted(plain(texts), key=str), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-4)


def plain_score(known, counts, text):
    """log10 of the model's probability of a text by its definition, token by token over all classes."""
    v, m, singles = known.vocabulary, known.model, {}
    words = [*(text or "").encode().lower().split(), lm.END_TOKEN]
    for w, i in v.index.items():
        if v.cls[i] >= 2 + lm.SHARED:
            singles[w] = int(v.cls[i])
    cls = [lm.END if k == len(words) - 1 else singles.get(w) or lm.shared_class(w) for k, w in enumerate(words)]
    out, a, b = 0.0, lm.START, lm.START
    for w, c in zip(words, cls, strict=True):
        s = [(m.r[a].astype(float) * m.c1 + m.r[b].astype(float) * m.c2) @ m.q[k] + m.b[k] for k in range(v.classes)]
        out += (s[c] - math.log(sum(math.exp(x) for k, x in enumerate(s) if k != lm.START))) / math.log(10)
        if 2 <= c < 2 + lm.SHARED:
            mates = [n for x, n in counts.items() if x not in singles and x != lm.END_TOKEN and lm.shared_class(x) == c]
            out += math.log10((counts.get(w, 0) + 1) / (sum(mates) + len(mates) + 1))
        a, b = b, c
    return out


def test_scores_equal_brute_force(documents, texts, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 300)
    docs = documents.where("n_chars < 600")
    got = {r.doc_id: r.score for r in lm.score(docs, own=40).collect()}
    training = docs.where(crc_mod("doc_id", 7) != 2)
    known = lm.learn(training, own=40)
    counts = Counter()
    for i, t in texts:
        if i in got and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*t.encode().lower().split(), lm.END_TOKEN])
    some = [(i, t) for i, t in texts if i in got][:25]
    assert len(some) > 10
    for i, t in some:
        assert got[i] == pytest.approx(plain_score(known, counts, t), rel=1e-3, abs=1e-2)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = columns(lm.score(odd, own=30))
    assert [r[:5] for r in got] == [r[:5] for r in sorted(plain(rows), key=str)] and all(math.isfinite(r[5]) for r in got)
    assert lm.score(empty).isEmpty()


def test_probabilities_are_normalised():
    r = np.random.default_rng(1)
    m = lm.Lbl(r.integers(1, 50, 12).astype(float), 6)
    lm.Trainer(m, 3)(*(r.integers(0, 12, 500) for _ in range(3)))
    (one, two), z = m.contexts(), m.normalisers(5)
    for a in range(12):
        s = np.exp((one[a] + two) @ m.q.T + m.b - z[a][:, None])
        s[:, lm.START] = 0
        assert np.allclose(s.sum(1), 1, atol=1e-4)


def test_training_learns_what_follows_what():
    r = np.random.default_rng(2)
    b = r.integers(2, 6, 40_000)
    w = np.where(r.random(len(b)) < 0.9, 2 + (b - 1) % 4, r.integers(2, 6, len(b)))
    m = lm.Lbl(np.array([0, 0, 1, 1, 1, 1]) * 10_000.0, 8)
    step = lm.Trainer(m, 5)
    for _ in range(6):
        step(np.full(len(b), 3), b, w)
    (one, two), z = m.contexts(), m.normalisers()
    for x in range(2, 6):
        p = np.exp((one[3] + two[x]) @ m.q.T + m.b - z[3, x])
        assert p.argmax() == 2 + (x - 1) % 4 and p.max() > 0.6


def test_rows_are_summed():
    r = np.random.default_rng(3)
    at, rows, want = r.integers(0, 7, 50), r.normal(size=(50, 3)), np.zeros((8, 3))
    np.add.at(want, at, rows)
    assert np.allclose(lm.summed_rows(at, rows, 8), want)
