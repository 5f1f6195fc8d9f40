import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.llm import repeats


def plain(rows, length=100):
    """By definition; rows of one id are in the order given."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), []
    for k in order:
        data = (rows[k][1] or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((rows[k][0], len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def passages(seed, n=60):
    """Texts that share passages of all lengths, with copies, near copies, periods and short ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [text(r.randint(5, 60)) for _ in range(8)] + ["x" * 150, "ab" * 90]
    rows = []
    for i in range(n):
        parts = [r.choice(shared) if r.random() < 0.5 else text(r.randint(1, 60)) for _ in range(r.randint(1, 5))]
        rows.append((r.randint(0, n), " ".join(parts)))
    rows += [(i, t) for i, t in r.sample(rows, 5)]
    rows += [(r.randint(0, n), t[:50] + "!" + t[51:]) for _, t in r.sample(rows, 10)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages(docs_of, seed):
    rows = passages(seed)
    assert rows_of(repeats.remove_repeats(docs_of(rows).coalesce(1))) == plain(rows)


def test_unique_ids_over_many_partitions(docs_of):
    rows = [(k, t) for k, (_, t) in enumerate(passages(5, 120))]
    assert rows_of(repeats.remove_repeats(docs_of(rows).repartition(7))) == plain(rows)


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_anchors_in_many_contexts_are_divided(docs_of, limit):
    rows = passages(7)
    assert rows_of(repeats.remove_repeats(docs_of(rows).coalesce(1), limit)) == plain(rows)


def test_documents(documents, texts):
    assert rows_of(repeats.remove_repeats(documents)) == plain(texts)


def test_odd_rows(docs_of, odd, empty):
    rows = [(3, "q" * 99), (4, "q" * 99), (1, "q" * 100), (2, "q" * 101), (None, "z" * 120), (9, "z" * 110), (5, None), (6, ""), (7, "p" * 300), (8, "é" * 50), (10, "é" * 50), (11, "aé" + "é" * 60)]
    assert rows_of(repeats.remove_repeats(docs_of(rows).coalesce(1))) == plain(rows)
    assert rows_of(repeats.remove_repeats(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()]) and repeats.remove_repeats(empty).isEmpty()


def test_very_long_texts_are_cut_into_pieces(docs_of, monkeypatch):
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh") for _ in range(9000))
    rows = [(1, long), (2, long[2000:2600] + "#" + long[7000:7300]), (3, "x" + long)]
    seen = {}
    for chunk in (1 << 20, 700):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        found = [(n, p.tolist(), h.tolist()) for n, p, h in repeats.anchor_batches(iter([long.encode()]))]
        seen[chunk] = [(place >> 14, h) for n, p, hs in found for place, h in zip(p, hs, strict=True) if n == 0]
    assert set(seen[700]) == set(seen[1 << 20]) and len(seen[700]) >= len(seen[1 << 20]) > 200
    assert rows_of(repeats.remove_repeats(docs_of(rows).coalesce(1))) == plain(rows)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200) | st.text("ab", max_size=200).map(str.encode) | st.text("ab\0", max_size=60).map(lambda t: t.encode() * 3))
def test_suffix_arrays(text):
    s = repeats.suffix_array(text, 1000)
    assert s.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = repeats.common_prefixes(text, s, 1000)
    for k in range(1, len(text)):
        a, b = text[s[k] :], text[s[k - 1] :]
        assert lcp[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_equal_strings_have_the_same_anchor():
    r = random.Random(3)
    s = bytes(r.randrange(97, 105) for _ in range(100))
    a, b = (bytes(r.randrange(97, 105) for _ in range(n)) for n in (40, 77))
    owner, at, h, lo, hi = repeats.anchors([a + s + b, b + s + a])
    mine = [{(hh, p - base) for o, p, hh, x, y in zip(owner, at, h, lo, hi, strict=True) if o == k and x <= base <= y} for k, base in ((0, 40), (1, 77))]
    assert len(mine[0]) == 1 and mine[0] == mine[1]


def test_the_text_without_repeats(spark, docs_of):
    part = "".join(chr(233 + i) for i in range(60))
    rows = [(1, part + "1"), (2, "x" + part[:55] + "end"), (3, None), (4, "x" * 250)]
    out = repeats.without_repeats(docs_of(rows).coalesce(1))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs_of(rows).columns and got[1].text == rows[0][1] and got[2].text == "xend" and got[3].text is None and got[4].text == "x" and got[2].n_chars == 4


@pytest.mark.parametrize("pool", [1 << 19, 2000, 300, 0])
@pytest.mark.parametrize("size", [5, 1000])
def test_groups_of_any_size_are_decided(monkeypatch, pool, size):
    """A pool of no bytes divides every group down to equal strings."""
    monkeypatch.setattr(repeats, "POOL", pool)
    texts = [t.encode() for _, t in passages(6, 90)]
    rows = []
    for n, places, hashes in repeats.anchor_batches(iter(texts)):
        for place, h in zip(places.tolist(), hashes.view("int64").tolist(), strict=True):
            at, lo, hi = repeats.unpacked_place(place)
            rows.append({"h": h, "doc_id": n, "rid": n, "start": lo, "left": at - lo, "context": texts[n][lo : hi + 100], "end": None})
    rows.sort(key=lambda r: (r["h"], r["left"], r["context"], r["rid"], r["start"]))
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("left", pa.int64()), ("context", pa.binary()), ("end", pa.int64())])
    decider, gone = repeats.Decider(), [bytearray(len(t)) for t in texts]

    def mark(spans):
        for rid, a, b in zip(*(x.tolist() for x in spans), strict=True):
            gone[rid][a:b] = b"\1" * (b - a)

    for i in range(0, len(rows), size):
        for spans in decider.add(pa.RecordBatch.from_pylist(rows[i : i + size], schema)):
            mark(spans)
    for spans in decider.end():
        mark(spans)
    assert sorted(sum(g) for g in gone) == sorted(r[2] for r in plain([(n, t.decode()) for n, t in enumerate(texts)]))
    assert sum(map(sum, gone)) > 5000


@pytest.mark.parametrize("length", [60, 90])
def test_a_common_line_gathers_nowhere(spark, docs_of, monkeypatch, length):
    """6,000 texts share a line and nothing else: no task gets more than a bounded number of contexts, though each context is another."""
    r = random.Random(4)
    word = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    line = word(length)
    docs = docs_of([(i, f"{word(90)}{line}{word(90)}") for i in range(6000)]).repartition(4)
    most = []
    frames = type(docs)
    real = frames.mapInArrow

    def counted(df, run, schema, *more):
        if schema == "rid long, start long, end long":
            most.append(max((x["count"] for x in df.where("h is not null").groupBy("h").count().collect()), default=0))
        return real(df, run, schema, *more)

    monkeypatch.setattr(frames, "mapInArrow", counted)
    out = repeats.remove_repeats(docs, 200)
    assert out.where("n_removed > 0").isEmpty() and out.count() == 6000 and most and max(most) <= 200


def test_anchors_meet_the_list_of_hot_ones_once(docs_of, monkeypatch):
    """They are told apart in one written table; what reads a part of it later, which happens several times, joins nothing anew."""
    plans, contexts = [], repeats.contexts

    def spied(docs, met, halve=False):
        plans.append((halve, met._jdf.queryExecution().optimizedPlan().toString()))
        return contexts(docs, met, halve)

    monkeypatch.setattr(repeats, "contexts", spied)
    rows = passages(7)
    assert rows_of(repeats.remove_repeats(docs_of(rows).coalesce(1), 3)) == plain(rows)
    assert sorted(halve for halve, _ in plans) == [False, True] and not any("Join" in plan for _, plan in plans)


def test_marks_need_no_join(docs_of, monkeypatch):
    """What is settled already isn't compared with the list of what is still too large; each row of a large group would be, every round."""
    joined, picked = [], repeats.picked

    def spied(df, ids, how, name="rid", *rest):
        if name == "h":
            joined.append(df.where("h is null").count())
        return picked(df, ids, how, name, *rest)

    monkeypatch.setattr(repeats, "picked", spied)
    line = "one line that all of these texts have, and that is long enough for a string of its own, with some more words behind it. "
    rows = [(i, f"text {i * i} begins so; " + line + f"and text {i * 7} ends") for i in range(60)]
    assert rows_of(repeats.remove_repeats(docs_of(rows).coalesce(1), 3)) == plain(rows)
    assert joined and not any(joined)
