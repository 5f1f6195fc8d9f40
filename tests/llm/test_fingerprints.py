import hashlib

import pytest

from siftstone.llm import fingerprints as f


def plain(rows):
    """What is to be returned, by definition; fingerprints as canonical bytes."""
    t = sorted(((i, x or "") for i, x in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).digest()))
    out = []
    for k, (i, x) in enumerate(t):
        after = t[(k + 1) % len(t)][1]
        e = f.edited(x, after)
        out.append((i, len(x), hashlib.sha256(e.encode()).hexdigest(), f.canonical(x), f.canonical(e), f.canonical(after)))
    return out


def held(df, rows):
    """The result agrees with plain(), and fingerprints are equal just where canonical bytes are."""
    got = sorted(map(tuple, df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str)
    want = sorted(plain(rows), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    prints = {}
    for g, w in zip(got, want, strict=True):
        assert prints.setdefault(w[3], g[3]) == g[3] and prints.setdefault(w[4], g[4]) == g[4]
        assert (g[5], g[6]) == (float(w[3] == w[4]), float(w[3] == w[5]))
    assert len(set(prints.values())) == len(prints)


def test_documents(documents, texts):
    held(f.fingerprint(documents), texts)


@pytest.mark.parametrize("digits", [32, 1, 0])
def test_odd_rows_and_equal_hashes(odd, digits):
    held(f.fingerprint(odd, digits), [(r.doc_id, r.text) for r in odd.collect()])


def test_what_is_canonical(docs_of):
    assert f.canonical("  Ｆoo\tBAR\n") == b"foo bar" == f.canonical("foo bar") and f.canonical("Straße") == f.canonical("STRASSE") and f.canonical("é") == f.canonical("é")
    assert f.canonical("foo bar") != f.canonical("foobar")
    held(f.fingerprint(docs_of([(1, "Foo bar")])), [(1, "Foo bar")])


def test_empty(empty):
    assert f.fingerprint(empty).isEmpty()
