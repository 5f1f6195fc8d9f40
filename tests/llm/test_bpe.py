import hashlib
import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both(path):
    return bpe.WordBpe(path), tokenizers.Tokenizer.from_file(path)


def agreed(both, text):
    mine, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    decoded = theirs.decode(ids, skip_special_tokens=False)
    assert mine.encode(text) == ids and mine.decode(ids) == decoded
    assert mine.digests(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    agreed(both, text)


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "İ ǅ ŉ ΑΣ ẞ", "é ́", "x\x85y　z\x1c", "we're it'S 12a3", "日本語" * 400, "!" * 900, "🏽" * 200, "ab" * 3000])
def test_odd_texts(both, text):
    agreed(both, text)


def test_streaming_gives_what_merging_gives(both):
    m, r = both[0].merges, random.Random(4)
    for letters in ("ab", "thinganero", "aeiouxyz", "0!a"):
        for _ in range(40):
            s = m.symbols("".join(r.choice(letters) for _ in range(r.randint(1, 300))))
            assert list(m.stream(s)) == m.merged(s)


def test_streaming_keeps_constant_memory(both):
    """What is held while a long word streams doesn't grow with it."""
    m, most = both[0].merges, 0
    longest = []

    def symbols():
        for i in range(20_000):
            longest.append(i)
            yield "thinganero"[(i * i + i // 7) % 10]

    emitted = 0
    for token in m.stream(symbols()):
        emitted += len(token)
        most = max(most, len(longest) - emitted)
    assert most <= 20 * m.lookahead


def test_readable_text_comes_piece_by_piece(both):
    mine = both[0]
    assert "".join(mine.decode_text(mine.encode("Hello wörld 😀<|endoftext|>"))) == "hello wörld 😀 <|endoftext|>"


def test_query(documents, texts, odd, empty, path, both):
    for df, rows in ((documents, texts), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        got = sorted(map(tuple, bpe.encode_digests(df, path).collect()), key=str)
        assert got == sorted(((i, *both[0].digests(t or "")) for i, t in rows), key=str)
    assert bpe.encode_digests(empty, path).isEmpty()
    for _, t in texts[:40]:
        agreed(both, t)


def test_the_query_streams_every_word_and_decodes_from_ids(path, monkeypatch):
    mine, streamed, decoded = bpe.WordBpe(path), [], []
    stream, decode = mine.merges.stream, mine.decode
    monkeypatch.setattr(mine.merges, "stream", lambda symbols: stream(streamed.append(0) or symbols))
    monkeypatch.setattr(mine, "decode", lambda ids: decode(decoded.extend(ids) or ids))
    text = "Short words, one<|endoftext|> and a" + "ab" * 3000 + " long end"
    assert mine.digests(text)[0] == len(decoded) and decoded == mine.encode(text) and len(streamed) >= 8


def test_blocks_and_parts_change_nothing(both, monkeypatch):
    mine, whole = both[0], "one  two\u3000three<|endoftext|> " * 50 + "ab!" * 300 + " \n end "
    for block, waiting in ((1, 1), (7, 5), (64, 4096)):
        monkeypatch.setattr(mine, "BLOCK", block)
        monkeypatch.setattr(mine, "WAITING", waiting)
        mine.cache.clear()
        mine.words.clear()
        agreed(both, whole)


def test_digests_hold_little_of_a_text(path):
    mine = bpe.WordBpe(path)
    text = "a b " * 500_000
    mine.digests(text[:1000])
    tracemalloc.start()
    mine.digests(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_a_word_is_encoded_once_whatever_stands_beside_it(path, monkeypatch):
    """Punctuation and capitals make new chunks, but no new work for a word that is known."""
    mine, decoded = bpe.WordBpe(path), []
    decode = mine.decode
    monkeypatch.setattr(mine, "decode", lambda ids: decode(decoded.append(0) or ids))
    text = " ".join(lead + word + end for lead in ("", "(", "[") for word in ("thing", "Thing", "THING") for end in (",", ".", ";", "!"))
    assert mine.digests(text)[0] == len(mine.encode(text)) and len(decoded) == 1 + 2 + 4


def test_patterns_for_fewer_characters_agree(both):
    mine = both[0]
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}{chr(c)}1's"
            assert [*mine.split(text)] == mine.patterns[-1].findall(text)
