import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.llm import packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def held(pieces, ids_of, most=1024):
    """Every id lies in one piece, sequences are gapless and short enough; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_sequence[p[5]].append(p)
    assert set(by_doc) == set(ids_of)
    for doc, ps in by_doc.items():
        ids, at = ids_of[doc], 0
        for _, start, n, crc, total, *_ in sorted(ps, key=lambda p: p[1]):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p[6]):
            assert p[6] == at and p[2] > 0
            at += p[2]
        assert at <= most
        padding += 0 if at & (at - 1) == 0 else most - at
    return padding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.integers(1, 40))
def test_all_lengths(lengths, buffer):
    ids = {i: list(range(i, i + n)) for i, n in enumerate(lengths)}
    pieces = [p for rows in packing.pack_documents(((i, np.array(x, "<u4")) for i, x in ids.items()), 3, buffer=buffer) for p in rows]
    assert held(pieces, ids) <= 1024 * (1 + len(lengths) // buffer) * 2
    assert all(p[5] >> packing.PARTITION_BITS == 3 for p in pieces)


def test_little_padding_and_even_steps():
    r = np.random.default_rng(2)
    ids = {i: list(range(n)) for i, n in enumerate(r.lognormal(6, 1, 3000).astype(int) + 1)}
    pieces = [p for rows in packing.pack_documents((i, np.array(x, "<u4")) for i, x in ids.items()) for p in rows]
    assert held(pieces, ids) < 3000
    steps = defaultdict(int)
    for p in pieces:
        steps[p[8]] += p[2]
    sizes = sorted(steps.values())
    assert sizes[len(sizes) // 10] > 0.9 * 8192 and sizes[-1] < 8192 + 1024


def test_query_equals_the_tokenizers_library(documents, texts, path):
    t = tokenizers.Tokenizer.from_file(path)
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in texts}
    pieces = [tuple(r) for r in packing.pack(documents, path).collect()]
    assert held(pieces, ids) <= 4096


def test_odd_rows(odd, empty, path):
    t = tokenizers.Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    pieces = [tuple(r) for r in packing.pack(odd, path).collect()]
    total = defaultdict(int)
    for p in pieces:
        total[p[0]] += p[2]
    want = defaultdict(int)
    for i, x in rows:
        want[i] += len(t.encode(x, add_special_tokens=False).ids) + 1
    assert total == want and packing.pack(empty, path).isEmpty()


def test_very_long_white_space(docs_of, path):
    t = tokenizers.Tokenizer.from_file(path)
    rows = [(1, " " * 2_000_000), (2, "before" + "\n" * 1_200_000 + "behind <|endoftext|> it"), (3, "short")]
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in rows}
    assert held([tuple(r) for r in packing.pack(docs_of(rows), path).collect()], ids) <= 4096
