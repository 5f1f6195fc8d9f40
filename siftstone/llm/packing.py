"""Hierarchical multi-length packing of tokenised documents.

Every document is routed by length: whole windows of the largest context size are cut off at once, and
what remains goes to the tier of the smallest context size that holds it. Each tier is packed into windows
of its own size, the longest first; the gap of a window is filled from the tiers below it, largest
fitting piece first, and closed by cutting one more piece. So all windows but the last of a buffer are full
and need no padding. Sequences are then dealt to step groups of nearly equal token counts.

The work is done task by task with a bounded buffer and without any shuffle: sequence ids carry the
partition's number, and a repeated task gives the same rows, as it reads the same rows in the same order.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siftstone.llm.common import ship, texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
#: Context sizes, all powers of two: a full window of a short tier needs no padding either.
TIERS = (128, 256, 512, 1024)
#: Pieces that wait in a task before its tiers are packed; at most 4 KiB each.
BUFFER = 8192
#: Tokens of a step group, in windows of the largest size.
STEP_WINDOWS = 8
#: The end of a document.
END_ID = 0
#: Sequence and group ids hold the partition's number above this bit.
PARTITION_BITS = 40


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray


class Pools:
    """Waiting pieces by length, each length a stack, with the occupied lengths found by bit tricks."""

    def __init__(self, top: int):
        self.stacks: list[list[Piece]] = [[] for _ in range(top + 1)]
        self.used = 0  # bit n: pieces of length n wait
        self.count = 0

    def put(self, piece: Piece) -> None:
        n = len(piece.ids)
        self.stacks[n].append(piece)
        self.used |= 1 << n
        self.count += 1

    def take(self, n: int) -> Piece:
        piece = self.stacks[n].pop()
        if not self.stacks[n]:
            self.used &= ~(1 << n)
        self.count -= 1
        return piece

    def longest(self, most: int) -> int:
        """The largest waiting length of at most `most`; 0 if there is none."""
        return max(0, (self.used & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.used & -self.used).bit_length() - 1 if self.used else 0


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    return next(t for t in tiers if length <= t)


def packed(pools: Pools, tiers: tuple[int, ...]) -> Iterator[tuple[int, list[Piece]]]:
    """Windows (tier, pieces) that use up all waiting pieces, longest tier first."""
    below = dict(zip(tiers, (0, *tiers), strict=False))
    for tier in reversed(tiers):
        while (n := pools.longest(tier)) > below[tier]:
            window, gap = [pools.take(n)], tier - n
            while gap and pools.count:
                if n := pools.longest(gap):
                    window.append(pools.take(n))
                    gap -= n
                else:  # all that wait are longer than the gap: cut the shortest, so that tiers stay as they are
                    piece = pools.take(pools.shortest())
                    window.append(piece._replace(ids=piece.ids[:gap]))
                    pools.put(piece._replace(start=piece.start + gap, ids=piece.ids[gap:]))
                    gap = 0
            yield tier, window


class Steps:
    """Deal sequences to step groups: each goes to the open group with the fewest tokens so far."""

    def __init__(self, tokens: int, open_groups: int = 4):
        self.tokens, self.next = tokens, open_groups
        self.heap = [(0, g) for g in range(open_groups)]

    def deal(self, tokens: int) -> int:
        have, group = heapq.heappop(self.heap)
        have += tokens
        if have >= self.tokens:
            heapq.heappush(self.heap, (0, self.next))
            self.next += 1
        else:
            heapq.heappush(self.heap, (have, group))
        return group


def pack_documents(documents: Iterator[tuple[int | None, np.ndarray]], partition: int = 0, tiers: tuple[int, ...] = TIERS, buffer: int = BUFFER) -> Iterator[list[tuple]]:
    """Rows of SCHEMA for (doc_id, ids with the end) pairs, a list for each buffer."""
    top, base = tiers[-1], partition << PARTITION_BITS
    pools, steps, sequence = Pools(top), Steps(STEP_WINDOWS * top), 0
    out: list[tuple] = []

    def window(tier: int, pieces: list[Piece]) -> None:
        nonlocal sequence
        offset, group = 0, base + steps.deal(sum(len(p.ids) for p in pieces))
        for p in pieces:
            out.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids), p.doc_tokens, base + sequence, offset, tier, group))
            offset += len(p.ids)
        sequence += 1

    for doc_id, ids in documents:
        n = len(ids)
        whole = n - n % top
        for at in range(0, whole, top):
            window(top, [Piece(doc_id, at, n, ids[at : at + top])])
        if n > whole:
            pools.put(Piece(doc_id, whole, n, ids[whole:].copy()))
        if pools.count >= buffer:
            for tier, pieces in packed(pools, tiers):
                window(tier, pieces)
        if len(out) >= 20_000:
            yield out
            out = []
    for tier, pieces in packed(pools, tiers):
        window(tier, pieces)
    yield out


class Encoder:
    """ids of a text by the byte-level vocabulary, with the end of a document behind them.

    The same ranks and pattern as the tokenizer file, run by tiktoken; the file's added tokens are found in texts as the
    tokenizers library does. tiktoken's pattern matching gives up on about a million white-space characters in a row; a
    text that it refuses goes through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = {c: b for b, c in byte_letters().items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(visible[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in added}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> np.ndarray:
        try:
            ids = self.encoding.encode(text, allowed_special="all")
        except ValueError:
            ids = self._by_library(text)
        ids.append(END_ID)
        return np.array(ids, "<u4")

    def _by_library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(text, add_special_tokens=False).ids


#: Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The visible letter of each byte in byte-level vocabularies: itself if it prints, else the next from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, buffer: int = BUFFER) -> DataFrame:
    """Pack all documents into sequences of at most tiers[-1] tokens; a row for each piece of a document.

    docs has doc_id and text; other columns are ignored. A null text is empty and so gives one id, the end. Repeated rows are
    packed as often as they occur, a null doc_id is kept as null, and an empty table gives no rows. The rows of one
    document cover its ids without gap or overlap; the offsets of one sequence start at 0 and are gapless.
    Every sequence is as long as its tier, except for the last few of a task.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        partition = TaskContext.get().partitionId()

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                ids, values = batch.column("doc_id").to_pylist(), batch.column("text")
                for i, doc_id in enumerate(ids):
                    yield doc_id, encode(values[i].as_py())

        for rows in pack_documents(documents(), partition, tiers, buffer):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

    return texts(docs).mapInArrow(run, SCHEMA)
