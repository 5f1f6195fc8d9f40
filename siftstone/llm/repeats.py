"""Removal of repeated passages by suffix arrays built in two stages.

Which bytes meet. A text whose copy starts earlier is removed whole. In all other texts, hashes of all 32-byte grams are computed, and of
every 100-byte string the gram with the least hash is an anchor; so equal strings have the same anchor at the same
place. Anchors that occur once need no more work. Around each of the others, the bytes that strings with this anchor can cover, its
context, are brought together by the anchor's hash. Equal contexts are collapsed: all but the first are repeats whole.

What is decided. Over the differing contexts of the same anchors a suffix array is built in two stages: suffixes smaller
than their successors are sorted directly, all others are induced by a scan over the buckets of first bytes. Neighbours in it
with a common prefix of 100 bytes or more are repeats; of those that share one, the earliest occurrence stays.

A hash only brings bytes together; every decision compares bytes. Anchors that a task sees twice aren't shuffled but for
one, so no common passage gathers more rows than there are batches. A common line that is shorter than a string makes an anchor with as many
differing contexts as there are documents. These are divided before they are dealt out: strings with an anchor's gram in their first half share the
bytes behind it, those with it in their second half the bytes before it, and so on by halves of halves until no part is large;
at the end a part's strings are equal, and equal ones are collapsed where they are found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import SENT_IDS, dropped, join_counted, picked, release, ship, texts, with_rid, written

#: Bytes of a string that may occur once only, and of a gram.
LENGTH, GRAM = 100, 32
#: Grams of a string.
SPAN = LENGTH - GRAM + 1
#: Contexts of one anchor that meet in a task, at most; more are divided by what their strings share before they are dealt out.
HOT_CONTEXTS = 2000
#: Bytes of texts whose grams are hashed at once, and of contexts whose suffixes are sorted at once.
CHUNK, POOL = 1 << 18, 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)
_r = np.random.default_rng(3)
BYTE_HASH = _r.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = [(w, np.uint64(_r.integers(1, 1 << 62)) * np.uint64(2) + np.uint64(1)) for w in (1, 2, 4, 8, 16)]


# --- anchors ---------------------------------------------------------------------------------------------------------


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A nonzero 64-bit hash of the GRAM bytes from each position on; positions too close to the end have none."""
    h = BYTE_HASH[text]
    for width, factor in STEPS:
        h = h[:-width] * factor + h[width:]
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each `width` neighbours."""
    f, done = np.minimum if least else np.maximum, 1
    while 2 * done <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, position, hash, first string, last string) of the anchors of texts of LENGTH bytes or more.

    Each string belongs to the first of its grams with the least hash; the strings of an anchor follow one another.
    """
    flat = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    h = gram_hashes(flat)
    least = sliding(h, SPAN, True)  # of the string from each position on
    inside = np.ones(len(least), bool)
    for end in (starts + sizes)[:-1]:
        inside[end - LENGTH + 1 : end] = False  # these strings would cross into the next text
    shown = np.where(inside, least, np.uint64(0))
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), shown, np.zeros(SPAN - 1, np.uint64)])
    at = np.flatnonzero(sliding(padded, SPAN, False) == h)
    strings = np.flatnonzero(inside)
    number = np.searchsorted(at, strings)  # the next anchor; go on to the one whose hash is the string's least
    open_ = np.flatnonzero(h[at[number]] != least[strings])
    while len(open_):
        number[open_] += 1
        open_ = open_[h[at[number[open_]]] != least[strings[open_]]]
    owned, first, count = np.unique(number, return_index=True, return_counts=True)
    at, lo, hi = at[owned], strings[first], strings[first + count - 1]
    owner = np.searchsorted(starts, at, side="right") - 1
    return owner, at - starts[owner], h[at], lo - starts[owner], hi - starts[owner]


def anchor_batches(texts_: Iterator[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, places, hashes) of each text; short ones together, long ones by themselves. See packed_place()."""
    held, numbers, size = [], [], 0

    def flush() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        owner, at, h, lo, hi = anchors(held)
        places = packed_place(at, lo, hi)
        cuts = np.searchsorted(owner, np.arange(len(held) + 1))
        for k, n in enumerate(numbers):
            yield n, places[cuts[k] : cuts[k + 1]], h[cuts[k] : cuts[k + 1]]

    for n, text in enumerate(texts_):
        if len(text) < LENGTH:
            continue
        if len(text) > 4 * CHUNK:
            for begin in range(0, len(text) - LENGTH + 1, CHUNK):  # every string begins in one piece, and is whole there
                _, at, h, lo, hi = anchors([text[begin : begin + CHUNK + LENGTH - 1]])
                yield n, packed_place(at + begin, lo + begin, hi + begin), h
            continue
        held.append(text)
        numbers.append(n)
        size += len(text)
        if size >= CHUNK:
            yield from flush()
            held, numbers, size = [], [], 0
    if held:
        yield from flush()


def packed_place(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """An anchor's position, and how far before it its first and last string begin, in one number."""
    return (at << 14) | ((at - lo) << 7) | (at - hi)


def unpacked_place(place: int) -> tuple[int, int, int]:
    """Position, first string, last string."""
    at = place >> 14
    return at, at - ((place >> 7) & 127), at - (place & 127)


# --- suffix arrays ---------------------------------------------------------------------------------------------------


def words_of(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number that orders like them; the last 7 positions have none."""
    n = len(text) - 7
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out <<= np.uint64(8)
        out |= text[i : n + i]
    return out


def sorted_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the first `depth` bytes from there on (zeros behind the end); refines only what is still tied."""
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    tied = np.zeros(len(at), np.int64)  # group number of each place
    tied[1:] = np.cumsum(key[1:] != key[:-1])
    open_ = np.arange(len(at))
    for d in range(8, depth, 8):
        open_ = open_[np.bincount(tied[open_], minlength=tied[-1] + 1 if len(tied) else 0)[tied[open_]] > 1]
        if not len(open_):
            break
        key = words[at[open_] + d]
        order = np.lexsort((key, tied[open_]))
        at[open_] = at[open_][order]
        key, group = key[order], tied[open_]
        new = np.zeros(len(at), bool)
        new[open_[1:]] = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        tied = tied + np.cumsum(new)
    return at


def suffix_array(text: bytes, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of text in order, exact in their first `depth` bytes; two-stage sorting.

    Type B suffixes are smaller than their successors and are sorted directly. Type A ones are larger; going over the
    suffixes in order, each hands on its predecessor, if of type A, to the next place of its bucket. In a bucket of equal first
    bytes type A comes before type B.
    """
    n = len(text)
    t = np.frombuffer(text + bytes(depth + 16), np.uint8)
    values = t[:n].astype(np.int64) + 1  # the end of the text is the smallest, as 0
    if not n:
        return np.zeros(0, np.int64)
    following = np.append(values[1:], 0)
    decided = np.where(values != following, np.arange(n), n)
    decides = np.minimum.accumulate(decided[::-1])[::-1]  # where the run of equal bytes ends
    type_a = values[decides] > following[decides]
    b = sorted_directly(words_of(t), np.flatnonzero(~type_a), depth + 8)
    firsts = values[b]
    out = np.empty(n, np.int64)
    bucket_a = [[] for _ in range(258)]
    if type_a[n - 1]:
        bucket_a[values[n - 1]].append(np.array([n - 1]))  # handed on by the empty suffix
    cuts = np.searchsorted(firsts, np.arange(259))
    done = 0

    def hand_on(place: np.ndarray, value: int) -> np.ndarray:
        """Deal the predecessors of type A to their buckets; returns those of this very bucket."""
        before = place[place > 0] - 1
        before = before[type_a[before]]
        heads = values[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        for part in np.split(before, np.flatnonzero(np.diff(heads)) + 1) if len(before) else ():
            if values[part[0]] != value:
                bucket_a[values[part[0]]].append(part)
        return before[heads == value]

    for value in range(1, 258):
        level = np.concatenate(bucket_a[value]) if bucket_a[value] else np.zeros(0, np.int64)
        while len(level):  # runs of this byte hand on within the bucket
            out[done : done + len(level)] = level
            done += len(level)
            level = hand_on(level, value)
        own = b[cuts[value] : cuts[value + 1]]
        out[done : done + len(own)] = own
        done += len(own)
        hand_on(own, value)
    return out


def common_prefixes(text: bytes, suffixes: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it, up to `depth`; 0 for the first."""
    n = len(text)
    t = np.frombuffer(text + bytes(depth + 16), np.uint8)
    words = words_of(t)
    out = np.zeros(n, np.int64)
    open_ = np.arange(1, n)
    for d in range(0, depth, 8):
        x, y = words[suffixes[open_] + d], words[suffixes[open_ - 1] + d]
        same = x == y
        differ = (x ^ y)[~same]
        lead = np.zeros(len(differ), np.int64)
        for i in range(1, 8):
            lead += differ < (np.uint64(1) << np.uint64(64 - 8 * i))
        out[open_[~same]] = d + lead
        open_ = open_[same]
        if not len(open_):
            break
    out[open_] = depth
    limit = np.minimum(n - suffixes, np.append(n, n - suffixes[:-1]))
    return np.minimum(np.minimum(out, limit), depth)


def repeated(contexts: list[bytes], order: list[tuple], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of each string of `length` bytes that occurs earlier in these contexts, ascending.

    order[i] is (document, position) of the first byte of context i; strings at the same document and position are the same
    occurrence.
    """
    text = b"".join(contexts)
    sizes = np.array([len(c) for c in contexts])
    starts = np.cumsum(sizes) - sizes
    s = suffix_array(text, length)
    run = np.cumsum(common_prefixes(text, s, length) < length)  # suffixes of one run share `length` bytes
    many = np.bincount(run)[run] > 1
    s, run = s[many], run[many]
    owner = np.searchsorted(starts, s, side="right") - 1
    within = s - starts[owner]
    whole = within + length <= sizes[owner]  # the string doesn't cross into the next context
    run, owner, within = run[whole], owner[whole], within[whole]
    if not len(run):
        return owner, within
    number = {d: i for i, d in enumerate(sorted({d for d, _ in order}))}
    doc = np.array([number[d] for d, _ in order])[owner]
    at = np.array([p for _, p in order])[owner] + within
    sort = np.lexsort((at, doc, run))
    run, owner, within, doc, at = run[sort], owner[sort], within[sort], doc[sort], at[sort]
    first = np.append(True, run[1:] != run[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (doc != doc[head]) | (at != at[head])
    owner, within = owner[later], within[later]
    sort = np.lexsort((within, owner))
    return owner[sort], within[sort]


def covered(owner: np.ndarray, begin: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of the runs that strings of `length` bytes cover; owner and begin ascend."""
    if not len(owner):
        return owner, begin, begin
    new = np.append(True, (owner[1:] != owner[:-1]) | (begin[1:] > begin[:-1] + length))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], begin[first], begin[last] + length


# --- the pass over a corpus ------------------------------------------------------------------------------------------


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans (start, end)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Member(NamedTuple):
    """A context of an anchor."""

    doc_id: int | None
    rid: int
    start: int
    left: int  # bytes before the anchor's gram
    context: bytes

    @property
    def order(self) -> tuple:
        return ((0, 0) if self.doc_id is None else (1, self.doc_id), self.rid), self.start


def split(group: list[Member], least: int, most: int) -> Iterator[list[Member]]:
    """Members of one anchor that share what all strings with least..most bytes before the gram hold of them.

    Only members that have such strings, and share it with another, are handed on.
    """
    right = LENGTH - GRAM - most
    by: dict[bytes, list[Member]] = defaultdict(list)
    for m in group:
        if m.left >= least and m.left - (len(m.context) - LENGTH) <= most:
            by[m.context[m.left - least : m.left + GRAM + right]].append(m)
    return (members for members in by.values() if len(members) > 1)


class Decider:
    """Takes contexts sorted by hash, anchor's place, bytes and place in the corpus; gives (rid, start, end) of repeated bytes.

    What is sorted at once is bounded by about POOL bytes: a larger group is divided by what its strings share, by halves of the
    anchor's places in them, down to strings that are equal.
    """

    def __init__(self):
        self.last: tuple | None = None  # hash, left, context of the last row
        self.group: list[Member] = []  # first rows of the differing contexts of the last hash
        self.pool: list[Member] = []
        self.size = 0

    def settle(self, group: list[Member], least: int = 0, most: int = LENGTH - GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Decide the differing contexts of one anchor, as far as they concern strings with least..most bytes before its gram."""
        size = sum(len(m.context) for m in group)
        if size <= POOL:
            self.pool += group
            self.size += size
            if self.size >= POOL:
                yield self.sort_pool()
        elif least == most:  # one string each, and all are equal
            first = min(group, key=lambda m: (m.order[0], m.start + m.left))
            later = [m for m in group if m is not first]
            begin = np.array([m.start + m.left - least for m in later])
            yield np.array([m.rid for m in later]), begin, begin + LENGTH
        else:
            middle = (least + most) // 2
            for a, b in ((least, middle), (middle + 1, most)):
                for members in split(group, a, b):
                    yield from self.settle(members, a, b)

    def sort_pool(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pool, self.pool, self.size = self.pool, [], 0
        owner, within = repeated([m.context for m in pool], [m.order for m in pool])
        owner, a, b = covered(owner, within)
        base = np.array([m.start for m in pool])[owner]
        return np.array([m.rid for m in pool])[owner], base + a, base + b

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The group of the last hash is complete."""
        group, self.group = self.group, []
        if len(group) > 1:
            half = (LENGTH - GRAM) // 2
            worth = {id(m): m for a, b in ((0, half - 1), (half, 2 * half)) for members in split(group, a, b) for m in members}
            if len(worth) > 1:
                yield from self.settle(list(worth.values()))

    def add(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        h, rid, start, left = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "rid", "start", "left"))
        doc_id, context = batch.column("doc_id"), batch.column("context")
        n = len(h)
        same_h = np.append(self.last is not None and self.last[0] == h[0], h[1:] == h[:-1])
        equal = pc.equal(context.slice(1), context.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool) if n > 1 else np.zeros(0, bool)
        same = same_h & np.append(self.last is not None and self.last[1:] == (left[0], context[0].as_py()), equal & (left[1:] == left[:-1]))
        self.last = (h[-1], left[-1], context[n - 1].as_py())
        copies = np.flatnonzero(same)  # the whole context occurs earlier
        yield rid[copies], start[copies], start[copies] + pc.binary_length(context).to_numpy()[copies]
        firsts = np.flatnonzero(~same)
        bounds = np.append(np.flatnonzero(~same_h[firsts]), len(firsts))  # where a new hash begins
        row = lambda i: Member(doc_id[i].as_py(), int(rid[i]), int(start[i]), int(left[i]), context[i].as_py())
        self.group += [row(i) for i in firsts[: bounds[0]].tolist()]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield from self.close()
            if b - a > 1 or b == len(firsts):
                self.group += [row(i) for i in firsts[a:b].tolist()]

    def end(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        yield from self.close()
        if self.pool:
            yield self.sort_pool()


def squeezed(docs: DataFrame) -> DataFrame:
    """docs with compressed UTF-8 bytes, z, in place of text."""

    @F.arrow_udf("binary")
    def compressed(column: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=3)
        return pa.array([squeeze.compress(column[i].as_py().encode("utf-8", "surrogatepass")) for i in range(len(column))], pa.binary())

    return docs.select(*[c for c in docs.columns if c != "text"], compressed("text").alias("z"))


def copies(docs: DataFrame) -> DataFrame:
    """rid and length of the texts that occur earlier as a whole, and are long enough to be removed."""
    brief = docs.select("rid", "doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")).where(F.col("size") >= LENGTH)
    firsts = brief.groupBy("sha").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid")).alias("first")).where("n > 1")
    return join_counted(brief, firsts, "sha", "n", brief.count(), "inner").where(F.col("rid") != F.col("first.rid")).select("rid", "size")


def meeting_anchors(docs: DataFrame) -> DataFrame:
    """rid, pos, h of all anchors whose hash occurs more than once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, column = batch.column("rid").to_numpy(), batch.column("text")
            own, at, hs = [], [], []
            for n, p, h in anchor_batches(column[i].as_py().encode("utf-8", "surrogatepass") for i in range(len(column))):
                own.append(np.full(len(p), rids[n]))
                at.append(p)
                hs.append(h)
            if not own:
                continue
            rid, pos, h = np.concatenate(own), np.concatenate(at), np.concatenate(hs).view(np.int64)
            _, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = times[inverse] > 1  # met here already: needs no shuffle
            lead = np.zeros(len(h), bool)
            lead[first] = True
            # 0: unknown, 1: known, stands for all of this batch, 2: known, passes by
            state = np.where(known, np.where(lead, 1, 2), 0).astype(np.int32)
            for a in range(0, len(h), 100_000):
                cut = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (rid, pos, h, state)], names=["rid", "pos", "h", "state"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of a hash that hasn't met another
        for batch in batches:
            h, state = batch.column("h").to_numpy(), batch.column("state").to_numpy()
            n = len(h)
            if not n:
                continue
            same = np.zeros(n, bool)  # as the next
            same[:-1] = h[:-1] == h[1:]
            back = np.append(held is not None and held[2] == h[0], same[:-1])
            if held is not None and back[0] and held[3] == 0 and not held[4]:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in held[:3]], names=["rid", "pos", "h"])
            keep = (same | back) & (state == 0)
            rid, pos = batch.column("rid").to_numpy(), batch.column("pos").to_numpy()
            held = (int(rid[-1]), int(pos[-1]), int(h[-1]), int(state[-1]), bool(keep[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (rid, pos, h)], names=["rid", "pos", "h"])

    found = written(docs.select("rid", "text").mapInArrow(find, "rid long, pos long, h long, state int"), "anchors")
    met = found.where("state < 2").repartition("h").sortWithinPartitions("h").mapInArrow(meet, "rid long, pos long, h long")
    both = written(found.where("state > 0").select("rid", "pos", "h").unionByName(met), "meeting")
    dropped(found)
    release(docs.sparkSession)
    return both


def beside_texts(docs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (rid and columns, all long) sorted behind their text: one shuffle of the compressed texts, and no join.

    A column `rest` of docs, if there is one, goes along with the text.
    """
    rest = [F.lit(None).cast(docs.schema["rest"].dataType).alias("rest")] if "rest" in docs.columns else []
    nothing = [F.lit(None).cast("long").alias(c) for c in columns]
    left = squeezed(docs).select("rid", F.lit(0).alias("step"), "doc_id", "z", *["rest"] * len(rest), *nothing)
    right = rows.select("rid", F.lit(1).alias("step"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("z"), *rest, *columns)
    return left.unionByName(right).repartition("rid").sortWithinPartitions("rid", "step", *columns)


def part_key(h: int, least: int, most: int, shared: bytes) -> int:
    """A 64-bit key of the strings of an anchor that have least..most bytes before its gram and share these bytes."""
    return int.from_bytes(xxhash.xxh3_64_digest(b"%d %d %d " % (h, least, most) + shared), "big", signed=True)


class Earliest:
    """Holds back contexts of one task: of equal ones only the earliest goes on, the others are repeats and become marks."""

    def __init__(self, most: int = 30_000):
        self.most, self.kept, self.marks = most, {}, []

    def add(self, h: int, doc_id: int | None, rid: int, start: int, left: int, context: bytes, end: int | None = None) -> None:
        key, mine = (h, left, context, end), ((0, 0) if doc_id is None else (1, doc_id), rid, start)
        held = self.kept.get(key)
        if held is None:
            self.kept[key] = mine
        else:
            first, later = (held, mine) if held < mine else (mine, held)
            self.kept[key] = first
            self.marks.append((later[1], later[2], later[2] + len(context)))

    def add_halves(self, h: int, doc_id: int | None, rid: int, start: int, left: int, context: bytes, least: int, most: int) -> None:
        """A context in two, for the strings with fewer and with more bytes before the anchor's gram, each by a key of what its strings share."""
        last, middle = left - len(context) + LENGTH, (least + most) // 2
        for a, b in ((least, middle), (middle + 1, most)) if least < most else ((least, most),):
            longest, shortest = min(left, b), max(last, a)  # bytes before the gram that strings of this context have
            if longest >= shortest:
                key = part_key(h, a, b, context[left - a : left + LENGTH - b])
                self.add(key, doc_id, rid, start + left - longest, longest, context[left - longest : left - shortest + LENGTH], a << 7 | b)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.marks), 50_000):
            rid, a, b = zip(*self.marks[at : at + 50_000], strict=True)
            none = [None] * len(rid)
            yield self.batch(none, none, rid, a, none, none, b)
        rows = [(h, d if known else None, r, s, left, context, end) for (h, left, context, end), ((known, d), r, s) in self.kept.items()]
        for at in range(0, len(rows), 20_000):
            yield self.batch(*zip(*rows[at : at + 20_000], strict=True))
        self.kept, self.marks = {}, []

    @staticmethod
    def batch(*cols) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in CONTEXTS.split(", ")])


#: A context, or without h a mark that is settled already, with its end. Of contexts that are divided, `end` says how many bytes their strings
#: have before the anchor's gram, least << 7 | most.
CONTEXTS = "h long, doc_id long, rid long, start long, left long, context binary, end long"


def contexts(docs: DataFrame, met: DataFrame, halve: bool = False) -> DataFrame:
    """The strings of every meeting anchor as one context, from its first string's start to its last one's end; or as two halves of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow, text, rid, doc_id, z, out = zstandard.ZstdDecompressor(), b"", None, None, None, Earliest()
        for batch in batches:
            steps, rids, ids, zs = batch.column("step").to_numpy(), batch.column("rid").to_numpy(), batch.column("doc_id"), batch.column("z")
            hs, places = batch.column("h").to_pylist(), batch.column("pos").to_pylist()
            for i in range(len(steps)):
                if steps[i] == 0:
                    rid, doc_id, z, text = int(rids[i]), ids[i].as_py(), zs[i].as_py(), None
                    continue
                if text is None:
                    text = grow.decompress(z)
                at, lo, hi = unpacked_place(places[i])
                if halve:
                    out.add_halves(hs[i], doc_id, rid, lo, at - lo, text[lo : hi + LENGTH], 0, LENGTH - GRAM)
                else:
                    out.add(hs[i], doc_id, rid, lo, at - lo, text[lo : hi + LENGTH])
            if len(out.kept) >= out.most:
                yield from out.flush()
        yield from out.flush()

    return beside_texts(docs, met, ["pos", "h"]).mapInArrow(cut, CONTEXTS)


def halved(rows: DataFrame) -> DataFrame:
    """Parts of contexts cut into two; marks stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Earliest()
        for batch in batches:
            for h, doc_id, rid, start, left, context, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h is None:
                    out.marks.append((rid, start, end))
                    continue
                out.add_halves(h, doc_id, rid, start, left, context, end >> 7, end & 127)
            if len(out.kept) >= out.most:
                yield from out.flush()
        yield from out.flush()

    return rows.mapInArrow(run, CONTEXTS)


def keys_over(rows: DataFrame, limit: int) -> DataFrame:
    """Those h, as rid, that more than `limit` rows have."""
    return written(rows.where("h is not null").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("h").alias("rid")), "hot")


def told_apart(met: DataFrame, hot: DataFrame) -> DataFrame:
    """Anchors with whether their h is among hot.rid, written in place of met: every anchor meets the list once, whatever is read of them later."""
    keys = hot.select(F.col("rid").alias("h"), F.lit(True).alias("hot"))
    marked = met.join(F.broadcast(keys) if hot.count() <= SENT_IDS else keys, "h", "left").select("rid", "pos", "h", F.coalesce("hot", F.lit(False)).alias("hot"))
    out = written(marked, "apart")
    dropped(met)
    return out


def divided(docs: DataFrame, met: DataFrame, limit: int) -> DataFrame:
    """Contexts of anchors that are in too many of them, by halves of halves, until at most `limit` rows share a key, or all their strings are equal.

    Each round reads only what is still too large. The number of rounds follows from LENGTH and GRAM.
    """
    own = picked(docs, met.select("rid").distinct(), "left_semi")
    now, out = contexts(own, met, halve=True), None
    for _ in range((LENGTH - GRAM).bit_length()):
        now = written(halved(now) if out is not None else now, "halves")
        hot = keys_over(now, limit)
        if hot.isEmpty():
            break
        parts = now.where("h is not null")
        settled = now.where("h is null").unionByName(picked(parts, hot, "left_anti", "h").select(*now.columns))  # marks need no join
        out = settled if out is None else out.unionByName(settled)
        now = picked(parts, hot, "left_semi", "h").select(*now.columns)
    return now if out is None else out.unionByName(now)


def marks(docs: DataFrame, limit: int) -> DataFrame:
    """rid, start, end of all bytes to be removed; spans may overlap."""
    docs = docs.drop("rest")
    whole = written(copies(docs), "copies")
    rest = picked(docs, whole, "left_anti")
    met = meeting_anchors(rest)
    hot = keys_over(met, limit)
    if hot.isEmpty():
        around = contexts(rest, met)
    else:
        met = told_apart(met, hot)
        around = contexts(rest, met.where("not hot").drop("hot")).unionByName(divided(rest, met.where("hot").drop("hot"), limit))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decider = Decider()
        batch_of = lambda *spans: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spans], names=["rid", "start", "end"])
        for batch in batches:
            settled = pc.is_null(batch.column("h"))
            done = batch.filter(settled)
            if done.num_rows:
                yield batch_of(*(done.column(c) for c in ("rid", "start", "end")))
            if done.num_rows < batch.num_rows:
                for spans in decider.add(batch.filter(pc.invert(settled))):
                    yield batch_of(*spans)
        for spans in decider.end():
            yield batch_of(*spans)

    dealt = around.repartition(F.coalesce("h", "rid")).sortWithinPartitions("h", "left", "context", F.asc_nulls_first("doc_id"), "rid", "start")
    found = written(dealt.mapInArrow(decide, "rid long, start long, end long"), "decided")
    dropped(met)
    release(docs.sparkSession)
    return found.unionByName(whole.select("rid", F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))


def cleaned(docs: DataFrame, limit: int = HOT_CONTEXTS) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans, kept (bytes), and rest if docs has it, of docs with rid, doc_id, text."""
    gone = marks(docs, limit)
    with_rest = "rest" in docs.columns
    names = ["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow, held, spans, out, size = zstandard.ZstdDecompressor(), None, [], [], 0

        def done() -> tuple:
            rid, doc_id, z, rest = held
            text, runs, kept, at = grow.decompress(z), merged(spans), [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            return (rid, doc_id, len(text), sum(b - a for a, b in runs), len(runs), b"".join(kept)), rest

        def batch_of() -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(zip(*(row for row, _ in out), strict=True), kinds, strict=True)]
            rest = [pa.concat_arrays([r for _, r in out])] if with_rest else []
            return pa.RecordBatch.from_arrays([*arrays, *rest], names=[*names, *["rest"] * with_rest])

        for batch in batches:
            steps, rids, ids, zs, starts, ends = (batch.column(c) for c in ("step", "rid", "doc_id", "z", "start", "end"))
            starts, ends = starts.to_pylist(), ends.to_pylist()
            for i, step in enumerate(steps.to_pylist()):
                if step:
                    spans.append((starts[i], ends[i]))
                    continue
                if held:
                    out.append(done())
                    size += out[-1][0][2]
                    if size > 4 << 20:
                        yield batch_of()
                        out, size = [], 0
                held, spans = (rids[i].as_py(), ids[i].as_py(), zs[i].as_py(), batch.column("rest").slice(i, 1) if with_rest else None), []
        if held:
            out.append(done())
        if out:
            yield batch_of()

    rest = f", rest {docs.schema['rest'].dataType.simpleString()}" if with_rest else ""
    return beside_texts(docs, gone, ["start", "end"]).mapInArrow(remove, f"rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary{rest}")


def remove_repeats(docs: DataFrame, limit: int = HOT_CONTEXTS) -> DataFrame:
    """What is removed from each whole text, and the SHA-256 of what is kept; a row for each row of docs.

    docs has doc_id and text; other columns are ignored. Texts are UTF-8 bytes, a null text none. A byte is removed if a string of 100
    bytes that covers it also starts earlier: in a row with a smaller doc_id, or earlier in the same row. Null ids are smaller than
    all others; rows with one id are ordered by their places in the files, so a repeated row of 100 bytes or more is removed whole. Texts of
    under 100 bytes are kept. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    return cleaned(with_rid(texts(docs)), limit).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes gone from text; characters that lose some of their bytes go whole. All rows and columns stay.

    A null text stays null; n_chars, if there is such a column, follows a text that changes. The other columns travel with the text.
    """
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(others)], F.col("text").isNull().alias("was_null")).alias("rest")
    brief = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest)

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        return pa.array([b.decode("utf-8", "ignore") for b in column.to_pylist()], pa.string())

    changed = F.col("n_removed") > 0
    out = cleaned(with_rid(brief)).withColumn("new", F.when(~F.col("rest.was_null"), decoded("kept")))
    place = {c: F.col(f"rest.c{k}") for k, c in enumerate(others)} | {"text": F.col("new").cast(docs.schema["text"].dataType)}
    if "n_chars" in place:
        place["n_chars"] = F.when(changed, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(place["n_chars"])
    return out.select(*[place[c].alias(c) for c in docs.columns])
