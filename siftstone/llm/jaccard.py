"""Join of documents by the Jaccard similarity of their word 5-grams, with Bayesian pruning of candidates.

Documents with equal sets of 5-grams are collapsed into classes. MinHash values of the classes are grouped into bands;
classes that agree in a band meet. There, pairs are compared some MinHash values at a time: with a uniform prior, the
similarity given m agreements among n values has a Beta posterior, and a pair goes as soon as its probability of reaching
the threshold falls below a tolerance. What remains links classes to groups. Within a group pairs are compared in the same way, and
only those that no step drops are verified exactly, by what their sets have in common: many pairs of the same sets by products of their 0/1
matrices, few ones each by itself. A pair is never a row; a task passes on only link counts and a spanning forest of the links.

A large bucket or group is cut into blocks. A row goes to its own block only; blocks are files of a written table, and a task that
compares a block with others reads theirs. It passes on a count for each row of its own block, and of the links between blocks no more than a
forest of what is joined within them. In a bucket, what is joined already isn't compared again.

Bands miss a pair of similarity 0.8 with probability 3e-6, the tolerance at most another 5e-6. 5-grams are 64-bit hashes of
their words' hashes, so "exactly" means up to a collision of these. What n different texts of one group cost is of the order of n * n
comparisons, as links are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import TABLES, join_counted, only, picked, shared_path, ship, texts, with_rid, written
from siftstone.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
#: MinHash values compared at a time, and the least posterior probability of reaching the threshold.
STEP, TOLERANCE = 32, 1e-6
#: Members of a block of a bucket and of a group, about, and bytes of 5-grams of a block of a group.
BUCKET_BLOCK, GROUP_BLOCK, GROUP_BYTES = 2048, 512, 4 << 20
#: Blocks that a task compares its own block with, at most.
STRIDE = 256
#: Pairs whose MinHash values are compared at a time.
PAIRS = 1 << 18
#: Words whose hashes a worker keeps.
WORDS_KEPT = 200_000
#: Columns of a 0/1 matrix at a time.
COLUMNS = 8192
_r = np.random.default_rng(5)
FACTORS = _r.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _r.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """64-bit hashes of the word 5-grams of texts; keeps the hashes of words it has met."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: str) -> np.ndarray:
        """Ascending distinct hashes; a shorter text than 5 words has one, of all its words; one without words none."""
        ws = text.lower().split()
        if not ws:
            return np.zeros(0, np.uint64)
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        known, hashes = self.known, []
        for w in ws:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        n, size = max(1, len(h) - self.size + 1), min(self.size, len(h))
        out = np.full(n, size, np.uint64)
        for i in range(size):
            out = (out ^ h[i : i + n]) * MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minhash(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS values of 16 bits."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(least, (s[at : at + 1024, None] * FACTORS + OFFSETS).min(0), out=least)
    return ((least * MIX) >> np.uint64(48)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    out = np.zeros((len(signatures), BANDS), np.uint64)
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out += np.arange(BANDS, dtype=np.uint64) * MIX
    for i in range(ROWS):
        out = (out ^ rows[:, :, i]) * MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def least_matches(steps: int = BANDS * ROWS // STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each step, how many agreements keep a pair.

    With a uniform prior, P(similarity >= t | m of n agree) is the probability that at most m of n + 1 trials of
    chance t succeed.
    """
    out = []
    for n in range(STEP, STEP * steps + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j weren't joined before."""
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def joined(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Join pairs; gives those that weren't joined before."""
        return [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if self.join(a, b)]

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def likely(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int], once: bool = True, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of left x right rows that no step drops: with `once` those with i < j only; with `label` only such of different labels."""
    at_once = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), at_once):
        i, j = (x.ravel() for x in np.meshgrid(left[at : at + at_once], right, indexing="ij"))
        keep = i < j if once else i != j
        if label is not None:
            keep &= label[i] != label[j]
        i, j = i[keep], j[keep]
        agree = np.zeros(len(i), np.int32)
        for step, m in enumerate(least):
            part = signatures[:, step * STEP : (step + 1) * STEP]
            for a in range(0, len(i), 1 << 16):
                agree[a : a + (1 << 16)] += (part[i[a : a + (1 << 16)]] == part[j[a : a + (1 << 16)]]).sum(1, dtype=np.int32)
            keep = agree >= m
            i, j, agree = i[keep], j[keep], agree[keep]
        if len(i):
            yield i, j


def united(signatures: np.ndarray, least: list[int]) -> Forest:
    """Joins all rows of which some pair isn't dropped; what is joined with the first row is compared with the others only."""
    n = len(signatures)
    forest, every = Forest(n), np.arange(n)
    for pairs in likely(signatures, every[:1], every, least):
        forest.joined(*pairs)
    label = forest.roots()
    if label.any():
        for pairs in likely(signatures, every, every, least, label=label):
            forest.joined(*pairs)
    return forest


def crossing(signatures: np.ndarray, label: np.ndarray, n: int, least: list[int]) -> list[tuple[int, int]]:
    """Links that join the first n rows with the others, where label says what is joined within either; first by rows that stand for many."""
    forest, every = Forest(len(label)), np.arange(len(label))
    forest.joined(every, label)
    heads = np.flatnonzero(label == every)
    out = []
    for pairs in likely(signatures, heads[heads < n], heads[heads >= n], least):
        out += forest.joined(*pairs)
    now = forest.roots()
    if (now != now[0]).any():
        for pairs in likely(signatures, every[:n], every[n:], least, label=now):
            out += forest.joined(*pairs)
    return out


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements sets have in common, of left x right, as a product of 0/1 matrices."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    owner, column, width = owner[shared], number[column[shared]], int((times > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    in_left, in_right = np.full(len(sets), -1), np.full(len(sets), -1)
    in_left[left], in_right[right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        o, c, w = owner[lo:hi], column[lo:hi] - at, min(COLUMNS, width - at)
        x, y = np.zeros((len(left), w), np.float32), np.zeros((len(right), w), np.float32)
        a, b = in_left[o], in_right[o]
        x[a[a >= 0], c[a >= 0]] = 1
        y[b[b >= 0], c[b >= 0]] = 1
        both += x @ y.T
    return both


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two ascending sets share."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose Jaccard similarity is at least threshold."""
    left, a = np.unique(i, return_inverse=True)
    right, b = np.unique(j, return_inverse=True)
    if len(i) * 8 >= len(left) * len(right):
        used = np.union1d(left, right)
        place = lambda x: np.searchsorted(used, x)
        both = intersections([sets[k] for k in used], place(left), place(right))[a, b]
    else:
        both = np.array([in_common(sets[x], sets[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    sizes = np.array([len(s) for s in sets])
    keep = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-6
    return i[keep], j[keep]


def similar(signatures: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of left x right that aren't dropped and are verified."""
    for pairs in likely(signatures, left, right, least):
        found = verified(sets, *pairs)
        if len(found[0]):
            yield found


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys; rows come sorted, a run is bounded by the blocks."""
    run: list[dict] = []
    last = None
    for batch in batches:
        for r in batch.to_pylist():
            key = tuple(r[k] for k in keys)
            if key != last and run:
                yield run
                run = []
            last = key
            run.append(r)
    if run:
        yield run


def own_block(member: str) -> Column:
    """The block of its group, of `blocks` ones, that a row belongs to."""
    return F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")


class Blocks:
    """Blocks of large groups as files in the shared folder, read by the tasks that compare them."""

    def __init__(self, rows: DataFrame, name: str):
        """rows: group, own, cid, columns that are kept."""
        self.path = shared_path(rows.sparkSession, name)
        rows.repartition("group", "own").sortWithinPartitions("group", "own", "cid").write.option("compression", "zstd").partitionBy("group", "own").parquet(self.path)

    def read(self, group: int, own: int) -> pa.Table | None:
        source, root = fs.FileSystem.from_uri(self.path)
        at = f"{root}/group={group}/own={own}"
        if source.get_file_info(at).type == fs.FileType.NotFound:  # no row fell into it
            return None
        files = [f.path for f in source.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet")]
        return pa.concat_tables([pq.ParquetFile(source.open_input_file(f)).read() for f in sorted(files)]).combine_chunks()

    @staticmethod
    def tasks(rows: DataFrame) -> DataFrame:
        """group, own, blocks, from: each block with each stretch of the blocks of its group."""
        groups = rows.groupBy("group").agg(F.max("blocks").alias("blocks"))
        own = groups.select("group", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
        return own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(STRIDE))).alias("from")).repartition("group", "own", "from")


def signatures_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def record_batches(rows: Iterator[tuple], schema: pa.Schema, most: int, payload: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most `most` rows, or of about GROUP_BYTES in the payload column."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[payload] or b"") if payload is not None else 0
        if len(out) >= most or size > GROUP_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def schema_of(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in text.split(", "))])


def sketches(docs: DataFrame) -> DataFrame:
    """rid, doc_id, key of the set of 5-grams (of texts without words: one of their own), its size, MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            column, rids = batch.column("text"), batch.column("rid").to_pylist()
            keys, sizes, signatures = [], [], []
            for i, rid in enumerate(rids):
                s = shingles(column[i].as_py())
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"row" + rid.to_bytes(8, "big"))
                sizes.append(len(s))
                signatures.append(minhash(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], names=["rid", "doc_id", "key", "size", "signature"])

    return docs.mapInArrow(run, "rid long, doc_id long, key binary, size long, signature binary")


#: A member of a bucket: with the one that stands for what it is joined with in its block; the signature only of large buckets.
BUCKETS = "group long, own int, blocks int, cid long, label long, signature binary"


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that join all classes of which some pair in a bucket isn't dropped."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(signatures_of(batch.column("signature").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("cid").to_numpy(), BANDS))], names=["band", "cid"])

    rows = classes.where("size > 0").select("cid", "signature").mapInArrow(bands, "band long, cid long")
    buckets = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = join_counted(rows, buckets, "band", "n", classes.count() * BANDS, "inner")
    met = met.select(F.col("band").alias("group"), F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks"), "cid").withColumn("own", own_block("cid"))
    met = met.join(classes.select("cid", "signature"), "cid")
    least, schema = least_matches(), schema_of(BUCKETS)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for run in grouped(batches, ["group", "own"]):
                large = run[0]["blocks"] > 1
                if len(run) > 1 or large:
                    roots = united(signatures_of([r["signature"] for r in run]), least).roots()
                    for k, (r, root) in enumerate(zip(run, roots.tolist(), strict=True)):
                        if large or k != root:
                            yield r["group"], r["own"], r["blocks"], r["cid"], run[root]["cid"], r["signature"] if large else None

        yield from record_batches(rows(), schema, 20_000)

    inner = written(met.repartition("group", "own").sortWithinPartitions("group", "own", "cid").mapInArrow(unite, BUCKETS), "buckets")
    links = inner.where("label != cid").select(F.col("cid").alias("a"), F.col("label").alias("b"))
    large = inner.where("blocks > 1")
    if large.isEmpty():
        return links
    blocks = Blocks(large.drop("blocks"), "bucket-blocks")
    between = schema_of("a long, b long")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group, own, n_blocks, at in (tuple(r.values()) for batch in batches for r in batch.to_pylist()):
                mine = blocks.read(group, own)
                for other in range(max(at, own + 1), min(at + STRIDE, n_blocks)) if mine else ():
                    theirs = blocks.read(group, other)
                    if theirs:
                        both = pa.concat_tables([mine, theirs])
                        cids = both["cid"].to_numpy()
                        order = np.argsort(cids)
                        label = order[np.searchsorted(cids, both["label"].to_numpy(), sorter=order)]
                        for i, j in crossing(signatures_of(both["signature"].to_pylist()), label, len(mine), least):
                            yield int(cids[i]), int(cids[j])

        yield from record_batches(rows(), between, 20_000)

    return links.unionByName(Blocks.tasks(large).select("group", "own", "blocks", "from").mapInArrow(cross, "a long, b long"))


#: A member of a group: links that it has within its block, the one that stands for what it is linked with there; sets only of large groups.
MEMBERS = "group long, own int, blocks int, cid long, copies long, links long, label long, signature binary, shingles binary"


def verified_links(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """cid, links (documents linked to it, of other classes), other (a link of a spanning forest, or null)."""
    members = written(groups.withColumnRenamed("node", "cid").join(classes.select("cid", "copies", "size", "signature"), "cid"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), (F.sum("size") * 8).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / GROUP_BLOCK), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int")
    placed = join_counted(members.select("cid", "root", "copies", "signature"), sizes, "root", "n", members.count(), "inner").withColumn("blocks", blocks).drop("n", "bytes")
    placed = placed.withColumnRenamed("root", "group").withColumn("own", own_block("cid"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            column = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([shingles(column[i].as_py()).tobytes() for i in range(len(column))], pa.binary())], names=["cid", "shingles"])

    rows = placed.join(picked(docs.select("rid", "text"), members.select(F.col("cid").alias("rid")), "left_semi").mapInArrow(sets, "cid long, shingles binary"), "cid")
    least, schema = least_matches(), schema_of(MEMBERS)
    set_of = lambda data: np.frombuffer(data, np.uint64)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for run in grouped(batches, ["group", "own"]):
                n, large = len(run), run[0]["blocks"] > 1
                copies, links, forest, every = np.array([r["copies"] for r in run]), np.zeros(n, np.int64), Forest(n), np.arange(n)
                for i, j in similar(signatures_of([r["signature"] for r in run]), [set_of(r["shingles"]) for r in run], every, every, least) if n > 1 else ():
                    links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
                    forest.joined(i, j)
                roots = forest.roots().tolist()
                for k, r in enumerate(run):
                    if large or links[k]:
                        yield r["group"], r["own"], r["blocks"], r["cid"], r["copies"], int(links[k]), run[roots[k]]["cid"], *((r["signature"], r["shingles"]) if large else (None, None))

        yield from record_batches(rows(), schema, 20_000, 8)

    inner = written(rows.repartition("group", "own").sortWithinPartitions("group", "own", "cid").mapInArrow(verify, MEMBERS), "verified")
    found = inner.select("cid", "links", F.when(F.col("label") != F.col("cid"), F.col("label")).alias("other"))
    large = inner.where("blocks > 1")
    if large.isEmpty():
        return found
    blocks = Blocks(large.drop("blocks", "links"), "group-blocks")
    between = schema_of("cid long, links long, other long")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group, own, n_blocks, at in (tuple(r.values()) for batch in batches for r in batch.to_pylist()):
                mine = blocks.read(group, own)
                n = len(mine) if mine else 0
                links = np.zeros(n, np.int64)
                for other in (k for k in range(at, min(at + STRIDE, n_blocks)) if k != own) if n else ():
                    theirs = blocks.read(group, other)
                    if not theirs:
                        continue
                    both = pa.concat_tables([mine, theirs])
                    cids, copies = both["cid"].to_numpy(), both["copies"].to_numpy()
                    order, forest, every = np.argsort(cids), Forest(len(cids)), np.arange(len(cids))
                    forest.joined(every, order[np.searchsorted(cids, both["label"].to_numpy(), sorter=order)])
                    for i, j in similar(signatures_of(both["signature"].to_pylist()), [set_of(x) for x in both["shingles"].to_pylist()], every[:n], every[n:], least):
                        links += np.bincount(i, copies[j], n).astype(np.int64)
                        for a, b in forest.joined(i, j) if other > own else ():
                            yield int(cids[a]), 0, int(cids[b])
                for k in np.flatnonzero(links).tolist():
                    yield mine["cid"][k].as_py(), int(links[k]), None

        yield from record_batches(rows(), between, 20_000)

    return found.unionByName(Blocks.tasks(large).select("group", "own", "blocks", "from").mapInArrow(cross, "cid long, links long, other long"))


def classes_of(docs: DataFrame) -> DataFrame:
    """rid, doc_id, class_id, keeper (row id that stays of the class), n_links of docs with rid, doc_id, text."""
    rows = written(sketches(docs), "sketches")
    first = F.min(F.struct("doc_id", "rid")).alias("first")
    classes = written(rows.groupBy("key").agg(first, F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")).select("key", F.col("first.rid").alias("cid"), F.col("first.doc_id").alias("doc_id"), "copies", "size", "signature"), "classes")
    found = written(verified_links(docs, classes, components(candidate_links(classes))), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    brief = classes.select("key", "cid", "doc_id", "copies")
    linked = brief.join(roots.withColumnRenamed("node", "cid"), "cid")
    heads = linked.groupBy("root").agg(F.min(F.struct("doc_id", F.col("cid").alias("rid"))).alias("head"), F.count("*").alias("members"))
    named = join_counted(linked.select("cid", "root"), heads, "root", "members", linked.count(), "inner").join(links, "cid", "left").select("cid", "head", "links")
    whole = brief.join(named, "cid", "left").select("key", "copies", F.coalesce("head", F.struct("doc_id", F.col("cid").alias("rid"))).alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = join_counted(rows.select("rid", "doc_id", "key"), whole, "key", "copies", rows.count(), "inner")
    return out.select("rid", "doc_id", F.col("head.doc_id").alias("class_id"), F.col("head.rid").alias("keeper"), "n_links")


def join(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes and links of all documents; a row for each row of docs.

    docs has doc_id and text; other columns are ignored. Two documents are linked if the Jaccard similarity of their sets of
    5 consecutive words (lower case, split at white space; of a shorter text all its words) is at least 0.8. class_id is the
    smallest doc_id that links lead to; n_links counts the other rows linked to this one, copies included. Documents without words
    (null, empty, blank texts) have no links. Repeated rows are copies. Null doc_ids are smaller than all others. An
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    return classes_of(with_rid(texts(docs))).select("doc_id", "class_id", "n_links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates: of each class that with the smallest doc_id; all columns are kept."""
    ship(docs.sparkSession)
    whole = with_rid(docs, "__rid")
    brief = whole.select(F.col("__rid").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    since = len(TABLES)
    gone = only(classes_of(brief).where("rid != keeper").select("rid"), since)
    return picked(whole, gone, "left_anti", "__rid").drop("__rid")
