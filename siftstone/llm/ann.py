"""Approximate nearest neighbours by cross-polytope hashing.

A function rotates unit vectors pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and assigns each to its nearest
signed axis. A table concatenates as many functions as it takes for buckets to be about as many as vectors, so buckets stay small however many
vectors there are. The codes of every vector are computed once and written beside it.

A query probes, over all tables together, the buckets whose axes it is nearest to by the sum of its coordinates after the rotations. All vectors in a
probed bucket are candidates and are ranked by their exact cosine. How many buckets are probed is measured: on a bounded sample of vectors, the
least number that finds TARGET of the true neighbours there; where that is more than MOST_PROBES, a table concatenates a function less, and its
buckets are larger. In a sample of one in f vectors the k/f nearest are about as far away as the k nearest
of all, so those are looked for; where that is less than one, the nearest, which is farther. Every vector is indexed.

Queries are a stated set and go out in blocks of a bounded number of probes, all queries together; each block is one narrow pass over the coded vectors, in which a task
looks up which queries probe its vectors' buckets, compares these pairs, and keeps the k best of each query. Vectors are never shuffled
and pairs are never rows; only the k best of each task and query are merged. A bucket's size doesn't matter, as a bucket is
compared where its vectors lie. Queries that found fewer than k candidates are compared with all vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import dropped, shared_path, ship, written

SCHEMA = "query_id long, vec_id long, score double"
CODED = "vec_id long, embedding array<double>, codes binary"
TABLES = 30
#: Functions that a table concatenates, at most, and the nearest axes of each that probes are made of, by the number of functions.
AXES = {1: 256, 2: 32, 3: 16, 4: 10}
#: Vectors and queries of the sample that the number of probes is measured on, at most; what share of neighbours it is to find; the least number, and steps.
SAMPLE, SAMPLE_QUERIES, TARGET, LEAST_PROBES, GROWTH = 8000, 200, 0.92, 60, 1.15
#: Probes of a query, beyond which a table has a function less; probes of a block, and numbers of its or the sample's vectors, at most (driver's memory).
MOST_PROBES, ENTRIES, NUMBERS = 4096, 1 << 21, 1 << 21
#: Queries of a block, vectors that are looked up and pairs that are compared at once.
BLOCK, STEP, PAIRS = 4096, 1024, 1 << 15


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """Tables of concatenated pseudo-rotations for vectors of one dimension."""

    def __init__(self, dim: int, functions: int = 1, tables: int = TABLES, seed: int = 11):
        self.dim, self.width, self.functions, self.tables = dim, 1 << max(0, (dim - 1).bit_length()), functions, tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables * functions, 3, self.width))

    @classmethod
    def of(cls, dim: int, rows: int) -> CrossPolytope:
        """With about as many buckets in a table as there are rows."""
        axes = 2 << max(0, (dim - 1).bit_length())
        return cls(dim, min(max(AXES), max(1, round(math.log(max(2, rows)) / math.log(axes)))))

    @property
    def axes(self) -> int:
        return 2 * self.width

    @property
    def few(self) -> int:
        """The nearest axes of a function that probes are made of: all of them, where a table has one function."""
        return self.axes if self.functions == 1 else min(AXES[self.functions], self.axes)

    def rotated(self, x: np.ndarray, function: int) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, : self.dim] = x
        for s in self.signs[function]:
            out = hadamard(out * s)
        return out

    def nearest(self, x: np.ndarray, function: int) -> np.ndarray:
        """The nearest signed axis: axis, plus width if the coordinate is negative."""
        r = self.rotated(x, function)
        axis = np.abs(r).argmax(1)
        return axis + self.width * (r[np.arange(len(r)), axis] < 0)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for f in range(self.functions):
                out[:, t] = out[:, t] * self.axes + self.nearest(x, t * self.functions + f)
        return out

    def probes(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(table, bucket) of the n nearest buckets of each row over all tables."""
        few = self.few
        tables, buckets, sums = [], [], []
        for t in range(self.tables):
            near, bucket = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for f in range(self.functions):
                r = self.rotated(x, t * self.functions + f)
                both = np.concatenate([r, -r], 1)
                best = np.argpartition(-both, few - 1, 1)[:, :few]
                near = (near[:, :, None] + np.take_along_axis(both, best, 1)[:, None, :]).reshape(len(x), -1)
                bucket = (bucket[:, :, None] * self.axes + best[:, None, :]).reshape(len(x), -1)
            if near.shape[1] > n:  # no more of one table can be among the n nearest
                best = np.argpartition(-near, n - 1, 1)[:, :n]
                near, bucket = np.take_along_axis(near, best, 1), np.take_along_axis(bucket, best, 1)
            tables.append(np.full(near.shape, t))
            buckets.append(bucket)
            sums.append(near)
        table, bucket, near = (np.concatenate(c, 1) for c in (tables, buckets, sums))
        best = np.argpartition(-near, n - 1, 1)[:, :n] if near.shape[1] > n else np.tile(np.arange(near.shape[1]), (len(x), 1))
        return np.take_along_axis(table, best, 1), np.take_along_axis(bucket, best, 1)


class Probed:
    """Which queries of a block probe a bucket; without hashes, all probe every one."""

    def __init__(self, hashes: CrossPolytope | None, unit: np.ndarray, n: int):
        self.queries, self.keys = len(unit), None
        if hashes is None:
            return
        self.span = hashes.axes**hashes.functions
        keys, owners = [], []
        some = max(1, (1 << 21) // (hashes.tables * hashes.few**hashes.functions))  # queries at a time, as memory allows
        for at in range(0, len(unit), some):
            table, bucket = hashes.probes(unit[at : at + some], n)
            keys.append((table * self.span + bucket).ravel())
            owners.append(np.repeat(np.arange(at, at + len(table), dtype=np.int32), table.shape[1]))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.owners = owners[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """queries x rows: whether a query probes a bucket of a row."""
        if self.keys is None:
            return np.ones((self.queries, len(codes)), bool)
        seen = np.zeros((self.queries, len(codes)), bool)
        for t in range(codes.shape[1]):
            key = t * self.span + codes[:, t]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            row = np.flatnonzero(self.keys[at] == key)
            begin, size = self.first[at[row]], self.first[at[row] + 1] - self.first[at[row]]
            ends = np.cumsum(size)
            place = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            seen[self.owners[place], np.repeat(row, size)] = True
        return seen


def measured(hashes: CrossPolytope, x: np.ndarray, k: int, rows: int) -> int:
    """The least number of probes that finds TARGET of what stands in a sample of `rows` vectors for the k nearest."""
    k = max(1, round(k * len(x) / rows))
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    some = np.linspace(0, len(x) - 1, min(SAMPLE_QUERIES, len(x))).astype(int)
    near = unit[some] @ unit.T
    near[np.arange(len(some)), some] = -np.inf
    top = np.argsort(-near, 1)[:, : min(k, len(x) - 1)]
    codes, most, n = hashes.codes(unit), hashes.tables * hashes.few**hashes.functions, LEAST_PROBES

    def found(n: int) -> float:
        part = max(1, ENTRIES // n)  # queries at a time
        seen = (Probed(hashes, unit[some[at : at + part]], n).candidates(codes) for at in range(0, len(some), part))
        return np.take_along_axis(np.concatenate(list(seen)), top, 1).mean()

    if hashes.functions > 1 and top.size and found(MOST_PROBES) < TARGET:
        return MOST_PROBES + 1
    while n < most and top.size:
        if found(n) >= TARGET:
            break
        n = int(n * GROWTH) + 1
    return n


def fitted(x: np.ndarray, dim: int, k: int, rows: int) -> tuple[CrossPolytope, int]:
    """Hashes for `rows` vectors, and the number of probes measured on the sample x of them; as many functions as reach TARGET with MOST_PROBES."""
    hashes = CrossPolytope.of(dim, rows)
    while (probes := measured(hashes, x, k, rows) if len(x) else LEAST_PROBES) > MOST_PROBES and hashes.functions > 1:
        hashes = CrossPolytope(dim, hashes.functions - 1)
    return hashes, probes


class Best:
    """The k best distinct vectors of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.q, self.v, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        q, v, s = np.concatenate([self.q, q]), np.concatenate([self.v, v]), np.concatenate([self.s, s])
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        # of rows with the same query and vector the best stays
        pair = np.lexsort((-s, v, q))
        first = np.ones(len(q), bool)
        first[1:] = (q[pair][1:] != q[pair][:-1]) | (v[pair][1:] != v[pair][:-1])
        keep = np.zeros(len(q), bool)
        keep[pair[first]] = True
        q, v, s = q[keep], v[keep], s[keep]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.q, self.v, self.s = q[top], v[top], s[top]
        last = rank == self.k - 1
        self.least[q[last]] = s[last]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    largest = np.abs(x).max(1, keepdims=True, initial=1e-300)
    return np.where((largest > 1e-100) & (largest < 1e100), x, x / largest)  # squares must neither overflow nor vanish


def lengths(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(1))


def cosines(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """Cosines of rows; the same two vectors give the same number wherever they stand."""
    return (a * b).sum(1) / (a_lengths * b_lengths)


def coded(vectors: DataFrame, hashes: CrossPolytope) -> DataFrame:
    """Vectors with their buckets, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"), hashes.dim)
            codes = hashes.codes(x / np.sqrt((x * x).sum(1))[:, None]).astype(np.int64 if hashes.axes**hashes.functions >= 1 << 31 else np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "embedding", "codes"])

    return written(vectors.mapInArrow(run, CODED), "codes")


def one_pass(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, hashes: CrossPolytope | None, probes: int) -> DataFrame:
    """The k best of a block of queries, written; without hashes every vector is a candidate."""
    dim, long = queries.shape[1], lengths(queries)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, queries, Probed(hashes, queries / long[:, None], probes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, probed = sent.value
        best, long = Best(len(ids), k), lengths(queries)
        for batch in batches:
            all_ids, all_x, all_codes = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"), dim), batch.column("codes").to_pylist()
            for at in range(0, len(all_ids), STEP):
                own, x = all_ids[at : at + STEP], all_x[at : at + STEP]
                codes = np.frombuffer(b"".join(all_codes[at : at + STEP]), np.int64 if len(all_codes[0]) == 8 * TABLES else np.int32).reshape(len(own), -1)
                seen, x_long = probed.candidates(codes), lengths(x)
                seen &= ids[:, None] != own[None, :]
                i, j = np.nonzero(seen)
                found = []
                for part in range(0, len(i), PAIRS):
                    q, v = i[part : part + PAIRS], j[part : part + PAIRS]
                    score = cosines(queries[q], x[v], long[q], x_long[v])
                    good = score >= best.least[q]
                    found.append((q[good], own[v[good]], score[good]))
                if found:
                    best.add(*(np.concatenate(c) for c in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.v), pa.array(best.s)], names=["query_id", "vec_id", "score"])

    found = written(merged(vectors.mapInArrow(run, SCHEMA), k), "found")
    sent.destroy()
    return found


def merged(found: DataFrame, k: int) -> DataFrame:
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return distinct.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, list]]:
    """Queries by ascending vec_id, a bounded number at a time; of several rows of one id the smallest vector."""
    last = None
    distinct = written(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    while True:
        rest = distinct if last is None else distinct.where(F.col("vec_id") > last)
        got = rest.orderBy("vec_id").limit(block).toArrow()
        if got.num_rows:
            ids = got["vec_id"].combine_chunks()
            last = ids[-1].as_py()
            yield ids.to_numpy(), got["embedding"].combine_chunks()
        if got.num_rows < block:
            dropped(distinct)
            return


def search(vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The k nearest vectors found of every row whose vec_id is divisible by `every`.

    vectors has vec_id and embedding; other columns are ignored. Rows with a null id, or whose vector is null, empty,
    zero or holds null or non-finite components take no part. Vectors of different lengths aren't compared. A query's own id is no candidate. Of
    repeated ids a query is the smallest vector, and a candidate is the one nearest to the query. Ties go to the smaller vec_id. A query
    with fewer than k candidates gets them all; one without any, and an empty table, give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors, path, any_ = usable(vectors), shared_path(spark, "neighbours"), False
    for dim, rows in sorted(tuple(r) for r in vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()):
        own = vectors.where(F.size("embedding") == dim)
        most = max(1, min(SAMPLE, NUMBERS // dim))
        one_in = max(1, -(-rows // most))
        sample = own.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(one_in)) == 0).orderBy("vec_id", "embedding").select("embedding").limit(2 * most).toArrow()["embedding"].combine_chunks()
        hashes, probes = fitted(matrix(sample, dim), dim, k, rows)
        same = coded(own, hashes)
        for ids, column in blocks(same.where(F.col("vec_id") % every == 0), max(1, min(block, ENTRIES // probes, NUMBERS // dim))):
            x = matrix(column, dim)
            found = one_pass(same, ids, x, k, hashes, probes)
            short = {r["query_id"]: r["n"] for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()}  # block rows at most
            few = np.array([short.get(i, 0) < k for i in ids.tolist()])
            out, again = found, None
            if few.any():
                again = one_pass(same, ids[few], x[few], k, None, 0)
                out = found.join(F.broadcast(again.select("query_id").distinct()), "query_id", "left_anti").unionByName(again)
            out.write.mode("append").parquet(path)
            for done in filter(None, (found, again)):
                dropped(done)
            any_ = True
    if not any_:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return spark.read.schema("query_id long, vec_id long, score double, rank int").parquet(path).select("query_id", "rank", "vec_id", "score")
