"""A log-bilinear language model, trained by noise-contrastive estimation in numpy, that scores whole texts.

The OWN most frequent words have vectors of their own. All others share classes by their last two bytes, and a text's start and end have a class
each. The model predicts a token's class from the two classes before it (q = c1 * r(a) + c2 * r(b) by components, score of w = q . r'(w) + b(w)), and a
word within a shared class by its smoothed count there.

Training goes over all tokens of all training documents, in ROUNDS. In a round each task starts from the same parameters and makes steps over
its own tokens in batches, against noise words drawn from the unigram distribution; the tasks' parameters are averaged by their tokens. There are as
many tasks as cores, so what is averaged doesn't grow with the corpus; it is summed in slices, and one set of parameters reaches the driver. Batched
matrix products then give the normaliser of every context once, so the log-probability of a token is exact and normalised.

Counts of the most frequent words, bounded in number, are broadcast; rarer words of a text are joined with their counts by word.
"""

from __future__ import annotations

import ctypes
import math
import os
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import crc_mod, join_counted, ship, texts, with_rid, written

#: Classes: the start of a text, its end, those shared by rare words, and then one for each of the OWN most frequent words.
START, END, SHARED, OWN = 0, 1, 62, 2048
#: Words whose counts are broadcast, at most, each of at most WORD_BYTES bytes. All others are joined.
HEAD_WORDS, WORD_BYTES = 200_000, 40
#: Counts fall into bins, so many a doubling; the words of the highest bins are broadcast.
BINS = 16
#: The end of a text among the counted tokens; no word holds white space.
END_TOKEN = b"\n"
#: Training: length of vectors, noise words a token, noise words drawn for a batch, tokens of a batch, step width, passes over the corpus.
DIM, NOISE, DRAWN, BATCH, RATE, ROUNDS = 32, 10.0, 64, 2048, 0.1, 1
#: Parts in which parameters are summed.
SLICES = 16
#: Words of a task's partial counts before they are handed on, tokens that a task trains on or scores at a time.
FLUSH, HELD = 400_000, 1 << 16


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased, without the end."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shared_class(word: bytes) -> int:
    return 2 + (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % SHARED


def summed_rows(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """An n-row matrix; row i is the sum of those rows whose index is i."""
    out = np.zeros((n, *rows.shape[1:]), rows.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        at = index[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Lbl:
    """Parameters of the model, their training and their normalisers."""

    def __init__(self, unigram: np.ndarray, dim: int = DIM, seed: int = 7):
        """unigram: how often each class occurs in the training documents."""
        k, r = len(unigram), np.random.default_rng(seed)
        self.noise = (unigram + 0.5) / (unigram + 0.5).sum()
        self.r = r.normal(0, 0.1, (k, dim)).astype(np.float32)
        self.q = r.normal(0, 0.1, (k, dim)).astype(np.float32)
        self.c1, self.c2 = np.full(dim, 0.5, np.float32), np.full(dim, 0.5, np.float32)
        self.b = np.log(self.noise).astype(np.float32)

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.r, self.q, self.c1, self.c2, self.b

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> Lbl:
        at = 0
        for p in self.parts:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """What a class adds to q as the word but one, and as the word, before."""
        return self.r * self.c1, self.r * self.c2

    def normalisers(self, at_once: int = 256) -> np.ndarray:
        """log of the sum over all classes but the start, after classes a (row) and b (column).

        A score is a sum of what a, b and the class itself add, so the sum of its exponentials is a product of two matrices of exponentials.
        """
        one, two = (x.astype(np.float64) @ self.q.T for x in self.contexts())
        two += self.b
        two[:, START] = -np.inf  # nothing is followed by a start
        top_one, top_two = one.max(1, keepdims=True), two.max(1)
        after = np.exp(two - top_two[:, None]).T
        out = np.empty((len(one), len(one)), np.float32)
        for at in range(0, len(one), at_once):
            rows = slice(at, at + at_once)
            out[rows] = np.log(np.exp(one[rows] - top_one[rows]) @ after) + top_one[rows] + top_two
        return out


class Trainer:
    """Steps of noise-contrastive estimation over a task's tokens."""

    def __init__(self, model: Lbl, seed: int):
        self.m, self.rng, self.seen = model, np.random.default_rng(seed), 0
        self.slots = [np.full_like(p, 1e-6) for p in model.parts]
        self.cut = np.cumsum(model.noise)
        self.log_noise = np.log(NOISE * model.noise).astype(np.float32)

    def __call__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        """Tokens w after classes a and b, in a random order."""
        order = self.rng.permutation(len(w))
        for at in range(0, len(w), BATCH):
            pick = order[at : at + BATCH]
            self.step(a[pick], b[pick], w[pick])
        self.seen += len(w)

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        m, k = self.m, len(self.m.b)
        drawn = np.minimum(np.searchsorted(self.cut, self.rng.random(DRAWN)), k - 1)
        ra, rb, qw, qn = m.r[a], m.r[b], m.q[w], m.q[drawn]
        h = ra * m.c1 + rb * m.c2
        hit = 1 / (1 + np.exp((h * qw).sum(1) + m.b[w] - self.log_noise[w]))
        miss = -(NOISE / DRAWN) / (1 + np.exp(-(h @ qn.T + m.b[drawn] - self.log_noise[drawn])))
        gh = hit[:, None] * qw + miss @ qn
        gq = summed_rows(w, hit[:, None] * h, k) + summed_rows(drawn, miss.T @ h, k)
        gb = summed_rows(w, hit, k) + summed_rows(drawn, miss.sum(0), k)
        gr = summed_rows(np.concatenate([a, b]), np.concatenate([gh * m.c1, gh * m.c2]), k)
        for p, g, slot in zip(m.parts, (gr, gq, np.einsum("ij,ij->j", ra, gh), np.einsum("ij,ij->j", rb, gh), gb), self.slots, strict=True):
            slot += g * g
            p += np.float32(RATE) * g / np.sqrt(slot)


def token_counts(training: DataFrame) -> DataFrame:
    """word binary, c long over all training documents, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            column = batch.column("text")
            for i in range(len(column)):
                seen.update(tokens(column[i].as_py()))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
            seen[END_TOKEN] += len(column)
        if seen:
            yield rows()

    return training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Counts of the most frequent short words, by descending count: those of the highest bins of counts, `most` at most, and the end's."""
    short = counts.where(F.octet_length("word") <= WORD_BYTES).withColumn("bin", F.floor(F.log2("c") * BINS))
    least, n = None, 0
    for r in sorted(short.groupBy("bin").agg(F.count("*").alias("n")).collect(), reverse=True):  # at most 64 * BINS bins
        if (n := n + r["n"]) > most:
            break
        least = r["bin"]
    wanted = F.col("word") == F.lit(END_TOKEN)
    got = short.where(wanted if least is None else wanted | (F.col("bin") >= least)).select("word", "c").toArrow()
    return dict(sorted(((bytes(w), c) for w, c in zip(got["word"].to_pylist(), got["c"].to_pylist(), strict=True)), key=lambda x: (-x[1], x[0])))


class Vocabulary:
    """Counts and classes of the frequent words."""

    def __init__(self, head: dict[bytes, int], singles: list[bytes]):
        self.index = {w: i for i, w in enumerate(head)}
        self.log_c = np.log10(np.array([*head.values(), 0.0]) + 1)  # the last: a word to be joined
        own = {w: 2 + SHARED + i for i, w in enumerate(singles)}
        self.cls = np.array([own.get(w) or (END if w == END_TOKEN else shared_class(w)) for w in head] + [0], np.int64)
        self.known = np.array([1] * len(head) + [0])
        self.classes = 2 + SHARED + len(singles)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, Counter]:
        """Index of each token (-1: to be joined), its class, and the tokens to be joined with their numbers."""
        ws = tokens(text)
        get = self.index.get
        at = np.array([get(w, -1) for w in ws] + [get(END_TOKEN, -1)], np.int64)
        cls, rare = self.cls[at], Counter()
        cls[-1] = END
        for i in np.flatnonzero(at[:-1] < 0):
            cls[i] = shared_class(ws[i])
            rare[ws[i]] += 1
        return at, cls, rare


@contextmanager
def holding_memory(size: int = 16 << 20) -> Iterator[None]:
    """While a task trains, freed memory stays with it, as each batch asks for the same again; then workers give it back as before (see ship())."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    kinds = {-1: "MALLOC_TRIM_THRESHOLD_", -3: "MALLOC_MMAP_THRESHOLD_"}  # fixed values of the C library
    for kind in kinds if mallopt else ():
        mallopt(kind, size)
    try:
        yield
    finally:
        for kind, name in kinds.items() if mallopt else ():
            mallopt(kind, int(os.environ.get(name, 1 << 17)))


def trained(model: Lbl, training: DataFrame, vocabulary, round_: int) -> Lbl:
    """The model after one more pass over all training documents: the average of what the tasks' steps make of it."""
    spark = training.sparkSession
    sent = spark.sparkContext.broadcast(model)
    cuts = np.linspace(0, len(model.flat()), SLICES + 1).astype(int)
    schema = pa.schema([("slice", pa.int32()), ("tokens", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, own = vocabulary.value, sent.value
        step, held, size = Trainer(Lbl(own.noise).load(own.flat()), 1000 * round_ + TaskContext.get().partitionId()), [], 0
        with holding_memory():
            for batch in batches:
                column = batch.column("text")
                for i in range(len(column)):
                    held.append(np.concatenate([[START, START], v.read(column[i].as_py())[1]]))
                    size += len(held[-1]) - 2
                    if size >= HELD:
                        step(*followed(held))
                        held, size = [], 0
            if held:
                step(*followed(held))
        if step.seen:
            flat = step.m.flat()
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([step.seen] * SLICES, pa.int64()), pa.array([flat[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        weight: Counter = Counter()
        for batch in batches:
            for r in batch.to_pylist():
                sums[r["slice"]] = sums.get(r["slice"], 0) + r["tokens"] * np.frombuffer(r["data"], np.float32).astype(np.float64)
                weight[r["slice"]] += r["tokens"]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([weight[k] for k in sums], pa.int64()), pa.array([(x / weight[k]).tobytes() for k, x in sums.items()], pa.binary())], schema=schema)

    kinds = "slice int, tokens long, data binary"
    own = training.select("text").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, kinds)
    got = sorted(own.repartition(SLICES, "slice").mapInArrow(add, kinds).collect())
    return model.load(np.concatenate([np.frombuffer(r["data"], np.float64) for r in got])) if got else model


def followed(texts_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before the one before, class before, class) of all tokens of texts, each of which begins with two starts."""
    return tuple(np.concatenate([c[k : len(c) - 2 + k] for c in texts_]) for k in range(3))


@dataclass
class Learned:
    """What scoring needs; counts is a table, all else is of bounded size."""

    counts: DataFrame
    total: int
    distinct: int
    vocabulary: Vocabulary
    model: Lbl
    log_z: np.ndarray
    within: np.ndarray


def learn(training: DataFrame, own: int = OWN) -> Learned:
    """Counts of all tokens, and a model trained on all of them."""
    spark = training.sparkSession
    counts = written(token_counts(training), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = frequent(counts, HEAD_WORDS)
    singles = [w for w in head if w != END_TOKEN][:own]
    vocabulary = Vocabulary(head, singles)
    k = vocabulary.classes
    last = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int")
    before = F.when(F.octet_length("word") > 1, F.conv(F.hex(F.expr("substring(word, octet_length(word) - 1, 1)")), 16, 10).cast("int")).otherwise(0)
    n, v = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for r in counts.where(F.col("word") != F.lit(END_TOKEN)).groupBy((2 + (last * 31 + before) % SHARED).alias("cls")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r["cls"]], v[r["cls"]] = r["n"], r["v"]
    for i, w in enumerate(singles):  # they have left their shared classes
        n[shared_class(w)] -= head[w]
        v[shared_class(w)] -= 1
        n[2 + SHARED + i] = head[w]
    within = np.where((np.arange(k) >= 2) & (np.arange(k) < 2 + SHARED), np.log10(n + v + 1.0), 0.0)
    n[END] = head.get(END_TOKEN, 0)
    model, sent = Lbl(n.astype(np.float64)), spark.sparkContext.broadcast(vocabulary)
    for round_ in range(ROUNDS if total else 0):
        model = trained(model, training, sent, round_)
    log_z = model.normalisers()
    return Learned(counts, total, distinct, vocabulary, model, log_z, within)


PARTS = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<struct<word: binary, n: long>>"
RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


def score(docs: DataFrame, mod: int = 7, out: int = 2, own: int = OWN) -> DataFrame:
    """Log-probabilities of all whole texts; a row for each row of docs.

    docs has doc_id and text; other columns are ignored. Learns from rows whose crc32(doc_id as text) mod `mod` isn't `out`. A null
    text is empty: its only token is the end; a null doc_id counts as the empty text in crc32 and stays null. Repeated rows
    count as often as they occur. An empty table gives no rows; without training rows N and V are 0 and
    each token's base probability is 1. Training steps depend on how the corpus is dealt out to tasks, so scores of two runs may differ a little.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = with_rid(texts(docs)).withColumn("held_out", crc_mod("doc_id", mod) == out)
    known = learn(docs.where(~F.col("held_out")), own)
    sent = spark.sparkContext.broadcast((known.vocabulary, known.model, known.log_z, known.within))
    base_of_all = math.log10(known.total + known.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m, log_z, within = sent.value
        one, two = m.contexts()
        for batch in batches:
            column, rows = batch.column("text"), []
            for i in range(len(column)):
                at, cls, rare = v.read(column[i].as_py())
                c = np.concatenate([[START, START], cls])
                model = 0.0
                for x in range(0, len(cls), HELD):
                    a, b, w = (c[x + k : min(x + HELD, len(cls)) + k] for k in range(3))
                    model += float((np.einsum("ij,ij->i", one[a] + two[b], m.q[w]) + m.b[w] - log_z[a, b]).sum(dtype=np.float64)) / math.log(10)
                shared = (cls >= 2) & (cls < 2 + SHARED)
                inner = float((v.log_c[at] - within[cls])[shared].sum())
                rows.append((len(at), int(v.known[at].sum()), float(v.log_c[at].sum() - len(at) * base_of_all), model + inner, [{"word": x, "n": n} for x, n in rare.items()]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), RARE)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare"])

    parts = written(docs.select("rid", "doc_id", "held_out", "text").mapInArrow(run, PARTS), "lm-parts")
    rare = parts.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    met = join_counted(rare, known.counts, "word", "c", known.total, "inner")
    more = met.groupBy("rid").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    return parts.drop("rare").join(more, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
