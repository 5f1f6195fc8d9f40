"""Toxicity by two class-conditional Kneser-Ney models.

One model is learnt from toxic, one from ordinary labelled documents. Both are over the bytes of words, ORDER bytes at a time, so that a
word stem counts in every inflection. The highest order holds each class's own counts with an absolute discount; what is
discounted goes to lower orders of continuation counts that both classes share, so a rare expression moves the
comparison little. A word's evidence is the difference of its two log-likelihoods. A language or a topic that is more frequent in one class moves all words of a text
alike, so evidence counts by how far it exceeds that of the text's median word, and noise of less than MARGIN counts as none. A document's evidence is
the sum of this normalised by its length, beside the plain evidence of its most toxic passage of one and of three words; a small logistic function
of these, fitted on labelled documents that the models have not seen, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import crc_mod, ship, texts

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
#: Labelled documents of each class that are learnt from, at most; those with the smallest hashes of doc_id are taken.
SAMPLE = 6000
#: Bytes of an n-gram (8 fit a machine word) and the orders of the shared backoff.
ORDER, SHARED_ORDERS = 8, (5, 3, 2)
DISCOUNT = 0.75
#: Log-likelihood ratio beyond the text's median from which on a word counts.
MARGIN = 1.0
#: Of the sample, one document in so many is kept from the models and fits the logistic function.
FIT_ONE_IN = 3
THRESHOLD = 0.3
#: Words whose evidence a worker keeps.
CACHE = 250_000

#: Bytes that are in no word become spaces: ASCII but for digits and letters.
WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def windows(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER bytes that end at each byte of each word, packed into 64 bits, and the word each belongs to.

    A word is preceded by zeros and followed by a space.
    """
    flat = np.frombuffer(b"".join(w + b" " for w in ws), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in ws])
    owner = np.repeat(np.arange(len(ws)), np.diff(ends, prepend=0))
    place = np.arange(len(flat)) - (ends - np.diff(ends, prepend=0))[owner]
    key = np.zeros(len(flat), np.uint64)
    for back in range(min(ORDER, len(flat))):
        moved = np.zeros(len(flat), np.uint64)
        moved[back:] = flat[: len(flat) - back]
        moved[place < back] = 0
        key |= moved << np.uint64(8 * back)
    return key, owner


def lower(key: np.ndarray, order: int) -> np.ndarray:
    return key & np.uint64((1 << (8 * order)) - 1) if order < 8 else key


class Table:
    """Values by 64-bit key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """A row of values for each key; zeros for unknown ones."""
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys)[:, None], self.values[at], np.float32(0))


def summed(keys: np.ndarray, values: np.ndarray) -> Table:
    unique, at = np.unique(keys, return_inverse=True)
    return Table(unique, np.stack([np.bincount(at, v, len(unique)) for v in values.T], 1).astype(np.float32))


class KneserNey:
    """Both classes' models; counts are numbers of documents that hold a word."""

    def __init__(self, ws: list[bytes], toxic: np.ndarray, ordinary: np.ndarray):
        key, owner = windows(ws) if ws else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        n = np.stack([toxic, ordinary], 1).astype(np.float64)[owner]
        self.grams = summed(key, n)
        g = self.grams
        # of a context, for each class: how often it occurs, and after how many grams
        self.contexts = summed(g.keys >> np.uint64(8), np.concatenate([g.values, g.values > 0], 1))
        # shared continuation counts: of a shorter gram, how many different bytes precede it in either class
        self.shared = []
        for order in SHARED_ORDERS:
            longer = np.unique(lower(g.keys, order + 1))
            grams = summed(lower(longer, order), np.ones((len(longer), 1)))
            contexts = summed(grams.keys >> np.uint64(8), np.concatenate([grams.values, grams.values > 0], 1))
            self.shared.append((order, grams, contexts))

    def backoff(self, key: np.ndarray) -> np.ndarray:
        p = np.full(len(key), 1 / 256)
        for order, grams, contexts in reversed(self.shared):
            k = lower(key, order)
            c, h = grams(k)[:, 0], contexts(k >> np.uint64(8))
            seen = h[:, 0] > 0
            p = np.where(seen, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * h[:, 1] * p) / np.maximum(h[:, 0], 1), p)
        return p

    def evidence(self, ws: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not ws:
            return np.zeros(0)
        key, owner = windows(ws)
        n, h, p = self.grams(key), self.contexts(key >> np.uint64(8)), self.backoff(key)
        logs = []
        for c in (0, 1):
            own = (np.maximum(n[:, c] - DISCOUNT, 0) + DISCOUNT * h[:, 2 + c] * p) / np.maximum(h[:, c], 1)
            logs.append(np.log(np.where(h[:, c] > 0, own, p)))
        return np.bincount(owner, logs[0] - logs[1], len(ws))


class Scorer:
    """Scores texts with a model and the logistic function's weights; keeps the evidence of words it has met."""

    def __init__(self, model: KneserNey, weights: np.ndarray | None):
        self.model, self.weights, self.known = model, weights, {}

    def features(self, batch: list[str]) -> np.ndarray:
        """Of each text: 1, log-likelihood ratio a word beyond median and margin, ratio of the most toxic three words and word."""
        read = [words(t) for t in batch]
        if len(self.known) > CACHE:
            self.known = {}
        new = list({w for ws in read for w in ws if w not in self.known})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.known |= dict(zip(part, self.model.evidence(part).tolist(), strict=True))
        out = np.zeros((len(batch), 4))
        out[:, 0] = 1
        for row, ws in zip(out, read, strict=True):
            if ws:
                e = np.array([self.known[w] for w in ws])
                k = min(3, len(e))
                row[1:] = np.maximum(e - np.median(e) - MARGIN, 0).mean(), np.partition(e, len(e) - k)[-k:].mean(), e.max()
        return out

    def __call__(self, batch: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(batch))
        return 1 / (1 + np.exp(-np.clip(self.features(batch) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (y - p)) - ridge * w
        h = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def learn(docs: DataFrame, labels: DataFrame, mod: int, out: int, sample: int = SAMPLE) -> Scorer:
    """Fit the models on a bounded sample of labelled rows; only counts and features reach the driver."""
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isin(0, 1) & (crc_mod("doc_id", mod) != out)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    numbers = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(numbers) < 2:
        return Scorer(KneserNey([], np.zeros(0), np.zeros(0)), None)
    chosen = None
    for toxic in (0, 1):
        part = marked.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumn("fits", F.pmod(F.xxhash64("doc_id"), F.lit(101)) % FIT_ONE_IN == 0)
    # of several rows of one id the smallest text, so 2 * sample rows at most
    taken = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("fits").alias("fits"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            column, toxic = batch.column("text"), batch.column("toxic").to_pylist()
            for i, y in enumerate(toxic):
                for w in set(words(column[i].as_py())):
                    seen.setdefault(w, [0, 0])[1 - y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([n[0] for n in seen.values()], pa.int64()), pa.array([n[1] for n in seen.values()], pa.int64())], names=["word", "t", "o"])

    types = taken.where(~F.col("fits")).select("text", "toxic").mapInArrow(count, "word binary, t long, o long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    got = types.toArrow()  # words of the sample's documents
    model = KneserNey([bytes(w) for w in got["word"].to_pylist()], got["t"].to_numpy(), got["o"].to_numpy())
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, None)
        for batch in batches:
            x = scorer.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), *(pa.array(x[:, i]) for i in range(4))], names=["toxic", "a", "b", "c", "d"])

    fit = taken.where("fits").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measure, "toxic int, a double, b double, c double, d double").toArrow()
    y = fit["toxic"].to_numpy().astype(float)
    x = np.stack([fit[c].to_numpy() for c in "abcd"], 1) if len(y) else np.zeros((0, 4))
    if len(set(y)) < 2:
        return Scorer(model, np.array([-2.0, 0.0, 0.3, 0.3]))
    share = {c: (n / sum(numbers.values())) / max((y == c).mean(), 1e-9) for c, n in numbers.items()}  # as frequent as among all labelled rows
    return Scorer(model, logistic(x, y, np.where(y == 1, share[1], share[0])))


def score(docs: DataFrame, labels: DataFrame, mod: int = 4, out: int = 2) -> DataFrame:
    """Toxicity of every whole text; a row for each row of docs.

    docs has doc_id and text, labels has doc_id and toxic (0, 1; other values and nulls are ignored; of several labels of one id the
    largest counts); other columns are ignored. Learns from rows of labels whose crc32(doc_id as text) mod `mod` isn't `out`, at most
    SAMPLE of each class, chosen by a hash of doc_id (of several documents of one id the smallest text); this bound on labelled rows is the only one. A null text is empty and has the score of no evidence. A null doc_id stays null and is in no class. Repeated
    rows give repeated rows; an empty table gives no rows. Unless both classes have labelled rows, every score is 0. The pass
    over docs is narrow.
    """
    ship(docs.sparkSession)
    scorer = docs.sparkSession.sparkContext.broadcast(learn(texts(docs), labels.select("doc_id", "toxic"), mod, out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = rated(scorer.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], schema=ARROW)

    return texts(docs).withColumn("held_out", crc_mod("doc_id", mod) == out).mapInArrow(run, SCHEMA)


def rated(scorer: Scorer, column: pa.Array, at_once: int = 500) -> np.ndarray:
    parts = [scorer(column.slice(i, at_once).to_pylist()) for i in range(0, len(column), at_once)]
    return np.concatenate(parts) if parts else np.zeros(0)


def without_toxic(docs: DataFrame, labels: DataFrame, mod: int = 4, out: int = 2) -> DataFrame:
    """The rows of docs that aren't predicted toxic, all columns as they are; scores and special cases as in score()."""
    ship(docs.sparkSession)
    scorer = docs.sparkSession.sparkContext.broadcast(learn(texts(docs), labels.select("doc_id", "toxic"), mod, out))

    @F.arrow_udf("double")
    def rate(column: pa.Array) -> pa.Array:
        return pa.array(rated(scorer.value, column))

    scored = docs.withColumn("__toxicity", rate(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return scored.where(F.col("__toxicity") < THRESHOLD).drop("__toxicity")
