"""Full-text matching and BM25 over postings."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from siftstone.functions.text import fts_tokens

#: The parameters of BM25, and the weight of a phrase that is in over half of all rows.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Corpus:
    """Size of the whole corpus, whatever filters a search has: number of rows and of tokens."""

    rows: int
    tokens: int

    @property
    def average(self) -> float:
        return self.tokens / self.rows if self.rows else 0.0


def postings_of(docs: DataFrame, key: str, fields: list[str], terms: set[str] | None = None) -> DataFrame:
    """term, key, field, pos for every token of some text columns; JVM only. With terms, only theirs: others aren't even made rows."""

    def tokens(number: int, name: str) -> Column:
        return F.transform(fts_tokens(F.coalesce(F.col(name), F.lit(""))), lambda t, i: F.struct(F.lit(number).alias("field"), i.cast("int").alias("pos"), t.alias("term")))

    each = F.flatten(F.array(*[tokens(n, f) for n, f in enumerate(fields)]))
    if terms is not None:
        each = F.filter(each, lambda t: t.term.isin(sorted(terms)))
    return docs.select(key, F.explode(each).alias("t")).select("t.term", key, "t.field", "t.pos")


def phrase_counts(postings: DataFrame, phrases: list[list[str]], key: str = "chunk_id") -> DataFrame:
    """key, phrase (its number), f: how often each phrase stands in each row, in one field, tokens consecutive.

    Only postings of the phrases' terms are read. An occurrence is found where every token says that it begins:
    position - place in the phrase; no join is needed.
    """
    if not phrases:
        return postings.select(key, F.lit(0).alias("phrase"), F.lit(0).cast("long").alias("f")).limit(0)
    terms = sorted({t for p in phrases for t in p})
    places = F.array(*[F.struct(F.lit(n).alias("phrase"), F.lit(len(p)).alias("size"), F.lit(i).alias("place"), F.lit(t).alias("of")) for n, p in enumerate(phrases) for i, t in enumerate(p)])
    wanted = postings.where(F.col("term").isin(terms))
    at = wanted.select(key, "field", "pos", F.explode(F.filter(places, lambda x: x.of == F.col("term"))).alias("p"))
    starts = at.groupBy(key, F.col("p.phrase").alias("phrase"), "field", (F.col("pos") - F.col("p.place")).alias("start")).agg(F.count("*").alias("met"), F.first("p.size").alias("size"))
    return starts.where(F.col("met") == F.col("size")).groupBy(key, "phrase").agg(F.count("*").alias("f"))


def phrases_within(docs: DataFrame, fields: list[str], phrases: list[list[str]]) -> DataFrame:
    """docs with doc_len (tokens of all fields) and f (how often each phrase stands in them, tokens consecutive in one field). Narrow: each row is read once."""
    terms = sorted({t for p in phrases for t in p})
    read = docs.withColumn("__tokens", F.array(*[fts_tokens(F.coalesce(F.col(c), F.lit(""))) for c in fields]))
    read = read.withColumn("__wanted", F.transform("__tokens", lambda tokens: F.filter(tokens, lambda t: t.isin(terms))))

    def times(phrase: list[str]) -> Column:
        def within(tokens: Column, wanted: Column) -> Column:
            if len(phrase) == 1:
                return F.size(F.filter(wanted, lambda t: t == phrase[0]))
            begins = F.filter(tokens, lambda t, i: reduce(lambda a, b: a & b, [t == phrase[0], *[F.get(tokens, i + k) == x for k, x in enumerate(phrase) if k]]))
            return F.when(reduce(lambda a, b: a & b, [F.array_contains(wanted, x) for x in phrase]), F.size(begins)).otherwise(0)

        return reduce(lambda a, b: a + b, [within(F.get("__tokens", n), F.get("__wanted", n)) for n in range(len(fields))])

    lengths = reduce(lambda a, b: a + b, [F.size(F.get("__tokens", n)) for n in range(len(fields))])
    return read.withColumn("doc_len", lengths).withColumn("f", F.array(*map(times, phrases)).cast("array<int>")).drop("__tokens", "__wanted")


def scored(docs: DataFrame, fields: list[str], phrases: list[list[str]], keep: list[str]) -> DataFrame:
    """keep, bm25 of the rows that hold a phrase, by one pass over docs and no shuffle.

    The pass counts rows, tokens and the rows that hold each phrase on its way, and keeps (spilling to disk) only the rows that match.
    """
    seen = Observation()
    counts = [F.count_if(F.get("f", n) > 0).alias(f"p{n}") for n in range(len(phrases))]
    read = phrases_within(docs, fields, phrases).select(*keep, "doc_len", "f").observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens"), *counts)
    rows = read.where(F.exists("f", lambda x: x > 0)).persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    corpus = Corpus(seen.get["rows"], seen.get["tokens"])
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len").cast("double") / F.lit(corpus.average or 1.0))
    total = F.lit(0.0)
    for n in range(len(phrases)):
        f = F.get("f", n).cast("double")
        total = total + F.lit(float(idf(corpus.rows, seen.get[f"p{n}"]))) * f * F.lit(K1 + 1) / (f + norm)
    return rows.select(*keep, (-total).alias("bm25"))


def idf(rows: int, holding: int) -> float:
    weight = math.log((rows - holding + 0.5) / (holding + 0.5)) if rows else 0.0
    return weight if weight > 0 else LEAST_IDF


def bm25(counts: DataFrame, lengths: DataFrame, corpus: Corpus, weights: dict[int, float], key: str = "chunk_id") -> DataFrame:
    """key, bm25 (negative, smaller is better) of the rows that hold a phrase; lengths has key and doc_len."""
    weight = F.create_map(*(F.lit(x) for n, w in weights.items() for x in (n, float(w)))) if weights else F.create_map()
    f, n = F.col("f").cast("double"), F.col("doc_len").cast("double")
    part = weight[F.col("phrase")] * f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * n / F.lit(corpus.average)))
    return counts.join(lengths.select(key, "doc_len"), key).groupBy(key).agg((-F.sum(part)).alias("bm25"))


def phrase_weights(counts: DataFrame, corpus: Corpus, phrases: list[list[str]]) -> dict[int, float]:
    """IDF of each phrase; one row a phrase reaches the driver, and there are MOST_PHRASES at most."""
    holding = {r["phrase"]: r["n"] for r in counts.groupBy("phrase").agg(F.count("*").alias("n")).collect()}
    return {n: idf(corpus.rows, holding.get(n, 0)) for n in range(len(phrases))}


def rank_score(rank: Column) -> Column:
    """What a full-text rank, from 0 on, adds to a score."""
    return F.greatest(F.lit(0.2), F.lit(4.0) - F.lit(0.03) * rank)


def top_ranked(scored: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first rows with their rank from 0 on; the window runs over `most` rows only."""
    best = scored.orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
