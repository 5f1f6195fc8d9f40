"""Additive fusion of ranking signals, and the search result's columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import line_range, path_language, snippet

#: Signals in the order in which reasons are named.
SIGNALS = ("bm25", "vector", "path", "symbol")
STRONG_PATH, WEAK_PATH, SYMBOL, VECTOR = 4.5, 1.5, 2.0, 3.0


def signal(rows: DataFrame, name: str, score: Column, similarity: Column | None = None, key: str | list[str] = "chunk_id") -> DataFrame:
    return rows.select(*keys(key), F.lit(SIGNALS.index(name)).alias("signal"), score.cast("double").alias("score"), (F.lit(None) if similarity is None else similarity).cast("double").alias("similarity"))


def path_score(path: Column, query: str, tokens: list[str]) -> Column:
    """4.5 if path and query contain one another (queries of 3 characters or more), else 1.5 if the path contains a token."""
    whole, low = query.lower().strip(), F.lower(path)
    weak = reduce(lambda a, b: a | b, [low.contains(t) for t in tokens], F.lit(False))
    strong = low.contains(whole) | F.lit(whole).contains(low) if len(whole) >= 3 else F.lit(False)
    return F.when(strong, F.lit(STRONG_PATH)).when(weak, F.lit(WEAK_PATH)).otherwise(F.lit(0.0))


def symbol_score(symbols: Column, tokens: list[str]) -> Column:
    """2 if the symbols, joined by spaces, contain a token."""
    joined = F.lower(F.array_join(symbols, " "))
    return F.when(reduce(lambda a, b: a | b, [joined.contains(t) for t in tokens], F.lit(False)), F.lit(SYMBOL)).otherwise(F.lit(0.0))


def scans_paths(query: str, tokens: list[str]) -> bool:
    """Whether path and symbol signals can say anything about a query."""
    return bool(tokens) or len(query.strip()) >= 3


def keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def fused(signals: list[DataFrame], key: str | list[str] = "chunk_id") -> DataFrame:
    """key (one column or some that go together), score (sum), reasons (names in fixed order), similarity (the largest)."""
    rows = reduce(DataFrame.unionByName, signals)
    names = F.array(*map(F.lit, SIGNALS))
    reasons = F.transform(F.array_sort(F.collect_set("signal")), lambda i: F.get(names, i))
    return rows.groupBy(*keys(key)).agg(F.sum("score").alias("score"), reasons.alias("reasons"), F.max("similarity").alias("similarity"))


def low_confidence(reasons: Column, similarity: Column, least: float) -> Column:
    """A hit that nothing but a weak vector neighbour speaks for."""
    return (reasons == F.array(F.lit("vector"))) & (similarity.isNull() | (similarity < least))


def hits(ranked: DataFrame, doubtful: float) -> DataFrame:
    """The result's columns from ranked chunks with score, reasons, similarity and the chunk's own columns."""
    return ranked.select(
        "repo", "path", path_language(F.col("path")).alias("language"), line_range(F.col("start_line"), F.col("end_line")).alias("line_range"), "start_line", "end_line",
        F.round("score", 4).alias("score"), F.array_join("reasons", "+").alias("score_reason"), low_confidence(F.col("reasons"), F.col("similarity"), doubtful).alias("low_confidence"),
        F.round("similarity", 4).alias("vector_similarity"), "chunk_id", "file_hash", "symbols", snippet(F.col("content")).alias("snippet"),
    )
