"""The search plan: three signals, one fusion, and the display columns only for the rows that are returned."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import language_filter, matches_glob, path_language, query_phrases, query_tokens
from siftstone.operators import fusion, lexical, vector

#: Total order among equal scores.
TIES = ["repo", "path", "start_line", "chunk_id"]


@dataclass(frozen=True)
class Scope:
    """Tables of a search. chunks and postings are those of the repositories asked for, all_chunks of every one."""

    chunks: DataFrame
    postings: DataFrame
    all_chunks: DataFrame
    all_postings: DataFrame
    corpus: lexical.Corpus
    kind: DataFrame | None = None  # chunk_id of the chunks with the wanted kind

    def of_kind(self, rows: DataFrame) -> DataFrame:
        return rows if self.kind is None else rows.join(self.kind, "chunk_id", "left_semi")


def bm25_signal(scope: Scope, query: str, most: int = 100) -> DataFrame | None:
    """Ranked full-text candidates. Statistics are those of the whole corpus; scope and kind act before the cut."""
    phrases = query_phrases(query)
    if not phrases or not scope.corpus.rows:
        return None
    weights = lexical.phrase_weights(lexical.phrase_counts(scope.all_postings, phrases), scope.corpus, phrases)
    counts = lexical.phrase_counts(scope.postings, phrases)
    named = scope.of_kind(scope.chunks.select(*TIES, "doc_len"))
    scored = lexical.bm25(counts, named, scope.corpus, weights).join(named.select(*TIES), "chunk_id")
    ranked = lexical.top_ranked(scored, ["bm25", *TIES], most)
    return fusion.signal(ranked, "bm25", lexical.rank_score(F.col("rank")))


def vector_signal(scope: Scope, query_vector: list[float], limit: int, backend: str) -> DataFrame:
    """knn_l2: the global top-k of all repositories, then scope and kind. cosine_scan: all positive cosines in scope."""
    if backend == "knn_l2":
        near = vector.knn_l2(scope.all_chunks.where("embedding IS NOT NULL").select(*TIES, "embedding"), query_vector, vector.neighbours_wanted(limit), TIES)
        near = scope.of_kind(near.join(scope.chunks.select("chunk_id"), "chunk_id", "left_semi"))
        return fusion.signal(near, "vector", F.lit(fusion.VECTOR) / (F.lit(1.0) + F.col("distance")), F.col("similarity"))
    found = vector.cosine_scan(scope.of_kind(scope.chunks.select("chunk_id", "embedding")), query_vector)
    return fusion.signal(found, "vector", F.lit(fusion.VECTOR) * F.col("similarity"), F.col("similarity"))


def path_symbol_signals(scope: Scope, query: str) -> list[DataFrame]:
    tokens = query_tokens(query)
    if not fusion.scans_paths(query, tokens):
        return []
    rows = scope.of_kind(scope.chunks.select("chunk_id", "path", "symbols"))
    by_path, by_symbol = fusion.path_score(F.col("path"), query, tokens), fusion.symbol_score(F.col("symbols"), tokens)
    return [fusion.signal(rows.where(by_path > 0), "path", by_path), fusion.signal(rows.where(by_symbol > 0), "symbol", by_symbol)]


def search(scope: Scope, query: str, mode: str = "hybrid", limit: int = 10, path: str | None = None, lang: str | None = None, query_vector: list[float] | None = None, backend: str = "knn_l2", doubtful: float = 0.6, lexical_candidates: int = 100) -> DataFrame | None:
    """The result rows, best first; None if no signal can say anything. path and lang filter after fusion and before the limit."""
    signals = path_symbol_signals(scope, query)
    if mode in ("hybrid", "lexical") and (words := bm25_signal(scope, query, lexical_candidates)) is not None:
        signals.append(words)
    if mode in ("hybrid", "vector") and query_vector:
        signals.append(vector_signal(scope, query_vector, limit, backend))
    if not signals:
        return None
    rows = fusion.fused(signals).join(scope.chunks.select(*TIES), "chunk_id")
    if path:
        rows = rows.where(matches_glob(F.col("path"), path))
    if (wanted := language_filter(lang)) is not None:
        rows = rows.where(F.lower(path_language(F.col("path"))) == wanted)
    best = rows.orderBy(F.desc("score"), *TIES).limit(limit)
    shown = F.broadcast(best.select("chunk_id", "score", "reasons", "similarity")).join(scope.chunks.select(*TIES, "end_line", "file_hash", "symbols", "content"), "chunk_id")  # limit rows
    return fusion.hits(shown.orderBy(F.desc(shown["score"]), *TIES), doubtful)
