"""Catalogue queries over files, chunks and symbols: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import kind_filter, language_filter, line_slice, matches_glob, path_language


def clamp(limit: int, most: int) -> int:
    return max(1, min(int(limit), most))


def list_files(files: DataFrame, glob: str | None = None, lang: str | None = None, limit: int = 50, most: int = 500) -> DataFrame:
    """Files by (repo, path); filters act before the limit. lang compares with the path's suffix in lower case."""
    out = files
    if glob:
        out = out.where(matches_glob(F.col("path"), glob))
    if (wanted := language_filter(lang)) is not None:
        out = out.where(F.lower(path_language(F.col("path"))) == wanted)
    return out.orderBy("repo", "path").limit(clamp(limit, most))


def distinct_lower(rows: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in lower case, ascending."""
    return rows.select(F.lower(column).alias(column)).where(F.col(column) != "").distinct().orderBy(column)


def repo_summaries(repos: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """name with files, chunks, embedded_chunks, by name; repos without files count 0. One aggregate a table."""
    f = files.groupBy("repo").agg(F.count("*").alias("files"))
    c = chunks.groupBy("repo").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded_chunks"))
    out = repos.join(f, repos["name"] == f["repo"], "left").drop("repo").join(c, repos["name"] == c["repo"], "left").drop("repo")
    return out.select(*repos.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("files", "chunks", "embedded_chunks")]).orderBy("name")


def counts(rows: DataFrame, embedded: str | None = None) -> DataFrame:
    """One row: n, and the number with an embedding."""
    more = [F.count(embedded).alias("embedded")] if embedded else []
    return rows.agg(F.count("*").alias("n"), *more)


def file_range(files: DataFrame, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """repo, path, start_line, end_line, content, file_hash of lines of a file."""
    cut = line_slice(F.col("content"), start, end)
    return files.where(F.col("path") == path).select("repo", "path", cut.alias("cut"), "file_hash").select("repo", "path", "cut.*", "file_hash")


def escaped_like(text: str) -> str:
    """A LIKE pattern in which % and _ keep their meaning and a backslash means itself."""
    return text.replace("\\", "\\\\")


def find_symbols(symbols: DataFrame, files: DataFrame | None = None, query: str | None = None, path: str | None = None, lang: str | None = None, kind: str | None = None, limit: int = 50, most: int = 500) -> DataFrame:
    """Symbols, exact names first (in any case), then by repo, path, line.

    lang compares with the language as it is stored, so a suffix in capitals never matches. kind matches kinds only, never names.
    """
    out = symbols
    if query:
        out = out.where(F.lower("symbol").like(f"%{escaped_like(query.lower())}%"))
    if path:
        out = out.where(F.col("path") == path)
    if (wanted := kind_filter(kind)) is not None:
        out = out.where(F.lower("kind") == wanted)
    if files is not None and (wanted := language_filter(lang)) is not None:
        out = out.join(files.where(F.col("language") == wanted).select("repo", "path"), ["repo", "path"], "left_semi")
    exact = F.when(F.lower("symbol") == (query or "").lower(), 0).otherwise(1) if query else F.lit(1)
    return out.orderBy(exact, "repo", "path", "line", "symbol").limit(clamp(limit, most)).select("repo", "symbol", "kind", "path", "line", "chunk_id")
