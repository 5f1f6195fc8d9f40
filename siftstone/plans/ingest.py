"""The index plan: scan, diff, parse, embed, and the tables of a repository's next version."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.config import Options
from siftstone.functions.text import folded_tokens, language_of
from siftstone.operators.chunking import chunk_text
from siftstone.operators.symbols import definitions
from siftstone.sources.embedders import EMBEDDED, embedding_pass

_CHUNK = "struct<chunk_id: string, start_line: int, end_line: int, content: string, symbols: array<string>, content_hash: string, doc_len: int>"
_TERM = "struct<term: string, chunk_id: string, field: int, pos: int>"
PARSED = f"path string, language string, chunks array<{_CHUNK}>, symbols array<struct<symbol: string, kind: string, line: int, chunk_id: string>>, terms array<{_TERM}>"
_ARROW = pa.schema([
    ("path", pa.string()), ("language", pa.string()),
    ("chunks", pa.list_(pa.struct([("chunk_id", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()), ("symbols", pa.list_(pa.string())), ("content_hash", pa.string()), ("doc_len", pa.int32())]))),
    ("symbols", pa.list_(pa.struct([("symbol", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("chunk_id", pa.string())]))),
    ("terms", pa.list_(pa.struct([("term", pa.string()), ("chunk_id", pa.string()), ("field", pa.int32()), ("pos", pa.int32())]))),
])


def bucket_of(term: str, buckets: int) -> int:
    """The folder of a term's postings; the same as bucket() gives."""
    return zlib.crc32(term.encode()) % buckets


def bucket(buckets: int):
    return (F.crc32(F.col("term").cast("binary")) % buckets).cast("int")


def parse_file(repo: str, path: str, text: str, options: Options) -> dict:
    """Chunks, symbols with their chunks, and index tokens of one file."""
    chunks = chunk_text(repo, path, text, options.max_lines, options.overlap)
    terms, rows = [], []
    for c in chunks:
        count = 0
        for n, field in enumerate((path, " ".join(c.symbols), c.content)):
            tokens = folded_tokens(field)
            count += len(tokens)
            terms += [{"term": t, "chunk_id": c.chunk_id, "field": n, "pos": i} for i, t in enumerate(tokens)]
        rows.append({"chunk_id": c.chunk_id, "start_line": c.start_line, "end_line": c.end_line, "content": c.content, "symbols": c.symbols, "content_hash": c.content_hash, "doc_len": count})
    symbols = []
    for name, line, kind in dict.fromkeys(definitions(path, text)):
        home = next((c for c in chunks if c.start_line <= line <= c.end_line), chunks[0] if chunks else None)
        symbols.append({"symbol": name, "kind": kind, "line": line, "chunk_id": home and home.chunk_id})
    return {"path": path, "language": language_of(path), "chunks": rows, "symbols": symbols, "terms": terms}


def parsed(texts: DataFrame, repo: str, options: Options) -> DataFrame:
    """A row for each file of texts (path, text); one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([parse_file(repo, path, text, options)], schema=_ARROW)

    return texts.select("path", "text").mapInArrow(run, PARSED)


def embedded(parsed_files: DataFrame, embedder, options: Options) -> DataFrame:
    """path, vectors, asked, degraded; files in path order, in options.embed_tasks tasks."""
    asked = parsed_files.select("path", F.transform("chunks", lambda c: c.content).alias("texts"))
    dealt = asked.coalesce(1).sortWithinPartitions("path") if options.embed_tasks == 1 else asked.repartition(options.embed_tasks).sortWithinPartitions("path")
    return dealt.mapInArrow(embedding_pass(embedder, options.embed_batch, options.breaker), EMBEDDED)


@dataclass(frozen=True)
class NewRows:
    """Rows of the files that are new or changed."""

    files: DataFrame
    chunks: DataFrame
    symbols: DataFrame
    postings: DataFrame


def rows_of(staged: DataFrame, now) -> NewRows:
    """Table rows from staged files: those of decoded(), parsed() and embedded() side by side."""
    at = F.lit(now).cast("timestamp")
    files = staged.select("path", "abs_path", "file_hash", "size", "mtime", "language", F.col("text").alias("content"), at.alias("indexed_at"))
    each = staged.select("path", "file_hash", "vectors", F.posexplode("chunks").alias("n", "c"))
    chunks = each.select(
        "c.chunk_id", "path", "c.start_line", "c.end_line", "c.content", "c.symbols", "file_hash", "c.content_hash", "c.doc_len",
        F.get("vectors", F.col("n")).alias("embedding"), at.alias("updated_at"),
    )
    symbols = staged.select("path", F.explode("symbols").alias("s")).select("path", "s.chunk_id", "s.symbol", "s.kind", "s.line")
    postings = staged.select(F.explode("terms").alias("t")).select("t.*")
    return NewRows(files, chunks, symbols, postings)
