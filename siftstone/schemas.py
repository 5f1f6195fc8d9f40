"""Schemas of the stored tables and of results."""

from __future__ import annotations

FILES = "path string, abs_path string, file_hash string, size bigint, mtime double, language string, content string, indexed_at timestamp"
CHUNKS = "chunk_id string, path string, start_line int, end_line int, content string, symbols array<string>, file_hash string, content_hash string, doc_len int, embedding array<float>, updated_at timestamp"
SYMBOLS = "path string, chunk_id string, symbol string, kind string, line int"
POSTINGS = "term string, chunk_id string, field int, pos int"
TABLES = {"files": FILES, "chunks": CHUNKS, "symbols": SYMBOLS, "postings": POSTINGS}

#: The result of a search, in the order of the columns.
HIT = ("repo", "path", "language", "line_range", "start_line", "end_line", "score", "score_reason", "low_confidence", "vector_similarity", "chunk_id", "file_hash", "symbols", "snippet")
#: Fields that full-text matching looks at; a phrase stands within one of them.
FIELDS = ("path", "symbols", "content")
