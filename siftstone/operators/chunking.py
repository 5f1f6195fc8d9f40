"""Overlapping line windows."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import chunk_id, lines_of, split_lines
from siftstone.operators.symbols import parsed_definitions, symbol_names


class Chunk(NamedTuple):
    chunk_id: str
    start_line: int
    end_line: int
    content: str
    symbols: list[str]
    content_hash: str


def window_bounds(max_lines: int, overlap: int) -> tuple[int, int]:
    """The window's size, and how far apart windows begin."""
    size = max(1, max_lines)
    return size, size - max(0, min(overlap, size - 1))


def line_windows(files: DataFrame, max_lines: int = 80, overlap: int = 10, text: str = "content", repo: str = "repo", path: str = "path") -> DataFrame:
    """Windows of all files in closed form, without Python: window i begins at line i * (size - overlap) + 1, and the last ends the file.

    Adds start_line, end_line, content, chunk_id to the other columns; files without lines give none. A narrow plan: no shuffle.
    """
    size, step = window_bounds(max_lines, overlap)
    rest = [c for c in files.columns if c != text]
    lined = files.select(*rest, split_lines(F.col(text)).alias("__lines")).where(F.size("__lines") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("__lines") - size) / step)).cast("int")
    windows = lined.select("*", F.explode(F.sequence(F.lit(0), last)).alias("__i"))
    start = (F.col("__i") * step + 1).cast("int")
    cut = windows.select(*rest, start.alias("start_line"), F.least(F.size("__lines"), start + size - 1).cast("int").alias("end_line"), F.array_join(F.slice("__lines", start, F.lit(size)), "\n").alias("content"))
    return cut.withColumn("chunk_id", chunk_id(F.col(repo), F.col(path), F.col("start_line"), F.col("end_line"), F.col("content")))


def spans_with_snap(n_lines: int, definitions: list[tuple[int, int]], max_lines: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) lines of windows; a window that would cut a definition beginning inside it ends before that definition.

    Of several such definitions the one that begins first counts. After such an end the next window doesn't overlap.
    """
    size, step = window_bounds(max_lines, overlap)
    ordered, out, first = sorted(set(definitions)), [], 1
    while True:
        last = min(n_lines, first + size - 1)
        cut = next((a for a, b in ordered if first < a <= last < b), None) if last < n_lines else None
        out.append((first, last if cut is None else cut - 1))
        if last == n_lines:
            return out
        first = first + step if cut is None else cut


def chunk_text(repo: str, path: str, text: str, max_lines: int = 80, overlap: int = 10) -> list[Chunk]:
    """Chunks of one file, snapped to definitions, with the file's symbols that each contains as whole words."""
    lines = lines_of(text)
    if not lines:
        return []
    words = [(s, re.compile(rf"\b{re.escape(s)}\b")) for s in symbol_names(path, text)]
    out = []
    for a, b in spans_with_snap(len(lines), [(d.start, d.end) for d in parsed_definitions(path, text)], max_lines, overlap):
        content = "\n".join(lines[a - 1 : b])
        digest = hashlib.sha256(content.encode()).hexdigest()
        key = "\0".join([repo, path, str(a), str(b), digest])
        out.append(Chunk(hashlib.sha256(key.encode()).hexdigest()[:24], a, b, content, [s for s, word in words if word.search(content)], digest))
    return out
