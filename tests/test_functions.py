import fnmatch
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftstone.functions import text, vectors


def column(spark, make, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_lines_split_at_newlines_only(spark):
    values = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\r\r\nc", "a\fb\x0bc d\n\x85e"]
    assert column(spark, text.split_lines, values) == [text.lines_of(v) for v in values]
    assert text.lines_of("a\fb\n") == ["a\fb"]


@pytest.mark.parametrize(("start", "end", "want"), [(None, None, (1, 3, "a\nb\nc")), (2, 2, (2, 2, "b")), (0, 0, (1, 3, "a\nb\nc")), (9, None, (9, 3, "")), (2, 99, (2, 3, "b\nc")), (-5, 1, (1, 1, "a"))])
def test_line_slice(spark, start, end, want):
    (got,) = column(spark, lambda c: text.line_slice(c, start, end), ["a\nb\nc\n"])
    assert tuple(got) == want


def test_path_language(spark):
    values = ["a/b.py", "Makefile", ".bashrc", "a.tar.gz", "x.d/y", "src/A.PY", "a."]
    assert column(spark, text.path_language, values) == [text.language_of(v) for v in values] == ["py", "", "", "gz", "", "PY", ""]
    assert column(spark, text.parser_language, ["a.py", "a.PY", "b/c.tsx", "x"]) == ["python", None, "tsx", None]


@pytest.mark.parametrize("glob", ["*", "*.py", "src/*", "a?c", "[ab]*", "[!a]*", "x.y", "a[", "a*b*", "(a)+$", "[]a]x", "[a-c]1"])
def test_globs_match_as_fnmatch(spark, glob):
    values = ["a.py", "src/a/b.py", "abc", "b1", "x.y", "xzy", "a[", "aXb\nY", "(a)+$", "]x", "ax", "B1", ""]
    assert column(spark, lambda c: text.matches_glob(c, glob), values) == [fnmatch.fnmatchcase(v, glob) for v in values]


def test_snippets(spark):
    values = [" a \n", "x" * 500, "x" * 501, "y" * 498 + " zz", " b\xa0\x1c", ""]
    got = column(spark, text.snippet, values)
    assert got == ["a", "x" * 500, "x" * 499 + "...", "y" * 498 + "...", "b", ""]


def test_chunk_id_is_that_of_plain_code(spark):
    from siftstone.operators.chunking import chunk_text

    (c,) = chunk_text("r", "p.txt", "hé\nx\n")
    rows = spark.createDataFrame([("r", "p.txt", c.start_line, c.end_line, c.content)], "r string, p string, a int, b int, c string")
    assert rows.select(text.chunk_id(F.col("r"), F.col("p"), F.col("a"), F.col("b"), F.col("c"))).first()[0] == c.chunk_id


def test_query_tokens_and_phrases():
    assert text.query_tokens("Find auth.py in 2fa a. A x_y") == ["find", "auth.py", "in", "fa", "a.", "x_y"]
    assert text.query_phrases("auth.py __ a.") == [["auth", "py"], ["a"]]
    assert len(text.query_phrases(" ".join(f"w{i}" for i in range(20)))) == 12
    assert text.query_phrases("aa aa") == [["aa"], ["aa"]]


def test_index_tokens_fold_case_and_accents():
    assert text.folded_tokens("Café_AU lait-42 ß") == ["cafe", "au", "lait", "42", "ß"]
    assert text.folded_tokens(unicodedata.normalize("NFD", "é")) == ["e"]


def test_cosine_and_l2(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), ([3.0, 4.0], [4.0, 3.0])]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>").orderBy("i")
    assert [round(r[0], 6) for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.96]
    assert rows.where("i = 5").select(vectors.l2(F.col("a"), F.col("b"))).first()[0] == pytest.approx(math.sqrt(2))


def test_filters():
    assert text.language_filter(" ..PY ") == "py" and text.language_filter(" . ") is None and text.language_filter(None) is None
    assert text.kind_filter(" Class ") == "class" and text.kind_filter(" ") is None
