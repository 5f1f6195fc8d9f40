from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.operators.chunking import chunk_text, line_windows, spans_with_snap
from siftstone.operators.symbols import definitions, line_symbols, parsed_definitions, pattern_definitions, symbols_to_chunks

SOURCE = "class Box:\n    def get(self):\n        def inner():\n            pass\n        return 1\n\n\ndef make():\n    return Box()\n"


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(1, 40), st.integers(0, 50))
def test_windows_cover_all_lines(n, size, overlap):
    spans = spans_with_snap(n, [], size, overlap)
    assert spans[0][0] == 1 and spans[-1][1] == n
    for (a, b), (c, _) in zip(spans, spans[1:], strict=False):
        assert b - a + 1 == size and c == b + 1 - min(overlap, size - 1)


def test_closed_form_equals_the_walk(spark):
    texts = ["\n".join(f"l{i}" for i in range(n)) + "\n" * (n % 2) for n in (0, 1, 2, 5, 6, 9, 10, 23)] + ["\n", "", "\n\n"]
    rows = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo string, path string, content string")
    for size, overlap in ((5, 1), (3, 0), (4, 9), (0, 0)):
        got = {(r.path, r.start_line, r.end_line, r.content, r.chunk_id) for r in line_windows(rows, size, overlap).collect()}
        want = {(str(i), c.start_line, c.end_line, c.content, c.chunk_id) for i, t in enumerate(texts) for c in chunk_text("r", str(i), t, size, overlap)}
        assert got == want


def test_a_window_ends_before_a_definition_it_would_cut():
    body = "def a():\n" + "    x\n" * 11 + "def b():\n" + "    y\n" * 11 + "z\n"
    chunks = chunk_text("r", "m.py", body, 20, 5)
    assert [(c.start_line, c.end_line) for c in chunks] == [(1, 12), (13, 25)]
    assert chunks[0].symbols == ["a"] and chunks[1].symbols == ["b"]


def test_of_cut_definitions_the_first_counts():
    assert spans_with_snap(30, [(5, 20), (8, 15)], 10, 2)[:2] == [(1, 4), (5, 7)]


def test_empty_and_blank_texts():
    assert chunk_text("r", "p", "") == []
    (only,) = chunk_text("r", "p", "\n")
    assert (only.start_line, only.end_line, only.content) == (1, 1, "")


def test_parsed_definitions_have_kinds_and_lines():
    assert [tuple(d) for d in parsed_definitions("m.py", SOURCE)] == [("Box", 1, 5, "class"), ("get", 2, 5, "method"), ("inner", 3, 4, "function"), ("make", 8, 9, "function")]
    assert parsed_definitions("m.py", "def broken(:\n") == [] and parsed_definitions("m.js", SOURCE) == []


def test_patterns():
    code = "export async function go$() {}\nexport class A$ {}\nconst f = async (x) => x\nlet g = y => y\nfunc main() {}\npub fn run() {}\n"
    assert [(n, k) for n, _, k in pattern_definitions(code)] == [("go$", "function"), ("A$", "class"), ("f", "function"), ("g", "function"), ("main", "function"), ("run", "function")]
    assert pattern_definitions("x=1\n\n\ndef foo(): pass\n") == [("foo", 2, "function")]  # the match begins with the blank lines
    assert definitions("m.py", "x=1\n\n\ndef foo(): pass\n") == [("foo", 4, "function")]


def test_a_name_that_is_known_is_not_added_again():
    assert [n for n, _, _ in definitions("a.js", "class A {}\nclass A {}\nfunction A() {}\n")] == ["A"]
    assert [n for n, _, _ in definitions("a.py", "def f(): pass\ndef f(): pass\n")] == ["f", "f"]


def test_line_symbols_and_their_chunks(spark):
    files = spark.createDataFrame([("r", "m.py", SOURCE), ("r", "empty.py", "")], "repo string, path string, content string")
    found = line_symbols(files)
    assert {(r.symbol, r.kind, r.line) for r in found.collect()} == {("Box", "class", 1), ("get", "function", 2), ("inner", "function", 3), ("make", "function", 8)}
    chunks = line_windows(files, 4, 1)
    at = {r.symbol: r.chunk_id for r in symbols_to_chunks(found, chunks, ["repo", "path"]).collect()}
    starts = {r.chunk_id: r.start_line for r in chunks.collect()}
    assert {s: starts[c] for s, c in at.items()} == {"Box": 1, "get": 1, "inner": 1, "make": 7}
    none = symbols_to_chunks(found, chunks.where("path = 'other'"), ["repo", "path"]).collect()
    assert len(none) == 4 and all(r.chunk_id is None for r in none)
    outside = spark.createDataFrame([("r", "m.py", "far", "class", 999)], "repo string, path string, symbol string, kind string, line int")
    assert starts[symbols_to_chunks(outside, chunks, ["repo", "path"]).first().chunk_id] == 1
