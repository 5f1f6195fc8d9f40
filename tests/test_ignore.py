import os

import pytest
from pyspark.sql import functions as F

from siftstone.sources.files import decoded, scan_tree
from siftstone.sources.ignore import SKIPPED_DIRS, Rules, binary_sniff, looks_binary, name_skip, rooted, rules_of, skipped_by_name


def tree(root, files):
    for name, body in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body if isinstance(body, bytes) else body.encode())
    return root


def paths(spark, root, **options):
    return sorted(r.path for r in scan_tree(spark, str(root), **options).collect())


@pytest.fixture(autouse=True)
def no_user_excludes(monkeypatch, tmp_path_factory):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path_factory.mktemp("xdg")))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", os.devnull)
    monkeypatch.setenv("GIT_CONFIG_NOSYSTEM", "1")


@pytest.mark.parametrize(
    ("rules", "ignored", "kept"),
    [
        (["*.log"], ["a.log", "x/a.log"], ["a.logs"]),
        (["/a.txt"], ["a.txt"], ["x/a.txt"]),
        (["out/"], ["out/a", "x/out/b"], ["out", "xout/a"]),
        (["doc/*.md"], ["doc/a.md"], ["x/doc/a.md", "doc/x/a.md"]),
        (["**/tmp"], ["tmp", "a/b/tmp", "tmp/x"], ["tmpx"]),
        (["a/**/b"], ["a/b", "a/x/y/b"], ["b"]),
        (["logs/**"], ["logs/a", "logs/a/b"], ["logs"]),
        (["*.log", "!keep.log"], ["a.log"], ["keep.log", "x/keep.log"]),
        (["!a", "a"], ["a"], []),
        (["[ab].c", "?.d"], ["a.c", "x.d"], ["c.c", "xy.d"]),
        ([r"\#x", r"\!y", "sp\\ "], ["#x", "!y", "sp "], ["x"]),
        (["# comment", "", "  "], [], ["# comment", "a"]),
    ],
)
def test_rules(rules, ignored, kept):
    r = Rules.of(rules)
    assert all(r.ignores(p) for p in ignored) and not any(r.ignores(p) for p in kept)


def test_rules_of_nested_files_are_rooted():
    assert rooted("", "x") == "x" and rooted("a", "# c") is None and rooted("a", " ") is None
    assert rooted("a/b", "x") == "a/b/**/x" and rooted("a", "/x") == "a/x" and rooted("a", "x/y") == "a/x/y" and rooted("a", "!x/") == "!a/**/x/"


def test_scan_applies_all_rules(spark, tmp_path):
    tree(tmp_path, {
        ".gitignore": "ignored.txt\n", ".augmentignore": "aug.txt\n", ".indexignore": "*.tmp\n!keep.tmp\n", "ignored.txt": "x", "aug.txt": "x", "a.tmp": "x", "keep.tmp": "x", "main.py": "x",
        "node_modules/a.js": "x", "src/build": "x", ".env": "x", ".env.local": "x", "uv.lock": "x", "k.pem": "x", "big.txt": "x" * 51, "bin.dat": b"a\0b", "src/.gitignore": "plain\n/anchored\n",
        "src/plain": "x", "src/x/plain": "x", "src/anchored": "x", "src/x/anchored": "x", ".github/ci.yml": "x",
    })
    os.symlink(tmp_path / "main.py", tmp_path / "link.py")
    os.symlink(tmp_path / "src", tmp_path / "linked")
    assert paths(spark, tmp_path, max_file_bytes=50) == sorted([".augmentignore", ".github/ci.yml", ".gitignore", ".indexignore", "keep.tmp", "main.py", "src/.gitignore", "src/x/anchored"])


def test_git_excludes(spark, tmp_path, monkeypatch):
    tree(tmp_path, {"r/.git/info/exclude": "local.txt\nboth.txt\n", "r/.gitignore": "!both.txt\n", "r/local.txt": "x", "r/both.txt": "x", "r/global.txt": "x", "r/a": "x", "common/info/exclude": "wt.txt\n", "common/wt/commondir": "..\n", "w/.git": f"gitdir: {tmp_path}/common/wt\n", "w/wt.txt": "x", "w/b": "x"})
    xdg = tree(tmp_path / "xdg", {"git/ignore": "global.txt\n"})
    monkeypatch.setenv("XDG_CONFIG_HOME", str(xdg))
    assert not rules_of(tmp_path / "r").ignores("both.txt") and rules_of(tmp_path / "r").ignores("local.txt") and rules_of(tmp_path / "r").ignores("global.txt")
    assert paths(spark, tmp_path / "r") == [".gitignore", "a", "both.txt"]
    assert "wt.txt" not in paths(spark, tmp_path / "w")


def test_excludes_of_a_nested_repository_stay_within(tmp_path):
    tree(tmp_path, {"sub/.git/info/exclude": "x.txt\n", "sub/x.txt": "", "x.txt": ""})
    rules = rules_of(tmp_path)
    assert rules.ignores("sub/x.txt") and not rules.ignores("x.txt")


def test_names(spark):
    values = ["a/.git/x", "build", "src/target/x", "x/id_rsa", "go.sum", ".env", ".envx", ".env.a", "a.key", "key", "buildx/a", "Build"]
    assert [v for v in values if skipped_by_name(v)] == ["a/.git/x", "build", "src/target/x", "x/id_rsa", "go.sum", ".env", ".env.a", "a.key"]
    rows = spark.createDataFrame([(v,) for v in values], "p string").select("p", name_skip(F.col("p"))).collect()
    assert all(skip == skipped_by_name(p) for p, skip in rows) and len(SKIPPED_DIRS) == 22


def test_sniffing(spark):
    heads = [b"", b"text", b"a\0b", b"\xff\xfe", b"x" * 4095 + "é".encode(), b"x" * 4093 + b"\xff\xff\xff", b"x" * 4092 + b"\xff\xff\xff\xff", b"x" * 5000 + b"\0", "é".encode() * 3000, b"abc\xff", b"\xff"]
    rows = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, b binary").orderBy("i").select(binary_sniff(F.col("b"))).collect()
    assert [r[0] for r in rows] == [looks_binary(h) for h in heads]


def test_files_that_are_not_utf8_are_not_readable(spark, tmp_path):
    tree(tmp_path, {"late.txt": b"a" * 4200 + b"\xff\xfe", "fine.txt": "é"})
    got = {r.path: (r.readable, r.text) for r in decoded(scan_tree(spark, str(tmp_path)), "r").collect()}
    assert got == {"late.txt": (False, None), "fine.txt": (True, "é")}
