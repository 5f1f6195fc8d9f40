import os

import pytest

from doubles import Batch, Dim, Failing, FailingBatch, Keyword, Marker, batches
from siftstone.config import Options
from siftstone.service import Engine
from test_ignore import tree

AUTH = 'class Auth:\n    def login(self, token):\n        return token\n'
CALENDAR = "def schedule_meeting(calendar):\n    return calendar\n"


@pytest.fixture
def make(spark, tmp_path):
    def made(embedder=None, **options):
        return Engine(tmp_path / "index", embedder, spark, Options(posting_buckets=2, **options))

    return made


@pytest.fixture
def repo(tmp_path):
    return tree(tmp_path / "app", {"src/auth.py": AUTH, "src/calendar.py": CALENDAR, "README.md": "# App\nauth and calendar\n"})


def test_index_search_read_remove(make, repo):
    e = make(Keyword())
    r = e.index_repo(repo)
    assert set(r) == {"db_path", "degraded", "deleted_files", "embedded_chunks", "embedding_failures", "indexed_chunks", "indexed_files", "path", "repo", "skipped_files", "unchanged_files"}
    assert (r["repo"], r["indexed_files"], r["indexed_chunks"], r["embedded_chunks"], r["degraded"]) == ("app", 3, 3, 3, False)
    hits = e.search("login token")
    assert hits[0]["path"] == "src/auth.py" and hits[0]["symbols"] == ["Auth", "login"] and hits[0]["score_reason"] == "bm25+vector+symbol"
    assert set(hits[0]) == {"repo", "path", "language", "line_range", "start_line", "end_line", "score", "score_reason", "low_confidence", "vector_similarity", "chunk_id", "file_hash", "symbols", "snippet"}
    assert hits[0]["line_range"] == "1-3" and hits[0]["language"] == "py" and hits[0]["vector_similarity"] == 1.0
    assert e.read_file("app", "src/auth.py", 2, 2)["content"] == "    def login(self, token):"
    assert [s["kind"] for s in e.symbols(query="login")] == ["method"]
    status = e.status()
    assert (status["repos"], status["files"], status["chunks"], status["embedded_chunks"], status["degraded"], status["vector_dim"]) == (1, 3, 3, 3, False, 4)
    assert status["vector_query_backend"] == "knn_l2" and status["embeddings"] == "enabled"
    assert e.remove_repo("app") == {"repo": "app", "deleted_files": 3}
    assert e.list_repos() == [] and e.search("login") == []


def test_filters_act_before_the_limit(make, tmp_path):
    files = {"src/auth.py": "def auth_handler():\n    return 'auth auth'\n", "docs/auth_notes.md": "auth auth auth notes\n", "src/model.py": "class Handler:\n    def handle(self):\n        pass\n", "src/Other.PY": "x = 'auth'\n"}
    e = make()
    e.index_repo(tree(tmp_path / "r", files))
    assert [h["path"] for h in e.search("auth", limit=1, path="docs/*")] == ["docs/auth_notes.md"]
    assert [h["path"] for h in e.search("auth", limit=1, lang=".MD")] == ["docs/auth_notes.md"]
    assert [h["path"] for h in e.search("handle", limit=1, kind="class")] == ["src/model.py"]
    assert e.search("handle", kind="Handler") == []
    assert [f["path"] for f in e.list_files(glob="src/*", limit=1, lang="py")] == ["src/Other.PY"]
    assert e.list_languages() == ["md", "py"] and e.list_kinds() == ["class", "function", "method"]
    assert e.symbols(lang="py", query="auth_handler") and e.symbols(kind="METHOD")[0]["symbol"] == "handle"
    assert [s["symbol"] for s in e.symbols(query="handle")][0] == "handle"


def test_only_what_changed_is_indexed(make, repo):
    e = make()
    e.index_repo(repo)
    before = {h["chunk_id"] for h in e.search("calendar")}
    r = e.index_repo(repo)
    assert (r["indexed_files"], r["unchanged_files"], r["deleted_files"]) == (0, 3, 0)
    (repo / "src/auth.py").write_text(AUTH + "\n\ndef logout():\n    pass\n")
    (repo / "README.md").unlink()
    r = e.index_repo(repo)
    assert (r["indexed_files"], r["unchanged_files"], r["deleted_files"], r["indexed_chunks"]) == (1, 1, 1, 1)
    assert e.symbols(query="logout")[0]["line"] == 6
    assert {h["chunk_id"] for h in e.search("calendar")} < before
    assert e.symbols(query="log_ut") and not e.symbols(query="nothing")  # _ is a wildcard


def test_renames_and_conflicts(make, tmp_path):
    a, b = tree(tmp_path / "a" / "api", {"x.py": "def one(): pass\n"}), tree(tmp_path / "b" / "api", {"y.py": "def two(): pass\n"})
    e = make()
    e.index_repo(a)
    with pytest.raises(ValueError, match="pass a different --name"):
        e.index_repo(b)
    e.index_repo(b, "second")
    with pytest.raises(ValueError, match="already refers to"):
        e.index_repo(b, "api")
    ids = e.search("two", repo="second")[0]["chunk_id"]
    assert e.index_repo(b, "renamed")["unchanged_files"] == 1
    assert [r["name"] for r in e.list_repos()] == ["api", "renamed"] and e.search("two", repo="renamed")[0]["chunk_id"] == ids
    with pytest.raises(ValueError, match=r"unknown repo: no\. indexed repos: api, renamed"):
        e.search("x", repo="no")
    assert e.status("api")["files"] == 1 and len(e.status()["per_repo"]) == 2
    os.rename(a, tmp_path / "gone")
    out = e.reindex_all()
    assert out["reindexed"] == 1 and out["repos"][0] == {"repo": "api", "path": str(a), "skipped": True, "error": "path missing"}


def test_files_that_cannot_be_read_keep_their_last_version(make, tmp_path):
    root = tree(tmp_path / "r", {"a.txt": "first version\n", "b.txt": "b\n"})
    e = make()
    e.index_repo(root)
    (root / "a.txt").write_bytes(b"a" * 4200 + b"\xff\xfe")
    r = e.index_repo(root)
    assert (r["skipped_files"], r["deleted_files"]) == (1, 0)
    assert e.read_file("r", "a.txt")["content"] == "first version"


def test_guards(make, repo):
    e = make()
    assert e.search("x") == [] and e.last.reason == "embeddings-disabled"
    with pytest.raises(ValueError, match=r"unknown repo: app\. indexed repos: \(none\)"):
        e.search("", repo="app")
    with pytest.raises(ValueError, match="not a directory"):
        e.index_repo(repo / "README.md")
    e.index_repo(repo)
    assert e.search("  ") == []
    with pytest.raises(ValueError, match="repo-relative"):
        e.read_file("app", "../x")
    with pytest.raises(FileNotFoundError, match="app:src/no.py is not indexed"):
        e.read_file("app", "src/./no.py")


def test_modes_and_skip_reasons(make, repo):
    make(Keyword()).index_repo(repo)
    e = make(Keyword())
    assert all("bm25" not in h["score_reason"] for h in e.search("login", mode="vector")) and e.last.backend == "knn_l2"
    assert all("vector" not in h["score_reason"] for h in e.search("login", mode="lexical")) and e.last.reason is None
    assert {h["score_reason"] for h in e.search("login", mode="other")} <= {"path", "symbol", "path+symbol"}
    assert make().search("login") and (e2 := make()).search("login", mode="vector") and e2.last.reason == "embeddings-disabled"
    e3 = make(Failing())
    e3.search("login")
    assert e3.last.reason == "query-embedding-failed"


def test_no_embedded_chunks(make, repo):
    make().index_repo(repo)
    e = make(Keyword())
    e.search("login")
    assert e.last.reason == "no-embedded-chunks" and e.status()["degraded"]


def test_low_confidence(make, tmp_path):
    e = make(Keyword())
    e.index_repo(tree(tmp_path / "r", {"a.txt": "schedule\n", "b.txt": "other words\n"}))
    found = {h["path"]: h for h in e.search("zzz qqq")}
    assert found["a.txt"]["low_confidence"] and found["a.txt"]["vector_similarity"] == pytest.approx(0.4472) and not found["b.txt"]["low_confidence"]
    strict = make(Keyword(), low_confidence=1.01)
    assert all(h["low_confidence"] for h in strict.search("zzz qqq"))
    assert not {h["path"]: h for h in strict.search("other")}["b.txt"]["low_confidence"]


def test_cosine_scan_drops_what_is_not_positive(make, tmp_path):
    root = tree(tmp_path / "r", {"a.txt": "schedule\n"})
    make(Marker(-1.0)).index_repo(root)
    far = Marker(2.0)
    assert [h["vector_similarity"] for h in make(far).search("zzz")] == [pytest.approx(-0.3162, abs=1e-4)]
    assert make(far, vector_backend="cosine_scan").search("zzz") == []


def test_model_backend_and_dimension_changes_embed_anew(make, repo):
    def run(embedder):
        r = make(embedder).index_repo(repo)
        return r["indexed_files"], r["unchanged_files"]

    assert run(Marker(1, "m")) == (3, 0) and run(Marker(1, "m")) == (0, 3)
    assert run(Marker(2, "n")) == (3, 0)
    assert run(Marker(2, "n", "ollama", "http://127.0.0.1:1")) == (3, 0) and run(Marker(2, "n", "ollama", "http://127.0.0.1:1")) == (0, 3)
    assert run(None) == (0, 3)
    assert run(Dim(3)) == (3, 0) and run(Dim(3)) == (0, 3) and run(Dim(5)) == (3, 0)


def test_failed_vectors_are_tried_again(make, repo):
    r = make(Failing()).index_repo(repo)
    assert (r["indexed_files"], r["embedding_failures"], r["embedded_chunks"]) == (3, 3, 0)
    assert make(Keyword()).index_repo(repo)["embedded_chunks"] == 3


def test_batches_of_64(make, tmp_path):
    log = tmp_path / "log"
    r = make(Batch(log)).index_repo(tree(tmp_path / "r", {"big.txt": "".join(f"line {i}\n" for i in range(4600))}))
    assert (r["indexed_chunks"], r["embedded_chunks"]) == (66, 66) and batches(log) == [64, 2]


def test_breaker_stops_after_five_batches(make, tmp_path):
    log = tmp_path / "log"
    r = make(FailingBatch(log)).index_repo(tree(tmp_path / "r", {f"f{i}.py": f"def f{i}(): pass\n" for i in range(8)}))
    assert len(batches(log)) == 5 and r["degraded"] and (r["indexed_files"], r["embedding_failures"]) == (8, 5)


def test_a_failed_run_leaves_the_index(make, repo, monkeypatch):
    e = make()
    e.index_repo(repo)
    (repo / "new.py").write_text("def fresh(): pass\n")
    monkeypatch.setattr(e.store, "write", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError, match="disk"):
        e.index_repo(repo)
    monkeypatch.undo()
    assert e.status()["files"] == 3 and e.search("login")
    assert e.index_repo(repo)["indexed_files"] == 1


def test_ranking_is_that_of_full_text_search(make, tmp_path):
    import sqlite3

    from siftstone.functions.text import query_phrases

    words = "alpha beta gamma delta café index_repo search token zeta".split()
    files = {f"d{i}.txt": " ".join(words[(i * k) % len(words)] for k in range(1, 4 + i)) + "\n" for i in range(8)}
    e = make()
    e.index_repo(tree(tmp_path / "r", files))
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path, symbols, content)")
    for path, body in files.items():
        db.execute("insert into t values (?, '', ?)", (path, body))
    for query in ("alpha beta", "index_repo", "cafe zeta zeta", "gamma.delta"):
        match = " OR ".join('"' + " ".join(p) + '"' for p in query_phrases(query))
        want = [(p, round(s, 9)) for p, s in db.execute("select path, bm25(t) from t where t match ? order by 2, 1", (match,))]
        got = [h["path"] for h in e.search(query, mode="lexical", limit=50) if "bm25" in h["score_reason"]]
        assert sorted(got) == sorted(p for p, _ in want), query
        assert [round(4.0 - 0.03 * i, 4) for i in range(len(want))] == sorted((h["score"] for h in e.search(query, mode="lexical", limit=50)), reverse=True)
        best = [p for p, s in want if s == want[0][1]]
        assert got[0] in best


def test_versions_without_kinds_can_be_read(make, repo):
    e = make()
    e.index_repo(repo)
    (r,) = e.init().repos
    old = e.store.read("symbols", (r,)).drop("kind", "repo").collect()
    e.spark.createDataFrame(old, "path string, chunk_id string, symbol string, line int").write.mode("overwrite").parquet(e.store.folder("symbols", r))
    assert [s["kind"] for s in e.symbols(query="login")] == [""] and e.list_kinds() == []
    with pytest.raises(FileNotFoundError):
        e.read_file("", "README.md")


def test_settings(monkeypatch):
    from siftstone import config

    for raw, want in (("", 0.6), ("x", 0.6), (" 0.25 ", 0.25)):
        monkeypatch.setenv("SIFTSTONE_LOW_CONFIDENCE_SIMILARITY", raw)
        assert Options().doubtful == want
    monkeypatch.setenv("SIFTSTONE_DISABLE_EMBEDDINGS", "Yes")
    monkeypatch.setenv("SIFTSTONE_DB_PATH", "/x/y")
    assert config.embeddings_disabled() and config.store_path() == "/x/y"
