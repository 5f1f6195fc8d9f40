import io
import json

import pytest

from siftstone import __version__, cli, tools
from siftstone.service import Engine
from test_ignore import tree


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    repo = tree(root / "app", {"src/auth.py": "def login():\n    return 1\n", "notes.md": "calendar notes\n"})
    return Engine(root / "index", None, spark), repo


@pytest.fixture
def run(index, monkeypatch, capsys):
    monkeypatch.setattr(cli, "make_engine", lambda: index[0])
    monkeypatch.setattr(tools, "engine", lambda: index[0])

    def ran(*args):
        cli.main(list(map(str, args)))
        return capsys.readouterr().out

    return ran


def test_a_session(run, index, capsys):
    repo = index[1]
    assert run("search", "x").strip() == cli.NO_REPOS and run("list-repos").strip() == cli.NO_REPOS
    assert run("init").startswith(f"version: {__version__}\n") and "  No repos." in run("status")
    out = run("index", repo)
    assert out.startswith(f"Indexed app path={repo} indexed_files=2 unchanged_files=0 skipped_files=0") and out.strip().endswith("degraded=False")
    assert set(json.loads(run("--json", "index", repo))) == set(json.loads(run("index", repo, "--json")))
    (hit,) = json.loads(run("search", "login", "--json"))
    assert (hit["path"], hit["score_reason"], hit["low_confidence"], hit["vector_similarity"]) == ("src/auth.py", "bm25+symbol", False, None)
    assert run("search", "login").startswith("app src/auth.py:1-2\nscore: 6.0  score_reason: bm25+symbol\nsymbols: login\ndef login():")
    assert run("symbols", "login").strip() == "app src/auth.py:1 function login"
    assert run("list-files", "--lang", "md").startswith("app notes.md language=md size=15 indexed_at=")
    assert run("read-file", "app", "notes.md") == "calendar notes\n"
    assert "  app files=2 chunks=2 embedded_chunks=0" in run("status", "--repo", "app")
    assert run("list-repos").startswith("app files=2 chunks=2")
    assert run("reindex-all").strip().endswith("reindexed: 1")
    assert run("search", "zzzz", "--lang", "rs", "--kind", "trait").splitlines() == ["No results.", "note: --lang 'rs' matches nothing. indexed languages: md, py", "note: --kind 'trait' matches nothing. indexed kinds: function"]
    assert "embeddings are disabled" in run("search", "zzzz", "--mode", "vector")
    with pytest.raises(SystemExit) as e:
        run("search", "x", "--repo", "no")
    assert e.value.code == 1 and capsys.readouterr().err == "error: unknown repo: no. indexed repos: app\n"
    requests = [{"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "code_index_search", "arguments": {"query": "login"}}}, {"id": 4, "method": "tools/call", "params": {"name": "code_index_read_file", "arguments": {"repo": "no", "path": "x"}}}, {"id": 5, "method": "no"}]
    sent = io.StringIO()
    tools.serve(io.StringIO("\n".join(json.dumps({"jsonrpc": "2.0"} | r) for r in requests) + "\nnot json\n"), sent)
    replies = [json.loads(x) for x in sent.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, None]
    assert len(replies[1]["result"]["tools"]) == 6 and replies[1]["result"]["tools"][0]["inputSchema"]["required"] == ["query"]
    assert json.loads(replies[2]["result"]["content"][0]["text"])[0]["path"] == "src/auth.py" and replies[3]["result"]["isError"] and replies[4]["error"]["code"] == -32601
    assert json.loads(tools.code_index_status())["files"] == 2 and json.loads(tools.code_index_symbols(query="login")) and json.loads(tools.code_index_list_repos()) and json.loads(tools.code_index_list_files(glob="*.md"))
    assert run("remove", "app").strip() == "Removed app (2 files)."


def test_argument_errors(run, tmp_path):
    for args in (["index", tmp_path / "no"], ["watch", tmp_path, "--interval", "0"], ["search", "x", "--mode", "odd"], []):
        with pytest.raises(SystemExit) as e:
            run(*args)
        assert e.value.code == 2


def test_client_configuration(run):
    assert json.loads(run("mcp-config", "--client", "claude", "--db-path", "/x"))["mcpServers"]["siftstone"] == {"command": "siftstone", "args": ["mcp"], "env": {"SIFTSTONE_DB_PATH": "/x"}}
    assert "mcp_servers" in json.loads(run("mcp-config", "--client", "codex"))


def test_low_confidence_note():
    row = {"repo": "r", "path": "p", "start_line": 1, "end_line": 2, "score": 1.0, "score_reason": "vector", "low_confidence": True, "symbols": [], "snippet": "s"}
    assert cli.search_text([row]).endswith("note: every result is a low-confidence vector-only match; the query may have no good match in the index.") and "symbols: (none)" in cli.search_text([row])
    assert "note" not in cli.search_text([row, row | {"low_confidence": False}])
