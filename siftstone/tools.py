"""The engine's queries as tools: JSON strings in answer, empty strings for filters that aren't set; and their server on stdio."""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Callable
from typing import IO, Any, get_type_hints

from siftstone import __version__
from siftstone.config import embeddings_disabled, store_path
from siftstone.service import Engine
from siftstone.sources.embedders import LocalEmbedder


def engine() -> Engine:
    return Engine(store_path(), None if embeddings_disabled() else LocalEmbedder())


def as_json(value: Any) -> str:
    return json.dumps(value, indent=2, sort_keys=True)


def code_index_search(query: str, repo: str = "", mode: str = "hybrid", limit: int = 10, path: str = "", lang: str = "", kind: str = "") -> str:
    """Search indexed code by words, vectors, paths, symbols and kinds of symbols. If every hit has low_confidence, nothing good was found."""
    return as_json(engine().search(query, repo or None, limit, mode, path or None, lang or None, kind or None))


def code_index_list_files(repo: str = "", glob: str = "", limit: int = 50, lang: str = "") -> str:
    """List indexed files, of one repository or whose paths match a glob."""
    return as_json(engine().list_files(repo or None, glob or None, limit, lang or None))


def code_index_list_repos() -> str:
    """List indexed repositories with numbers of files, chunks and vectors."""
    return as_json(engine().list_repos())


def code_index_read_file(repo: str, path: str, start_line: int | None = None, end_line: int | None = None) -> str:
    """Read lines of an indexed file by its path in the repository."""
    return as_json(engine().read_file(repo, path, start_line, end_line))


def code_index_symbols(repo: str = "", query: str = "", path: str = "", limit: int = 50, lang: str = "", kind: str = "") -> str:
    """Find symbols by repository, text, path, language and kind."""
    return as_json(engine().symbols(repo or None, query or None, path or None, limit, lang or None, kind or None))


def code_index_status(repo: str = "") -> str:
    """Status of the index: repositories, files, chunks, vectors."""
    return as_json(engine().status(repo or None))


TOOLS: dict[str, Callable[..., str]] = {f.__name__: f for f in (code_index_search, code_index_list_files, code_index_list_repos, code_index_read_file, code_index_symbols, code_index_status)}


def index_path(repo_path: str, name: str = "") -> str:
    return as_json(engine().index_repo(repo_path, name or None))


# --- the server ------------------------------------------------------------------------------------------------------

PROTOCOL = "2024-11-05"


def described(tool: Callable[..., str]) -> dict:
    """Name, description and JSON schema of a tool's arguments."""
    hints, required, properties = get_type_hints(tool), [], {}
    for name, p in inspect.signature(tool).parameters.items():
        properties[name] = {"type": "string" if hints[name] is str else "integer"}
        if p.default is inspect.Parameter.empty:
            required.append(name)
        elif p.default is not None:
            properties[name]["default"] = p.default
    return {"name": tool.__name__, "description": tool.__doc__ or "", "inputSchema": {"type": "object", "properties": properties, "required": required}}


def answer(method: str, params: dict) -> dict:
    """The result of a request; LookupError for an unknown method. A tool's own error is a result that says so."""
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "siftstone", "version": __version__}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [described(t) for t in TOOLS.values()]}
    if method == "tools/call":
        try:
            text, failed = TOOLS[params["name"]](**params.get("arguments", {})), False
        except Exception as e:
            text, failed = f"{type(e).__name__}: {e}", True
        return {"content": [{"type": "text", "text": text}], "isError": failed}
    raise LookupError(method)


def serve(lines: IO[str] | None = None, out: IO[str] | None = None) -> None:
    """Answer JSON-RPC requests, one a line, until the input ends; notifications get no answer."""
    lines, out = lines or sys.stdin, out or sys.stdout
    for line in lines:
        if not line.strip():
            continue
        try:
            said = json.loads(line)
            if "id" not in said:
                continue
            reply = {"jsonrpc": "2.0", "id": said["id"], "result": answer(said["method"], said.get("params") or {})}
        except LookupError as e:
            reply = {"jsonrpc": "2.0", "id": said.get("id"), "error": {"code": -32601, "message": f"unknown method {e}"}}
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        print(json.dumps(reply), file=out, flush=True)
