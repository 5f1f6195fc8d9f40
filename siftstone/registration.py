"""Configuration snippets that register the tool server with a client."""

from __future__ import annotations

COMMAND = {"command": "siftstone", "args": ["mcp"]}


def _server(db_path: str | None) -> dict:
    return COMMAND | ({"env": {"SIFTSTONE_DB_PATH": str(db_path)}} if db_path else {})


def claude_config(db_path: str | None = None) -> dict:
    return {"mcpServers": {"siftstone": _server(db_path)}}


def codex_config(db_path: str | None = None) -> dict:
    return {"mcp_servers": {"siftstone": _server(db_path)}}
