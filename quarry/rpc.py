"""JSON-RPC server over lines: two search tools."""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TextIO

from pyspark.sql import DataFrame

from .operators.search import Engine

NO_METHOD, FAILED = -32601, -32000
SNIPPET, LEAST_TOP, MOST_TOP, USUAL_TOP = 500, 1, 20, 5
TEXT, TEXTS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}


@dataclass(frozen=True)
class Tool:
    """A tool: what clients are told of it, and the search that it makes of the arguments."""

    description: str
    search: Callable[[Engine, str, int, dict], DataFrame]
    options: dict = field(default_factory=dict)

    def listing(self, name: str) -> dict:
        top = {"type": "integer", "default": USUAL_TOP, "minimum": LEAST_TOP, "maximum": MOST_TOP}
        return {"name": name, "description": self.description, "inputSchema": {"type": "object", "properties": {"query": TEXT, "top": top} | self.options, "required": ["query"]}}


#: Names of tools and of their arguments are a fixed interface.
TOOLS = {
    "rag_query": Tool(
        "Search all indexed chunks.",
        lambda engine, query, top, a: engine.search(query, top, a.get("scope_types"), a.get("scope_repos"), a.get("cwd"), bool(a.get("rerank", True))),
        {"scope_types": TEXTS, "scope_repos": TEXTS | {"description": "['all']: whatever the folder"}, "cwd": TEXT | {"description": "folder that decides the repo"}},
    ),
    "search_knowledge": Tool("Search notes, standards, plans and decisions.", lambda engine, query, top, _: engine.knowledge(query, top)),
}


def clamp(value) -> int:
    try:
        return sorted((LEAST_TOP, int(value), MOST_TOP))[1]
    except (TypeError, ValueError):
        return USUAL_TOP


def render(hits: list, size: int = SNIPPET, dots: bool = False) -> str:
    """Two lines a hit: place and scores, then its text on one line. The layout is a fixed format."""
    if not hits:
        return "No matches."
    out = []
    for h in hits:
        place = "/".join(x for x in (h["source_type"], h["repo"]) if x) + (f"::{h['symbol']}" if h["symbol"] else "")
        more = "…" if dots and len(h["text"]) > size else ""
        out += [f"#{h['rank']}  rrf={h['rrf']} cos={h['cos']} bm={h['bm25']}  [{place}]  {h['path']}:{h['start_line']}-{h['end_line']}", "  " + h["text"][:size].replace("\n", " ") + more]
    return "\n".join(out)


def _initialize(engine: Engine, params: dict) -> dict:
    return {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": "1"}}}


def _call(engine: Engine, params: dict) -> dict:
    """A missing query is a blank one, which finds nothing."""
    tool, given = TOOLS.get(params.get("name")), params.get("arguments") or {}
    if tool is None:
        return {"error": {"code": NO_METHOD, "message": f"no tool {params.get('name')}"}}
    try:
        found = tool.search(engine, given.get("query") or "", clamp(given.get("top")), given).collect()
    except Exception as e:
        return {"error": {"code": FAILED, "message": (str(e) or type(e).__name__).splitlines()[0]}}
    return {"result": {"content": [{"type": "text", "text": render(found)}], "isError": False}}


METHODS = {"initialize": _initialize, "tools/list": lambda engine, params: {"result": {"tools": [t.listing(n) for n, t in TOOLS.items()]}}, "tools/call": _call}


def answer(engine: Engine, message: dict) -> dict | None:
    """The response to one request; None for what has no id and no method of ours."""
    method, number = message.get("method"), message.get("id")
    if method in METHODS:
        return {"jsonrpc": "2.0", "id": number} | METHODS[method](engine, message.get("params") or {})
    if number is None or method == "notifications/initialized":
        return None
    return {"jsonrpc": "2.0", "id": number, "error": {"code": NO_METHOD, "message": f"no method {method}"}}


def prewarm(engine: Engine, log: TextIO = sys.stderr) -> threading.Thread:
    """Makes indexes and loads models beside the first requests; a question that needs them waits. If it fails, questions make them."""

    def run() -> None:
        try:
            engine.warm()
            print("warm", file=log)
        except Exception as e:
            print(f"not warm: {e}".splitlines()[0], file=log)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return thread


def serve(engine: Engine, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """One request a line; lines that aren't JSON objects are passed over. A response is flushed at once."""
    for line in source:
        try:
            message = json.loads(line)
        except ValueError:
            continue
        if isinstance(message, dict) and (out := answer(engine, message)) is not None:
            sink.write(json.dumps(out) + "\n")
            sink.flush()
