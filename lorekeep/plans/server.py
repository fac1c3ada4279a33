"""The searches of a session for a client program: JSON-RPC requests, one a line, answered one a line.

The protocol is that of model context servers: a handshake, a list of tools and
calls of these.  A failure of a tool is an answer whose text begins with its kind;
only what is no request is an error of the protocol.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any, TextIO

from pyspark.sql import functions as F

from ..functions.text import citation
from ..operators import retrieval
from ..operators.embedding import DailyQuotaExceeded, RateLimited
from ..sources.settings import SettingsError
from . import runs
from .service import MOST_RESULTS, Service, tagged

#: The protocol's version, and its codes for what is no request.
PROTOCOL = "2025-06-18"
NOT_JSON, NOT_A_REQUEST, NO_METHOD, BAD_ARGUMENTS = -32700, -32600, -32601, -32602
TOOLS: dict[str, dict[str, Any]] = {
    "list_projects": {"description": "Names of the projects that can be searched. Costs no search.", "arguments": {}, "needed": []},
    "search": {
        "description": "Passages nearest in meaning to a question, the best first, each with its text, its place and its date. Cite a passage by its citation. That a passage comes back does not mean that it answers. Counts as one search of the session.",
        "arguments": {
            "query": {"type": "string", "description": "what is looked for, in plain words"},
            "k": {"type": "integer", "minimum": 1, "maximum": MOST_RESULTS, "default": retrieval.SEARCH_K},
            "project": {"type": "string", "description": "only this project, whatever its case"},
        },
        "needed": ["query"],
    },
}
FAILURES = (runs.SessionCapReached, SettingsError, retrieval.RetrievalError, DailyQuotaExceeded, RateLimited, ValueError, RuntimeError, OSError)


class BadRequest(ValueError):
    def __init__(self, code: int, said: str):
        super().__init__(said)
        self.code = code


class Server:
    """Answers requests with the searches of one session."""

    def __init__(self, service: Service, name: str = "lorekeep"):
        self._service, self._name = service, name
        self._methods = {"initialize": self._greet, "ping": lambda _: {}, "tools/list": self._tools, "tools/call": self._call}

    def serve(self, requests: Iterable[str], answers: TextIO) -> None:
        for line in requests:
            if line.strip() and (answer := self.answer(line)) is not None:
                answers.write(json.dumps(answer, ensure_ascii=False) + "\n")
                answers.flush()

    def answer(self, line: str) -> dict | None:
        """The answer to one line, None to a notification."""
        number = None
        try:
            try:
                asked = json.loads(line)
            except ValueError as problem:
                raise BadRequest(NOT_JSON, f"not JSON: {problem}") from problem
            if not isinstance(asked, dict) or not isinstance(asked.get("method"), str):
                raise BadRequest(NOT_A_REQUEST, "no request")
            number = asked.get("id")
            if number is None:
                return None
            if asked["method"] not in self._methods:
                raise BadRequest(NO_METHOD, f"no method {asked['method']!r}")
            return {"jsonrpc": "2.0", "id": number, "result": self._methods[asked["method"]](asked.get("params") or {})}
        except BadRequest as problem:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": problem.code, "message": str(problem)}}

    def _greet(self, _: dict) -> dict:
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": self._name, "version": "1"}}

    def _tools(self, _: dict) -> dict:
        shape = lambda t: {"type": "object", "properties": t["arguments"], "required": t["needed"]}
        return {"tools": [{"name": n, "description": t["description"], "inputSchema": shape(t), "annotations": {"readOnlyHint": True}} for n, t in TOOLS.items()]}

    def _call(self, params: dict) -> dict:
        given = params.get("arguments") or {}
        if params.get("name") not in TOOLS:
            raise BadRequest(BAD_ARGUMENTS, f"no tool {params.get('name')!r}")
        tool = TOOLS[params["name"]]
        if not isinstance(given, dict) or set(given) - set(tool["arguments"]) or set(tool["needed"]) - set(given):
            raise BadRequest(BAD_ARGUMENTS, f"{params['name']} takes {sorted(tool['arguments'])} and needs {tool['needed']}")
        kinds = {"string": str, "integer": int}
        for key, value in given.items():
            if not isinstance(value, kinds[tool["arguments"][key]["type"]]) or isinstance(value, bool):
                raise BadRequest(BAD_ARGUMENTS, f"{key} must be of type {tool['arguments'][key]['type']}")
        try:
            found = {"projects": self._service.projects()} if params["name"] == "list_projects" else self._search(**given)
        except FAILURES as problem:
            return {"content": [{"type": "text", "text": tagged(problem)}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}], "structuredContent": found, "isError": False}

    def _search(self, query: str, k: int = retrieval.SEARCH_K, project: str | None = None) -> dict:
        rows = runs.dated(self._service.search(query, k, project)).orderBy("rank")
        shown = rows.select(
            "rank", "score", citation("project", "rel_path", F.lit("")).alias("citation"), "project", F.col("rel_path").alias("location"),
            F.col("heading_path").alias("heading"), "source", "commit", "date", F.col("dated_by").alias("date_source"), "text",
        )
        return {"query": query, "results": [r.asDict() for r in shown.collect()]}
