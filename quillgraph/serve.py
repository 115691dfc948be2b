"""The tools for other programs: JSON-RPC 2.0 messages of the Model Context Protocol, by line or over HTTP.

``serve_lines`` reads a message a line and answers in lines, for one client. ``http_server`` gives each client a session
(header ``Mcp-Session-Id``) at ``/mcp``, all on one store, and a liveness probe at ``/health``. It starts no messages of its
own, so it has no event stream. A tool's schema follows from its signature.
"""

from __future__ import annotations

import inspect
import json
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, TextIO

from .facade import KnowledgeGraph
from .operators.graph import MAX_DEPTH

#: Versions of the protocol that are spoken, the newest first, and codes of JSON-RPC.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE_ERROR, INVALID_REQUEST, UNKNOWN_METHOD, INVALID_PARAMS, INTERNAL, NO_SESSION = -32700, -32600, -32601, -32602, -32603, -32000

ABOUT = {
    "kb_find": "Ranked full-text search over names and bodies: phrases, prefixes, AND, OR, NOT, NEAR; hits are marked << >> in a snippet.",
    "kb_get": "One record by its id.",
    "kb_by_term": "Records that list a keyword, whatever its letter case; the latest first.",
    "kb_traverse": "Breadth-first walk along outgoing relations.",
    "kb_related": "Relations at both sides of a record.",
    "kb_add_entity": "Add a record, or replace it as a whole.",
    "kb_add_edge": "Add a relation between two records, or replace its metadata.",
}
_BOUNDS = {"limit": {"minimum": 1, "maximum": 100}, "maxDepth": {"minimum": 0, "maximum": MAX_DEPTH}}


def tool_schema(kg: KnowledgeGraph, name: str) -> dict:
    """Arguments of a tool as a JSON schema."""
    properties, required = {}, []
    for p in inspect.signature(getattr(kg, name)).parameters.values():
        head, *rest = p.name.split("_")
        key, kind = head + "".join(x.title() for x in rest), str(p.annotation).split(" |")[0]
        properties[key] = {"type": {"str": "string", "int": "integer", "dict": "object"}[kind]} | _BOUNDS.get(key, {})
        if p.default is p.empty:
            required.append(key)
            properties[key] |= {"minLength": 1} if kind == "str" else {}
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


class Session:
    """One client's conversation."""

    def __init__(self, kg: KnowledgeGraph, name: str = "quillgraph"):
        self.kg, self.name = kg, name

    def answer(self, message: Any) -> dict | list | None:
        """The answer to a message or a batch; none to a notification."""
        if isinstance(message, list) and message:
            return [a for a in map(self.answer, message) if a is not None] or None
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return failure(message.get("id") if isinstance(message, dict) else None, INVALID_REQUEST, "not a request")
        if "id" not in message:
            return None
        params = message.get("params", {})
        try:
            method = {"initialize": self._initialize, "ping": lambda p: {}, "tools/list": self._tools, "tools/call": self._call}.get(message["method"])
            if method is None:
                return failure(message["id"], UNKNOWN_METHOD, f"unknown method {message['method']}")
            if not isinstance(params, dict):
                return failure(message["id"], INVALID_PARAMS, "params must be an object")
            return {"jsonrpc": "2.0", "id": message["id"], "result": method(params)}
        except Exception as error:  # a failing tool must not end the conversation
            return failure(message["id"], INTERNAL, type(error).__name__)

    def _initialize(self, params: dict) -> dict:
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": "1"}}

    def _tools(self, params: dict) -> dict:
        return {"tools": [{"name": t, "description": ABOUT[t], "inputSchema": tool_schema(self.kg, t)} for t in self.kg.tools()]}

    def _call(self, params: dict) -> dict:
        result = self.kg.call(str(params.get("name")), **(params.get("arguments") or {}))
        failed = bool(result.pop("isError", False))
        return {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False, indent=2, default=str)}], "isError": failed}


def failure(id: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id, "error": {"code": code, "message": message}}


def serve_lines(kg: KnowledgeGraph, lines: TextIO, out: TextIO) -> None:
    """Answer a message a line until the lines end."""
    session = Session(kg)
    for line in lines:
        if not line.strip():
            continue
        try:
            answer = session.answer(json.loads(line))
        except json.JSONDecodeError:
            answer = failure(None, PARSE_ERROR, "not JSON")
        if answer is not None:
            print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)


def http_server(kg: KnowledgeGraph, port: int = 3001, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that has not started: ``serve_forever`` runs it. Port 0 takes a free one."""
    sessions: dict[str, Session] = {}

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def _send(self, status: int, body: Any = None, **headers: str) -> None:
            data = b"" if body is None else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            for key, value in {"Content-Type": "application/json", "Content-Length": str(len(data)), **headers}.items():
                self.send_header(key.replace("_", "-"), value)
            self.end_headers()
            self.wfile.write(data)

        def _session(self) -> Session | None:
            return sessions.get(self.headers.get("Mcp-Session-Id", ""))

        def do_GET(self) -> None:
            if self.path == "/health":
                self._send(200, {"status": "ok"})
            elif self.path == "/mcp":
                self._send(405 if self._session() else 400, failure(None, NO_SESSION, "no event stream" if self._session() else "no valid session"))
            else:
                self._send(404)

        def do_DELETE(self) -> None:
            ended = self.path == "/mcp" and sessions.pop(self.headers.get("Mcp-Session-Id", ""), None)
            self._send(200 if ended else 400)

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            if self.path != "/mcp":
                return self._send(404)
            try:
                message = json.loads(body)
            except ValueError:
                return self._send(400, failure(None, PARSE_ERROR, "not JSON"))
            session, headers = self._session(), {}
            if session is None:
                first = isinstance(message, dict) and message.get("method") == "initialize" and "Mcp-Session-Id" not in self.headers
                if not first:
                    return self._send(400, failure(None, NO_SESSION, "no valid session"))
                session, key = Session(kg), uuid.uuid4().hex
                sessions[key], headers = session, {"Mcp_Session_Id": key}
            answer = session.answer(message)
            self._send(202 if answer is None else 200, answer, **headers)

    return ThreadingHTTPServer((host, port), Handler)
