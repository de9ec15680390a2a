"""HTTP front ends: the store's API, and its metrics on a port of their own."""

from __future__ import annotations

import base64
import json
import logging
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from urllib.parse import parse_qs, unquote_to_bytes, urlsplit

from tidemark.model import ClosedError, ConflictError, EmptyKeyError, NotFoundError
from tidemark.plans.store import Store

LARGEST_BODY, ROWS_A_CHUNK = 64 << 20, 500
_STATUS = {NotFoundError: 404, EmptyKeyError: 400, ClosedError: 503, ConflictError: 503}


class _Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    store: Store
    logger: logging.Logger

    def log_message(self, *_) -> None:
        pass

    def _send(self, status: int, body: bytes = b"", kind: str = "text/plain; charset=utf-8") -> None:
        self.status = status
        self.send_response(status)
        if status != 204:
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if status != 204:
            self.wfile.write(body)

    def _fail(self, status: int, text: str) -> None:
        self._send(status, f"{text}\n".encode())

    def _json(self, value) -> None:
        self._send(200, json.dumps(value, separators=(",", ":")).encode() + b"\n", "application/json")

    def _key(self, path: str) -> bytes | None:
        """The one path segment after /kv/, if there is one."""
        raw = path.removeprefix("/kv/")
        return unquote_to_bytes(raw) if path.startswith("/kv/") and raw and "/" not in raw else None

    def _run(self, routes) -> None:
        began, self.status = time.perf_counter(), 0
        url = urlsplit(self.path)
        try:
            routes(url)
        except tuple(_STATUS) as error:
            self._fail(_STATUS[type(error)], str(error))
        except Exception:
            self.logger.exception("internal server error")
            self._fail(500, "internal error")
        self.logger.info("http request method=%s path=%s status=%d duration_ms=%d", self.command, url.path, self.status, (time.perf_counter() - began) * 1000)

    def _body(self) -> bytes | None:
        """The request's body, whole or in chunks; None if that was answered with an error, and the connection ends."""
        chunked, size = self.headers.get("Transfer-Encoding", "").strip().lower() == "chunked", self.headers.get("Content-Length", "0").strip()
        status, text, parts, total = 413, "request body too large", [], 0
        if not chunked and self.headers.get("Transfer-Encoding"):
            status, text = 501, "unknown transfer encoding"
        elif not chunked and size.isascii() and size.isdecimal():
            if int(size) <= LARGEST_BODY:
                body = self.rfile.read(int(size))
                if len(body) == int(size):
                    return body
                status, text = 400, "request body ends early"
        elif not chunked:
            status, text = 400, "invalid length"
        else:
            while total <= LARGEST_BODY:
                head = self.rfile.readline(1 << 10).split(b";")[0].strip()
                try:
                    length = int(head, 16) if re.fullmatch(rb"[0-9A-Fa-f]{1,15}", head) else -1
                    if length < 0 or total + length > LARGEST_BODY:
                        status, text = (400, "invalid chunk") if length < 0 else (status, text)
                        break
                    if not length:
                        while self.rfile.readline(1 << 16).strip():
                            pass
                        return b"".join(parts)
                    parts.append(self.rfile.read(length))
                    if len(parts[-1]) < length or self.rfile.read(2) != b"\r\n":
                        status, text = 400, "invalid chunk"
                        break
                    total += length
                except ValueError:
                    status, text = 400, "invalid chunk"
                    break
        self.close_connection = True
        self._fail(status, text)
        return None

    def do_PUT(self) -> None:  # noqa: N802
        def routes(url) -> None:
            body = self._body()
            if body is None:
                return
            key = self._key(url.path)
            if key is None:
                self._fail(404, "page not found")
                return
            self.store.put(key, body)
            self._send(204)

        self._run(routes)

    def do_DELETE(self) -> None:  # noqa: N802
        def routes(url) -> None:
            key = self._key(url.path)
            if key is None:
                self._fail(404, "page not found")
                return
            self.store.delete(key)
            self._send(204)

        self._run(routes)

    def do_GET(self) -> None:  # noqa: N802
        def routes(url) -> None:
            if url.path == "/healthz":
                self._send(200, b"ok")
            elif url.path == "/stats":
                self._json(self.store.stats())
            elif url.path == "/scan":
                self._scan(parse_qs(url.query, encoding="utf-8", errors="surrogateescape"))
            elif (key := self._key(url.path)) is not None:
                self._send(200, self.store.get(key), "application/octet-stream")
            else:
                self._fail(404, "page not found")

        self._run(routes)

    def _scan(self, query: dict[str, list[str]]) -> None:
        def bound(name: str) -> bytes | None:
            text = query.get(name, [""])[0]
            return text.encode("utf-8", "surrogateescape") or None

        limit = query.get("limit", ["0"])[0]
        if not re.fullmatch(r"\+?[0-9]{1,18}", limit):
            self._fail(400, "invalid limit")
            return
        rows = self.store.rows(bound("start"), bound("end"), min(int(limit), (1 << 31) - 1))
        first = next(rows, None)
        self.status = 200
        self.send_response(200)
        self.send_header("Content-Type", "application/json")
        self.send_header("Transfer-Encoding", "chunked")
        self.end_headers()
        held = [b"["]
        try:
            for i, (k, v) in enumerate(() if first is None else chain([first], rows)):
                held.append(b"," * (i > 0) + json.dumps({"key": base64.b64encode(k).decode(), "value": base64.b64encode(v).decode()}, separators=(",", ":")).encode())
                if len(held) == ROWS_A_CHUNK:
                    self._chunk(b"".join(held))
                    held = []
            self._chunk(b"".join([*held, b"]\n"]))
            self.wfile.write(b"0\r\n\r\n")
        except Exception:
            # the answer has begun: it ends without its last chunk
            self.logger.exception("scan ended early")
            self.close_connection = True

    def _chunk(self, data: bytes) -> None:
        self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")


class _Metrics(BaseHTTPRequestHandler):
    store: Store

    def log_message(self, *_) -> None:
        pass

    def do_GET(self) -> None:  # noqa: N802
        found = urlsplit(self.path).path == "/metrics"
        body = self.store.render_metrics().encode() if found else b"page not found\n"
        self.send_response(200 if found else 404)
        self.send_header("Content-Type", "text/plain; version=0.0.4" if found else "text/plain")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)


def address(text: str) -> tuple[str, int]:
    """``host:port``, or ``:port`` for all interfaces."""
    host, _, port = text.rpartition(":")
    return host, int(port)


def start(store: Store, at: str, metrics: bool = False, logger: logging.Logger | None = None) -> ThreadingHTTPServer:
    """A server in a thread of its own; shutdown() ends it."""
    base = _Metrics if metrics else _Handler
    handler = type("Handler", (base,), {"store": store, "logger": logger or logging.getLogger("tidemark")})
    server = ThreadingHTTPServer(address(at), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
