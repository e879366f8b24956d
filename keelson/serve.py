"""A local, read-only service over one scanned project: its model, its sources, its changes."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote_plus

from .streaming.watch import POLL_SECONDS

HOST, PORT = "127.0.0.1", 4477
#: Seconds after which an event stream shows that it is alive, and bytes that a request's head may have.
KEEPALIVE, LARGEST_HEAD = 15.0, 16 * 1024

_PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>workbench</title></head><body><pre id="out"></pre><script>
const show = async () => { const r = await fetch('/api/model'); document.getElementById('out').textContent = JSON.stringify(await r.json(), null, 1); };
new EventSource('/api/events').onmessage = show; show();
</script></body></html>"""


def parameter(query: str, key: str) -> str | None:
    """One parameter of a query string, decoded: %xx, and + for a blank."""
    for part in query.split("&"):
        name, mark, value = part.partition("=")
        if mark and name == key:
            return unquote_plus(value, errors="replace")
    return None


class Workbench:
    """What is served: the last good payload and texts, a version that grows with each success, and
    the error of the last attempt, if it failed."""

    def __init__(self, scan: Callable[[], tuple[dict, dict[str, str]]], mark: Callable[[], object] | None = None, poll: float = POLL_SECONDS):
        """scan makes a payload and the texts by file; mark tells a state of the files from another."""
        self.scan, self.mark, self.poll = scan, mark, poll
        self.changed = threading.Condition()
        self.seq, self.version, self.error, self.closed = 0, 0, None, False
        self.payload: dict = {}
        self.texts: dict[str, str] = {}
        self.attempt()

    def attempt(self) -> None:
        """Scans; a failure keeps what was good."""
        try:
            payload, texts = self.scan()
        except Exception as failure:
            with self.changed:
                self.error, self.seq = str(failure).splitlines()[0] if str(failure) else type(failure).__name__, self.seq + 1
                self.changed.notify_all()
            return
        with self.changed:
            self.payload, self.texts, self.error = payload, texts, None
            self.version, self.seq = self.version + 1, self.seq + 1
            self.changed.notify_all()

    def model(self) -> bytes:
        with self.changed:
            return json.dumps(self.payload | {"version": self.version, "error": self.error, "watching": self.mark is not None, "changes": False}).encode()

    def watch(self) -> None:
        """Scans again when the files have changed and then been quiet for one poll."""
        known = pending = self.mark()
        while True:
            with self.changed:
                if self.changed.wait_for(lambda: self.closed, self.poll):
                    return
            now = self.mark()
            if now == pending and now != known:
                known = now
                self.attempt()
            pending = now

    def close(self) -> None:
        with self.changed:
            self.closed = True
            self.changed.notify_all()


def _handler(bench: Workbench) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        timeout = 5

        def log_message(self, *args) -> None:
            pass

        def answer(self, code: int, kind: str, body: bytes) -> None:
            self.send_response(code)
            for name, value in (("content-type", kind), ("content-length", str(len(body))), ("cache-control", "no-store"), ("x-content-type-options", "nosniff"), ("connection", "close")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body)
            self.close_connection = True

        def fail(self, code: int, error: str) -> None:
            self.answer(code, "application/json", json.dumps({"error": error}).encode())

        def handle_any(self) -> None:
            port = self.server.server_address[1]
            if len(self.requestline) + sum(len(k) + len(v) + 4 for k, v in self.headers.items()) > LARGEST_HEAD:
                return self.fail(431, "headers too large")
            if self.headers.get("host") not in (f"{HOST}:{port}", f"localhost:{port}"):  # a page elsewhere may have named us
                return self.fail(403, "wrong host")
            if self.command != "GET":
                return self.fail(405, "read-only")
            path, _, query = self.path.partition("?")
            if path == "/":
                return self.answer(200, "text/html; charset=utf-8", _PAGE.encode())
            if path == "/api/model":
                return self.answer(200, "application/json; charset=utf-8", bench.model())
            if path == "/api/source":
                text = bench.texts.get(parameter(query, "file") or "")
                return self.fail(404, "not a scanned file") if text is None else self.answer(200, "text/plain; charset=utf-8", text.encode())
            if path == "/api/change":
                return self.fail(501, "changes are not shown yet")
            if path == "/api/events":
                return self.events()
            if path == "/favicon.ico":
                return self.answer(204, "image/x-icon", b"")
            return self.fail(404, "no such route")

        do_GET = do_POST = do_PUT = do_DELETE = do_HEAD = do_PATCH = do_OPTIONS = handle_any

        def events(self) -> None:
            self.send_response(200)
            for name, value in (("content-type", "text/event-stream"), ("cache-control", "no-store"), ("connection", "keep-alive")):
                self.send_header(name, value)
            self.end_headers()
            seen = 0
            while True:
                with bench.changed:
                    bench.changed.wait_for(lambda: bench.closed or bench.seq != seen, KEEPALIVE)  # noqa: B023
                    if bench.closed:
                        self.close_connection = True
                        return
                    line = ": keepalive\n\n" if bench.seq == seen else f"data: {json.dumps({'version': bench.version, 'error': bench.error})}\n\n"
                    seen = bench.seq
                try:
                    self.wfile.write(line.encode())  # not with the lock held
                    self.wfile.flush()
                except OSError:
                    self.close_connection = True
                    return

    return Handler


def serve(bench: Workbench, port: int = PORT) -> ThreadingHTTPServer:
    """A server on the loopback address, with its watcher; the caller runs serve_forever()."""
    server = ThreadingHTTPServer((HOST, port), _handler(bench))
    server.daemon_threads = True
    if bench.mark is not None:
        threading.Thread(target=bench.watch, daemon=True).start()
    return server
