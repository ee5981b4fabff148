"""Receivers of pushed messages (HTTP, SOAP, TCP), run beside Spark: they land JSON lines that a stream reads.

A message becomes a line ``{"topic", "content", "batch", "binary"}``; binary content is base64. Lines
are written to a hidden file that is renamed once it is whole, so that Spark never sees half a line.
"""

from __future__ import annotations

import base64
import json
import os
import socketserver
import struct
import threading
import urllib.parse
import uuid
import xml.etree.ElementTree as ET
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..operators.records import frames

#: Seconds after which a silent connection is closed.
IDLE = 20.0


class Landing:
    """Lines on their way to a folder. What ``add`` has accepted is on disk under its final name.

    Lines that come at about the same time share a file: the first one waits ``delay`` seconds for
    others, or until there are ``rows``, and whoever waits with it is answered after the file has
    been synced and renamed. If that fails all of them get the error.
    """

    def __init__(self, folder: str, topics: set[str], rows: int = 1000, delay: float = 0.02):
        self.folder, self.topics, self.rows, self.delay = folder, topics, rows, delay
        self.lock = threading.Lock()
        self.group = _Group()
        os.makedirs(folder, exist_ok=True)

    def add(self, topic: str, content: str | bytes, batch: bool = False) -> bool:
        """False for an unknown topic, else true once the line is on disk."""
        return self.add_all([(topic, content, batch)])

    def add_all(self, messages: list[tuple]) -> bool:
        """All messages or none: false if one has an unknown topic."""
        lines = []
        for topic, content, *batch in messages:
            if topic not in self.topics:
                return False
            binary = isinstance(content, bytes)
            text = base64.b64encode(content).decode() if binary else content
            lines.append(json.dumps({"topic": topic, "content": text, "batch": bool(batch and batch[0]), "binary": binary}))
        if not lines:
            return True
        with self.lock:
            group, first = self.group, not self.group.lines
            group.lines += lines
            if len(group.lines) >= self.rows:
                self.group = _Group()
                group.full.set()
        if first:
            group.full.wait(self.delay)
            with self.lock:
                if self.group is group:
                    self.group = _Group()
            self._land(group)
        group.done.wait()
        if group.error:
            raise group.error
        return True

    def _land(self, group: _Group) -> None:
        name = uuid.uuid4().hex
        try:
            with open(f"{self.folder}/.{name}", "w", encoding="utf-8") as f:
                f.write("\n".join(group.lines) + "\n")
                f.flush()
                os.fsync(f.fileno())
            os.replace(f"{self.folder}/.{name}", f"{self.folder}/{name}.json")
        except OSError as e:
            group.error = e
        finally:
            group.done.set()


class _Group:
    """Lines of one file; ``full`` ends the wait for more, ``done`` the wait of all who sent them."""

    def __init__(self):
        self.lines: list[str] = []
        self.full, self.done = threading.Event(), threading.Event()
        self.error: OSError | None = None


def http_server(landing: Landing, port: int = 0, key: str = "content") -> ThreadingHTTPServer:
    """``POST /{topic}``: a form with ``content`` and ``isBatch``, a binary stream of frames, or a SOAP ``sendData``."""

    class Handler(BaseHTTPRequestHandler):
        timeout = IDLE

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            kind = self.headers.get("Content-Type", "").split(";")[0]
            path = urllib.parse.urlsplit(self.path)
            asked = urllib.parse.parse_qs(path.query)
            topic = path.path.strip("/")
            if kind == "text/xml":
                messages = [soap_message(body)]
            elif kind == "application/octet-stream":
                messages = [(topic, bytes(f), False) for f in frames(body, asked.get("isBatch", ["false"])[0] == "true")]
            else:
                form = asked | urllib.parse.parse_qs(body.decode("utf-8", "replace"))
                messages = [(topic, v, form.get("isBatch", ["false"])[0] == "true") for v in form.get(key, [])]
            good = bool(messages) and None not in messages and landing.add_all(messages)
            self.send_response(200 if good else 404 if messages else 400)
            self.end_headers()
            self.wfile.write(b"ok" if good else b"unknown topic" if messages else b"incomplete")

        def log_message(self, *args) -> None:
            return

    return ThreadingHTTPServer(("", port), Handler)


def soap_message(body: bytes) -> tuple[str, str, bool] | None:
    """Topic, content and batch flag of a ``sendData`` call, whatever its namespaces; null if it is none."""
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return None
    found = {e.tag.rpartition("}")[2]: e.text or "" for e in root.iter()}
    if "topic" not in found:
        return None
    return found["topic"], found.get("content", ""), found.get("isBatch", "").lower() == "true"


def tcp_server(landing: Landing, port: int = 0, most: int = 100) -> socketserver.ThreadingTCPServer:
    """Eight bytes with the number of messages (-1: no end), then each: a length and ``topic,content``, or a
    negative length and a binary body: two bytes of topic length, topic, fields. ``most`` connections at once."""
    slots = threading.Semaphore(most)

    class Handler(socketserver.StreamRequestHandler):
        timeout = IDLE

        def handle(self) -> None:
            if not slots.acquire(blocking=False):
                self.wfile.write(b"busy")
                return
            try:
                left = struct.unpack(">q", self.take(8))[0]
                while left != 0:
                    n = struct.unpack(">i", self.take(4))[0]
                    body = self.take(abs(n))
                    if n >= 0:
                        topic, _, content = body.decode("utf-8", "replace").partition(",")
                        good = landing.add(topic, content)
                    else:
                        size = struct.unpack_from(">h", body)[0]
                        good = landing.add(body[2 : 2 + size].decode("utf-8", "replace"), body[2 + size :])
                    if not good:
                        return
                    left -= left > 0
                self.wfile.write(b"ok")
            except (EOFError, TimeoutError, struct.error):
                return
            finally:
                slots.release()

        def take(self, n: int) -> bytes:
            data = self.rfile.read(n)
            if len(data) < n:
                raise EOFError
            return data

    class Server(socketserver.ThreadingTCPServer):
        allow_reuse_address, daemon_threads = True, True

    return Server(("", port), Handler)


class Staged:
    """The other side of ``operators.send``: chunks wait under hidden names until their batch is committed.

    A commit writes the names of a batch's chunks to one file, which is what shows them; a batch of
    a source that has such a file is ignored, so repeated commits change nothing.
    """

    def __init__(self, folder: str, topics: set[str]):
        self.folder, self.topics, self.lock = folder, topics, threading.Lock()
        os.makedirs(f"{folder}/_staged", exist_ok=True)
        os.makedirs(f"{folder}/_batches", exist_ok=True)

    def stage(self, name: str, rows: list[list]) -> list[list]:
        """Keeps the rows of known topics and returns [place, reason] of the others."""
        good, refused = [], []
        for i, (topic, key, value) in enumerate(rows):
            if topic in self.topics:
                good.append(json.dumps({"topic": topic, "key": key, "value": value}))
            else:
                refused.append([i, "unknown topic"])
        self._put(f"{self.folder}/_staged/{name}.json", "".join(f"{x}\n" for x in good))
        return refused

    def commit(self, source: str, batch: int, chunks: list[str]) -> bool:
        """Whether the batch is a new one."""
        mark = f"{self.folder}/_batches/{urllib.parse.quote(source, safe='')}-{batch}.json"
        with self.lock:
            if os.path.exists(mark):
                self.abort(chunks)
                return False
            self._put(mark, json.dumps(chunks))
        return True

    def abort(self, chunks: list[str]) -> bool:
        for name in chunks:
            if os.path.exists(path := f"{self.folder}/_staged/{name}.json"):
                os.remove(path)
        return True

    def shown(self) -> list[str]:
        """Files of all committed chunks."""
        found = []
        for mark in sorted(os.listdir(f"{self.folder}/_batches")):
            if not mark.startswith("."):
                with open(f"{self.folder}/_batches/{mark}", encoding="utf-8") as f:
                    found += [f"{self.folder}/_staged/{name}.json" for name in json.load(f)]
        return found

    @staticmethod
    def _put(path: str, text: str) -> None:
        folder, _, name = path.rpartition("/")
        with open(f"{folder}/.{name}", "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{folder}/.{name}", path)


def store_server(staged: Staged, port: int = 0) -> ThreadingHTTPServer:
    """``POST /stage/{name}`` with rows, ``/commit`` with source, batch and chunks, ``/abort`` with chunks; all in JSON."""

    class Handler(BaseHTTPRequestHandler):
        timeout = IDLE

        def do_POST(self) -> None:
            what, _, name = self.path.strip("/").partition("/")
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
            if what == "stage" and name.isalnum():
                reply = staged.stage(name, body)
            elif what in ("commit", "abort"):
                reply = getattr(staged, what)(**body)
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args) -> None:
            return

    return ThreadingHTTPServer(("", port), Handler)


def serving(server: socketserver.BaseServer) -> int:
    """Runs a server in a thread and gives its port; ``server.shutdown()`` ends it."""
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server.server_address[1]
