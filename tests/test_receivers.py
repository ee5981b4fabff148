"""Receivers, the command line and SOAP requests over real sockets."""

import json
import socket
import os
import signal
import struct
import subprocess
import sys
import threading
import time
import urllib.error
import urllib.parse
import urllib.request

import pytest

from streamloom import __main__ as cli
from streamloom.sources import receiver, registry


@pytest.fixture
def landing(tmp_path):
    return receiver.Landing(str(tmp_path / "in"), {"a", "b"})


serve = receiver.serving


def post(port, path, body, kind="application/x-www-form-urlencoded"):
    request = urllib.request.Request(f"http://127.0.0.1:{port}/{path}", body, {"Content-Type": kind})
    with urllib.request.urlopen(request, timeout=5) as reply:
        return reply.read()


def test_http_soap_and_tcp_land_messages(spark, landing):
    port = serve(receiver.http_server(landing))
    assert post(port, "a", urllib.parse.urlencode({"content": "x|1", "isBatch": "true"}).encode()) == b"ok"
    soap = b'<e:Envelope xmlns:e="u"><e:Body><sendData><topic>b</topic><content>y</content><isBatch>false</isBatch></sendData></e:Body></e:Envelope>'
    assert post(port, "", soap, "text/xml") == b"ok"
    assert post(port, "a", struct.pack(">i", 2) + b"zz" + struct.pack(">i", 0), "application/octet-stream") == b"ok"
    for path, body in (("none", b"content=1"), ("a", b"other=1")):
        with pytest.raises(urllib.error.HTTPError):
            post(port, path, body)
    tcp = serve(receiver.tcp_server(landing))
    with socket.create_connection(("127.0.0.1", tcp), 5) as s:
        text, binary = b"a,left,right", struct.pack(">h", 1) + b"b" + b"\x00\x01"
        s.sendall(struct.pack(">q", 2) + struct.pack(">i", len(text)) + text + struct.pack(">i", -len(binary)) + binary)
        assert s.recv(2) == b"ok"
    found = registry.landing_source(spark, landing.folder, "topic string, content string, batch boolean, binary boolean").collect()
    assert sorted((r.topic, r.content, r.batch, r.binary) for r in found) == sorted([
        ("a", "left,right", False, False), ("a", "x|1", True, False), ("a", "eno=", False, True), ("b", "AAE=", False, True), ("b", "y", False, False),
    ])
    registry.register(spark)
    server = receiver.http_server(landing)
    reader = spark.read.format("messages_soap").option("url", f"http://127.0.0.1:{serve(server)}/")
    reply = reader.option("sendContent", json.dumps([soap.decode()])).load().first()
    assert reply.value == "ok"


def test_start_and_stop(spark, landing, tmp_path):
    for i in range(5):
        landing.add("a", f"{i}|n{i}")
    landing.add("b", "other")
    raw = {"msg_id": 4, "name": "a", "split": "|", "fields": [{"name": "id"}, {"name": "name"}], "stores": [{"store_id": 1, "filter_rule": "expr: id == '3'"}]}
    (tmp_path / "spec.json").write_text(json.dumps(raw))
    out = str(tmp_path / "out")
    cli.main(["stop", "4", out])
    cli.main(["start", str(tmp_path / "spec.json"), landing.folder, out, "--interval", "0 seconds"])
    lines = [r.value for r in spark.read.text(f"{out}/a/1").select("value").collect()]
    assert sorted(x.split(",")[2:] for x in lines) == [["0", "n0"], ["1", "n1"], ["2", "n2"], ["4", "n4"]]


def test_what_was_acknowledged_survives_a_kill(tmp_path):
    """A receiver process that dies right after "ok" has lost nothing of what it said ok to."""
    code = (
        "import sys; from streamloom.sources import receiver as r\n"
        "print(r.serving(r.http_server(r.Landing(sys.argv[1], {'a'}))), flush=True)\nimport time; time.sleep(60)"
    )
    process = subprocess.Popen([sys.executable, "-c", code, str(tmp_path / "in")], stdout=subprocess.PIPE, cwd=os.path.dirname(os.path.dirname(__file__)))
    port = int(process.stdout.readline())
    told = []

    def send(k):
        for i in range(20):
            try:
                if post(port, "a", f"content={k}-{i}".encode()) == b"ok":
                    told.append(f"{k}-{i}")
            except OSError:
                return

    threads = [threading.Thread(target=send, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    while len(told) < 25:
        time.sleep(0.01)
    process.send_signal(signal.SIGKILL)
    for t in threads:
        t.join()
    process.wait()
    files = [f for f in os.listdir(tmp_path / "in") if not f.startswith(".")]
    found = [json.loads(line)["content"] for f in files for line in (tmp_path / "in" / f).read_text().splitlines()]
    assert len(told) >= 25 and set(told) <= set(found) and len(found) == len(set(found))


def test_lines_share_files_and_errors(tmp_path, monkeypatch):
    landing = receiver.Landing(str(tmp_path / "in"), {"a"}, rows=3, delay=5.0)
    threads = [threading.Thread(target=landing.add, args=("a", str(i))) for i in range(6)]
    began = time.monotonic()
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert time.monotonic() - began < 4 and len(os.listdir(landing.folder)) <= 3
    assert not landing.add_all([("a", "x"), ("none", "y")]) and landing.add_all([])

    def broken(*args):
        raise OSError("disk full")

    monkeypatch.setattr(os, "replace", broken)
    landing.delay = 0.0
    with pytest.raises(OSError):
        landing.add("a", "lost")


def test_start_runs_receivers_and_reads_binary_and_batches(spark, tmp_path):
    fields = [{"name": "id", "data_type": "NUMBER"}, {"name": "name"}]
    raw = [{"msg_id": k, "name": n, "split": "|", "fields": fields, "params": {"typed": "true"}, "stores": [{"store_id": 1}]} for k, n in ((7, "a"), (8, "b"))]
    (tmp_path / "spec.json").write_text(json.dumps(raw))
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = threading.Thread(target=cli.main, args=(["start", str(tmp_path / "spec.json"), landing, out, "--interval", "0 seconds", "--http", "0", "--tcp", "0"],))
    run.start()
    while not os.path.exists(f"{landing}/_ports.json"):
        time.sleep(0.05)
    with open(f"{landing}/_ports.json") as f:
        http, tcp = json.load(f)
    assert post(http, "a", urllib.parse.urlencode({"content": "1|one"}).encode()) == b"ok"
    assert post(http, "a", urllib.parse.urlencode({"content": json.dumps(["2|two", "3|three"]), "isBatch": "true"}).encode()) == b"ok"
    wire = lambda topic, i, name: struct.pack(">h", len(topic)) + topic + struct.pack(">q", i) + struct.pack(">i", len(name)) + name
    frames = [wire(b"a", 4, b"four"), wire(b"b", 5, "f\u00fcnf".encode())]
    with socket.create_connection(("127.0.0.1", tcp), 5) as s:
        s.sendall(struct.pack(">q", 2) + b"".join(struct.pack(">i", -len(x)) + x for x in frames))
        assert s.recv(2) == b"ok"
    for k in ("7", "8"):
        cli.main(["stop", k, out])
    run.join(120)
    rows = {n: sorted(r.value.split(",")[1:] for r in spark.read.text(f"{out}/{n}/1").select("value").collect()) for n in "ab"}
    assert sorted(r[1:] for r in rows["a"]) == [["1", "one"], ["2", "two"], ["3", "three"], ["4", "four"]]
    assert [r[0] for r in rows["a"]] == ["1", "2", "3", "4"] and rows["b"] == [["1", "5", "f\u00fcnf"]]


def test_a_batch_counts_once_on_the_other_side(tmp_path):
    store = receiver.Staged(str(tmp_path), {"a"})
    assert store.stage("c1", [["a", "k", "v"], ["z", "k", "w"]]) == [[1, "unknown topic"]]
    assert store.shown() == []
    store.stage("c2", [["a", "k", "again"]])
    assert store.commit("s", 0, ["c1"]) and not store.commit("s", 0, ["c2"])
    assert [os.path.basename(p) for p in store.shown()] == ["c1.json"] and not os.path.exists(tmp_path / "_staged/c2.json")
