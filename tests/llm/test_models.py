"""Operators with a model, fingerprints, archives and mixing: exact rules, round trips, held-out accuracy, edges."""

import base64
import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streamloom.llm import chat_format, lang_id, lm_score, mixing, multiset_hash, url_filter, warc
from streamloom.llm.queries import ORACLE_SQL, QUERIES


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_queries_are_named():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


# ---- chat ------------------------------------------------------------------------------------
def plain_viterbi(start, step, emits):
    best, back = start + emits[0], []
    for e in emits[1:]:
        scores = best[:, None] + step
        back.append(scores.argmax(0))
        best = scores.max(0) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("block", [2, 3, 512])
def test_viterbi_in_blocks(spark, block):
    rng = np.random.default_rng(block)
    start, step = rng.normal(size=3), rng.normal(size=(3, 3))
    rows, want = [], {}
    for conv, n in ((1, 1), (2, 23), (2**60 + 1, 7), (None, 5)):
        emits = rng.normal(size=(n, 3))
        for k, (e, s) in enumerate(zip(emits, plain_viterbi(start, step, emits))):
            rows.append((conv, k, [*(step + e).ravel().tolist(), *(start + e).tolist()]))
            want[conv, k] = s
    df = spark.createDataFrame(rows, "conv long, k long, m array<double>")
    assert {(r.conv, r.k): r.state for r in chat_format.viterbi(df, 3, block).collect()} == want


def test_chat_query_and_transcripts(spark, sf):
    turns = read(spark, sf, "conversations")
    truth = {(r.conv_id, r.turn): (r.role, r.text or "") for r in turns.collect()}
    rows = chat_format.op1_chat_format(spark, sf).collect()
    held = [truth.get((r.conv_id, r.turn)) == (r.role_pred, r.rendered.split("|>\n", 1)[1].removesuffix("\n<|end|>\n")) for r in rows if r.held_out]
    assert held and sum(held) / len(held) > 0.95 and abs(len(rows) - len(truth)) < 0.02 * len(truth)
    assert all(r.rendered.startswith(f"<|{r.role_pred}|>\n") and r.rendered.endswith("\n<|end|>\n") for r in rows)


def test_transcripts_against_plain_viterbi(spark, sf):
    """The path through every transcript is the plain one, whatever the blocks; text outside markers stays."""
    marked = chat_format.as_transcript(read(spark, sf, "conversations").where("conv_id < 40"))
    model = chat_format.train_lines(marked)
    texts = [
        (1, "System: be kind\nUser: hello there\nhow are you?\n**Assistant:** fine\n### User\nbye\nQuestion: why?"),
        (2, None), (3, ""), (4, "A\nB\nC"), (5, "User: Assistant: hi"), (6, "user: " + "long line " * 20_000), (None, "Bot: yes\nme: no"),
    ]
    df = spark.createDataFrame(texts, "conv_id long, text string")
    out = {}
    for r in chat_format.parse_transcripts(df, model, block=2).orderBy("turn").collect():
        out.setdefault(r.conv_id, []).append((r.role_pred, r.text, r.rendered))
    lines = df.select("conv_id", chat_format.F.posexplode(chat_format.F.split(chat_format.F.coalesce("text", chat_format.F.lit("")), "\n")).alias("k", "text"))
    emits = lines.select("conv_id", "k", "text", *chat_format.emissions(chat_format.F.col("text"), model)).orderBy("conv_id", "k").collect()
    n = len(model.roles) // 2
    for conv, text in texts:
        own = [r for r in emits if r.conv_id == conv]
        path = plain_viterbi(model.start, model.step, [np.array(r[3:], float) for r in own])
        want = []
        for state, r in zip(path, own):
            if state < n or not want:
                want.append((model.roles[state % n], r.text))
            else:
                want[-1] = (want[-1][0], f"{want[-1][1]}\n{r.text}")
        assert [x[:2] for x in out[conv]] == want
    assert out[5][0][0] == "user" and out[5][0][2] == "<|user|>\nAssistant: hi\n<|end|>\n"
    assert "A\nB\nC" in "\n".join(x[1] for x in out[4]) and out[2][0][1] == ""
    assert chat_format.parse_transcripts(df.limit(0), model).count() == 0
    none = chat_format.train_lines(marked.limit(0))
    assert {r.role_pred for r in chat_format.parse_transcripts(df, none).collect()} == {"unknown"}


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "hi?"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, ""), (2, None, "user", "x" * 100_000), (3, 5, "user", "q"), (4, (1 << 63) - 1, "user", "far")]
    df = spark.createDataFrame(rows, schema)
    out = chat_format.recover_roles(df, chat_format.train(df)).collect()
    assert len(out) == len(rows) and all(r.role_pred in ("user", "assistant") for r in out)
    empty = df.where("conv_id < 0")
    assert chat_format.recover_roles(df, chat_format.train(empty)).select("role_pred").distinct().first()[0] == "unknown"
    assert chat_format.recover_roles(empty, chat_format.train(df)).count() == 0
    clash = df.withColumnsRenamed({"role": "rendered"})
    assert chat_format.recover_roles(clash, chat_format.train(df)).columns == ["conv_id", "turn", "text", "role_pred", "rendered"]


def test_lines_of_any_turn_numbers(spark):
    """Turns keep their order and none is lost, whatever their numbers; null comes last, equal rows count once."""
    far = 1 << 31
    turns = {
        1: [(-2, "Assistant: a"), (-1, "User: first line\nsecond line?\nthird line"), (0, "Assistant: b")],
        2: [(far, "Customer: far a"), (far + 5, "Agent: far b"), (None, "Customer: none c")],
        None: [(-(1 << 63), "User: least"), ((1 << 63) - 1, "Bot: most"), ((1 << 63) - 1, "Bot: most"), ((1 << 63) - 1, "Zed: another\n\n")],
    }
    df = spark.createDataFrame([(c, t, x) for c, rows in turns.items() for t, x in rows][::-1], "conv_id long, turn long, text string").repartition(3)
    got = {}
    for r in sorted(chat_format.lines_of(df).collect(), key=lambda r: r.k):
        assert r.k == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append(r.text)
    assert got == {c: [line for x in dict.fromkeys(x for _, x in rows) for line in x.split("\n")] for c, rows in turns.items()}
    assert chat_format.lines_of(df.limit(0)).count() == 0
    said = chat_format.parse_lines(chat_format.lines_of(df.where("conv_id IS NOT NULL")), chat_format.train_lines(chat_format.as_transcript(spark.createDataFrame(
        [(i, t, ("user", "assistant")[t % 2], "one line" if i % 2 else "some\nlines") for i in range(30) for t in range(4)], "conv_id long, turn long, role string, text string"))))
    assert [(r.conv_id, r.turn, r.role_pred) for r in said.orderBy("conv_id", "turn").collect()] == [(c, i, x) for c, rs in ((1, "aua"), (2, "uau")) for i, x in enumerate({"a": "assistant", "u": "user"}[y] for y in rs)]


def test_levels_shrink_by_blocks_of_lines(spark, monkeypatch):
    """Short turns share blocks: a conversation of many turns takes as few levels as one of as many lines."""
    sizes = []
    real = chat_format.materialize

    def counting(df, name):
        out = real(df, name)
        if name == "viterbi-up":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(chat_format, "materialize", counting)
    marked = chat_format.as_transcript(spark.createDataFrame([(1, t * 1000 - 7, ("user", "assistant")[t % 2], f"text {t}") for t in range(300)], "conv_id long, turn long, role string, text string"))
    out = chat_format.parse_lines(chat_format.lines_of(marked), chat_format.train_lines(marked), block=20)
    lines = chat_format.lines_of(marked).count()
    want = []
    while not want or want[-1] > 1:
        want.append(-(-(want[-1] if want else lines) // 20))
    assert out.count() == 300 and sizes == want


def test_names_that_are_not_listed(spark, sf, monkeypatch):
    """Speakers with names of their own: turns and roles come from the moves between states."""
    turns = read(spark, sf, "conversations")
    held = chat_format.held_out_flag(chat_format.F.col("conv_id"), 4, 2)
    model = chat_format.train_lines(chat_format.as_transcript(turns.where(~held)))
    monkeypatch.setattr(chat_format, "NAMES", {"user": ("Alice", "Maria", "Li"), "assistant": ("Bob", "Jon", "Ada"), "system": ("Carol", "Eve", "Zed")})
    rows = chat_format.parse_lines(chat_format.lines_of(chat_format.as_transcript(turns.where(held))), model).collect()
    truth = {(r.conv_id, r.turn): r.role for r in turns.where(held).collect()}
    right = sum(truth.get((r.conv_id, r.turn)) == r.role_pred for r in rows)
    assert right / len(truth) > 0.8


# ---- urls ------------------------------------------------------------------------------------
def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :])[0]


def url_rule(host, path):
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_url_query(spark, sf):
    pages = {r.page_id: r.url for r in read(spark, sf, "pages").collect()}
    rows = url_filter.op2_url_filter(spark, sf).collect()
    assert len(rows) == len(pages)
    spam = re.compile("spam-farm|cheap-pills|casino-win|adult-x|ads-track|free-bets")
    for r in rows:
        assert (r.host, r.path) == url_parts(pages[r.page_id])
        rule, verdict = url_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if spam.search(r.host) else "allow"))


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "http://com/en/", "http://xcom/en/1", "http://É.net/de/9", "a://b?c://d/e", "http://h#/p", "x\n://h/p", "http://h" + "/a" * 50_000]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, host string")
    out = url_filter.judge(df)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    for r in out.collect():
        assert (r.host, r.path) == url_parts(r.url) and r.rule == url_rule(r.host, r.path)[0]
        assert r.verdict in ("allow", "block") and 0 <= r.score <= 1
    assert url_filter.judge(df.where("page_id < 0")).count() == 0
    labels = spark.createDataFrame([("http://a.b/", "block"), (None, "block"), ("x", "odd")], "url string, label string")
    assert {r.verdict for r in url_filter.judge(df.where("page_id = 0"), labelled=labels).collect()} == {"block"}
    assert {r.verdict for r in url_filter.judge(df.where("page_id = 0"), labelled=labels.where("label = 'none'")).collect()} == {"allow"}


def test_trees_on_held_out_urls():
    split = lambda part: ([u for u, _ in part], *zip(*[url_parts(u) for u, _ in part]), np.array([v == "block" for _, v in part], float))
    urls = url_filter.labelled_urls(5000, seed=9)
    urls_a, hosts_a, paths_a, y_a = split(urls[:4000])
    urls_b, hosts_b, paths_b, y_b = split(urls[4000:])
    p = url_filter.Boosted().fit(urls_a, list(hosts_a), list(paths_a), y_a).predict(urls_b, list(hosts_b), list(paths_b))
    assert ((p > 0.5) == y_b).mean() > 0.95


# ---- fingerprints ----------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_characters="\n\r"), min_size=1, max_size=20), max_size=8), st.randoms())
def test_multiset_hash_is_homomorphic(lines, rng):
    of = multiset_hash.Fingerprint.of
    whole = of("\n".join(lines))
    mixed = list(lines)
    rng.shuffle(mixed)
    assert of("\n".join(mixed)) == whole == multiset_hash.Fingerprint.parse(whole.hex())
    grown = multiset_hash.Fingerprint()
    for line in lines:
        grown = grown + of(line)
    assert grown == whole
    if lines:
        assert whole - of(lines[0]) == of("\n".join(lines[1:]))
        assert of("\n".join([*lines, lines[0]])) != whole
    assert multiset_hash.likeness(whole, whole) == 1.0


def test_fingerprint_query(spark, sf):
    texts = sorted(((r.doc_id, r.text or "") for r in read(spark, sf, "documents").collect()), reverse=True)
    got = {r.doc_id: r for r in multiset_hash.op4_fingerprints(spark, sf).collect()}
    assert len(got) == len(texts)
    of, near = multiset_hash.Fingerprint.of, multiset_hash.likeness
    for k, (i, text) in enumerate(texts):
        other = texts[(k + 1) % len(texts)][1]
        n = len(text) // 3
        edited, r = text[: len(text) - n] + other[:n], got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (of(text).hex(), of(edited).hex())
        assert (r.near_edited, r.near_next) == (near(of(text), of(edited)), near(of(text), of(other)))
    near_edited = [r.near_edited for r in got.values() if r.n_chars > 300]
    assert sum(x > 0.15 for x in near_edited) / len(near_edited) > 0.95


@pytest.mark.parametrize("letters", ["".join(chr(0x4E00 + i) for i in range(2500)), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"])
def test_likeness_of_texts_without_spaces(letters):
    """Two thirds of the text stay, first at its place, then behind a new beginning: the true values are near 0.5."""
    rng = random.Random(6)
    own = lambda n: "".join(rng.choices(letters, k=n))
    of, near = multiset_hash.Fingerprint.of, multiset_hash.likeness
    found = []
    for _ in range(20):
        text = own(20_000)
        for edited in (text[:-6667] + own(6667), own(6667) + text[6667:], own(101) + text[:-6667] + own(6566)):
            found.append(near(of(text), of(edited)))
        assert near(of(text), of(own(20_000))) < 0.2
    assert min(found) > 0.1 and 0.4 < sum(found) / len(found) < 0.6
    assert max(map(len, multiset_hash.paragraphs(text))) <= 97


def test_likeness_of_texts_of_many_megabytes():
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(7))
    of, near = multiset_hash.Fingerprint.of, multiset_hash.likeness
    for size in (15_000, 60_000, 120_000):
        doc, after = ("\n".join(line() for _ in range(size)) for _ in range(2))
        third = len(doc) // 3
        whole = of(doc)
        edited = of(doc[: len(doc) - third] + after[:third])
        assert multiset_hash.Fingerprint.parse(edited.hex()) == edited
        assert 0.25 < near(whole, edited) < 0.75
        assert 0.4 < near(whole, of(doc[: len(doc) - third])) < 0.9
        assert near(whole, of(after)) == 0.0


@pytest.mark.parametrize("goal", [1, 3, 1000])
def test_fingerprint_order_and_edges(spark, goal, monkeypatch):
    rows = [(5, "a" * 9), (5, "b" * 9), (3, None), (9, ""), (7, "c😀d"), (1, "xyz" * 20_000), (None, "nul"), (-(2**60) - 1, "low")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, run string")
    plain = multiset_hash.with_next
    monkeypatch.setattr(multiset_hash, "with_next", lambda d: plain(d, goal))
    got = multiset_hash.neighbours(df).collect()
    assert sorted((r.doc_id or 0) for r in got) == [-(2**60) - 1, 0, 1, 3, 5, 5, 7, 9]
    by = {r.doc_id: r.edited_sha256 for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[1] == sha(("xyz" * 20_000)[:40_000] + "low")
    assert by[None] == sha("nu") and by[9] == sha("") and by[3] == sha("")
    assert multiset_hash.neighbours(df.where("doc_id > 99")).count() == 0
    only = multiset_hash.neighbours(df.where("doc_id = 7")).first()
    assert only.near_next == 1.0 and only.edited_sha256 == sha("c😀c")


# ---- archives --------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.integers(4, 40))
def test_chunks_and_cuts(text, size):
    data = text.encode()
    assert warc.unchunked(warc.chunked(data, size)) == data
    parts = list(warc.cuts(data, size))
    assert b"".join(parts) == data and all(len(p) <= size and p.decode() for p in parts)
    rid = str(uuid.uuid4())
    records = list(warc.records(rid, "response", {"page_id": 3, "url": "u\r\nx", "refers_to": None}, data, size))
    archive = "".join(r + "\r\n\r\n" for r in records).encode()
    found = list(warc.parse(archive[i : i + 7] for i in range(0, len(archive), 7)))
    assert all(error is None for _, _, error in found) and found[0][0]["warc-target-uri"] == "u%0D%0Ax"
    assert warc.unchunked(b"".join(b for _, b, _ in found).partition(b"\r\n\r\n")[2]) == data
    assert len(found) == 1 or found[-1][0]["warc-segment-total-length"] == str(sum(len(b) for _, b, _ in found))


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 5000), (2, "http://b/ü%20c%", "x" * 5000), (3, None, None), (4, "u", ""), (0, "z", "ä😀\r\n\r\n" * 900), (None, "n", "only"), (2**60 + 1, "big", "own"), (None, "n", "x" * 5000), (2, "http://b/", "x" * 5000)]
    df = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, payload string")
    warc.write(df, str(tmp_path / "w"), segment=512)
    found = warc.read(spark, str(tmp_path / "w")).collect()
    least = {}
    for i, _, h in rows:
        least.setdefault(h or "", []).append(i)
    first = {h: min((i for i in ids if i is not None), default=None) for h, ids in least.items()}
    want = Counter()
    for i, u, h in rows:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        own = first[h or ""] == i
        want[i, u, "response" if own else "revisit", None if own else first[h or ""], len(raw), digest, raw if own else None] += 1
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in found) == want
    warc.write(df.where("page_id < 0"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_archive_query(spark, sf):
    pages = read(spark, sf, "pages").collect()
    got = {r.page_id: r for r in warc.op6_warc(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        raw = (p.html or "").encode()
        assert (got[p.page_id].payload_bytes, got[p.page_id].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())


def foreign(*records):
    """An archive of another writer: (type, id, headers, block)."""
    out = []
    for kind, rid, heads, block in records:
        lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *heads, f"Content-Length: {len(block)}"]
        out.append(("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n")
    return out


def test_foreign_and_broken_archives(spark, tmp_path):
    import gzip

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n3;x=1\r\nabc\r\n0\r\n\r\n"
    digest = warc.digest_of(b"<p>hi")
    good = foreign(
        ("warcinfo", "i", ["Content-Type: application/warc-fields"], b"software: x\r\n"),
        ("request", "q", ["WARC-Target-URI: http://a/b%20c"], b"GET /b%20c HTTP/1.1\r\n\r\n"),
        ("response", "1", ["WARC-Target-URI: http://a/b%20c"], page),
        ("response", "2", ["WARC-Target-URI: http://a/2", f"WARC-Payload-Digest: sha1:{digest}"], page),
        ("metadata", "m", [], b"k: v"),
        ("resource", "3", ["WARC-Target-URI: file:///x"], b"raw bytes"),
        ("response", "4", ["WARC-Target-URI: http://a/4"], chunked),
        ("response", "5", ["WARC-Target-URI: http://a/5"], b"HTTP/1.1 200 OK\r\n\r\n" + b"y" * 3_000_000),
    )
    bad = foreign(
        ("response", "b1", [f"WARC-Payload-Digest: sha1:{digest}"], page + b"!"),
        ("response", "b2", [], chunked.replace(b"3;", b"9;")),
        ("response", "b3", ["WARC-Segment-Number: 1"], page),
        ("continuation", "b4", ["WARC-Segment-Origin-ID: <b3>", "WARC-Segment-Number: 3", "WARC-Segment-Total-Length: 99"], b"z"),
    )
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, good)))
    (tmp_path / "two.warc").write_bytes(b"junk\r\n" + bad[0] + good[2] + bad[1] + b"WARC/1.0\r\nContent-Length: x\r\n\r\n" + bad[2] + bad[3] + good[5] + good[3][:-9])
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.url, r.record_type, r.payload_bytes) for r in rows) == sorted([
        ("http://a/b%20c", "response", 5), ("http://a/2", "response", 5), ("file:///x", "resource", 9), ("http://a/4", "response", 3),
        ("http://a/5", "response", 3_000_000), ("http://a/b%20c", "response", 5), ("file:///x", "resource", 9),
    ])
    assert all(r.payload_digest == warc.digest_of(bytes(r.payload)) for r in rows)
    broken = sorted((r.record_id or "", r.error) for r in warc.read(spark, str(tmp_path), broken=True).collect())
    assert [x for x, _ in broken] == ["", "", "<2>", "<b1>", "<b2>", "<b3>"] and all(e for _, e in broken)
    assert list(warc.parse(iter([b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"])))[0][2] == "a record ends early"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")



# ---- mixing ----------------------------------------------------------------------------------
def test_targets():
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 200, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    assert mixing.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}
    sizes = {"z": 10, "É": 1000, "a": 5, None: 70, "b": 0}
    got = mixing.targets(sizes)
    assert sum(got.values()) == pytest.approx(1.5 * 1085) and all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)


def test_flight_keeps_both_sums():
    rng = random.Random(1)
    size = [float(rng.randint(0, 500)) for _ in range(400)]
    p = [rng.random() for _ in size]
    words, count = sum(a * b for a, b in zip(p, size)), sum(p)
    rest = mixing.flight(p, size, rng)
    assert len(rest) <= 2 and sum(0 < x < 1 for x in p) == len(rest)
    assert sum(p) == pytest.approx(count) and sum(a * b for a, b in zip(p, size)) == pytest.approx(words)


def test_mixing_query(spark, sf):
    texts = {r.doc_id: (r.source, r.text) for r in read(spark, sf, "documents").collect()}
    rows = mixing.op7_mixing(spark, sf).collect()
    again = mixing.op7_mixing(spark, sf).repartition(7).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t) in texts.items()}
    totals = Counter()
    for i, (s, _) in texts.items():
        totals[s] += sizes[i]
    goal, taken = mixing.targets(dict(totals)), Counter()
    for r in rows:
        s = texts[r.doc_id][0]
        assert (r.size, r.source_size) == (sizes[r.doc_id], totals[s]) and r.target == pytest.approx(goal[s])
        assert r.taken in {0, r.size, 2 * r.size}
        taken[s] += r.taken
    assert sum(abs(taken[s] - goal[s]) for s in goal) < 0.02 * sum(goal.values())


def test_mixing_blocks_and_edges(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 2}" if i % 3 else None, rng.randint(0, 90)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    units = df.selectExpr("cast(doc_id % 2 as int) as sid", "size", "0.37D as p", "xxhash64(doc_id) as h", "doc_id as k1")
    drawn = mixing.sample(units, block=50).collect()
    assert len(drawn) == 900 and {r.p for r in drawn} == {0.0, 1.0}
    for sid in (0, 1):
        own = [r for r in drawn if r.sid == sid]
        assert sum(r.size * r.p for r in own) == pytest.approx(0.37 * sum(r.size for r in own), abs=20)
        assert sum(r.p for r in own) == pytest.approx(0.37 * len(own), abs=6)
    assert mixing.mix(df.where("doc_id < 0")).count() == 0
    words = spark.createDataFrame([(1, "a b c", None), (2, None, "s"), (3, "", "s"), (1, "a b c", None), (4, "x " * 5000, "t")], "doc_id long, text string, source string").selectExpr("*", "'k' as mix_copies")
    out = mixing.mixed_documents(words)
    assert out.columns == ["doc_id", "text", "source", "mix_size", "mix_target", "mix_copies"]
    assert all(r.mix_copies in (1, 2) for r in out.collect())


# ---- language models -------------------------------------------------------------------------
def test_scores_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    counts = Counter()
    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(lm_score.tokens(text))
    n = sum(counts.values())
    norm = math.log10(n + 0.1 * (len(counts) + 1))
    got = {r.doc_id: r for r in lm_score.op8_lm_score(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        words, r = lm_score.tokens(text), got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 0.1) - norm for w in words), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_training_reads_every_count():
    net = lm_score.LogBilinear(8)
    start = net.R.copy()
    grams = np.array([(0 * 8 + 1) * 8 + 2, (1 * 8 + 2) * 8 + 0, (5 * 8 + 6) * 8 + 7])
    net.fit(grams, np.array([6e8, 4e8, 1.0]), 20)
    assert (net.R[[0, 1, 2, 5, 6]] != start[[0, 1, 2, 5, 6]]).all() and (net.R[[3, 4, 7]] == start[[3, 4, 7]]).all()


def test_model_is_normalised(spark):
    net = lm_score.LogBilinear(8)
    net.fit(np.array([0, 9, 77, 300]), np.array([5.0, 1.0, 2.0, 9.0]), steps=50, batch=32, noise=4)
    assert np.allclose((10.0 ** net.table().astype(float)).sum(1), 1, atol=1e-4)
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id long, text string")
    vocab = lm_score.count_tokens(docs.select("text"))
    counts = {bytes(r.token): r.c for r in vocab.collect()}
    assert counts == {b"a": 2, b"b": 2, b"\n": 3}
    shown = lm_score.score(spark.createDataFrame([(t,) for t in ["a", "b", ""]], "text string"), docs.select("text"), frequent=2, steps=20)
    assert all(r.score < 0 and r.n_known == r.n_tokens for r in shown.collect())


def test_tokens_add_up_to_one():
    """After any two classes the chances of all tokens, and of one unknown for each hashed class, add up to one."""
    rng = np.random.default_rng(4)
    listed = [lm_score.END] + sorted({bytes(rng.integers(97, 123, 4).astype(np.uint8)) for _ in range(900)})
    counts = np.sort(rng.integers(1, 3000, len(listed)))[::-1].astype(np.int64)
    learnt = int((counts >= 200).sum())
    lex = lm_score.Lexicon(listed, counts, learnt)
    classes = lm_score.SINGLE + lm_score.HASHED
    net, within = lm_score.LogBilinear(classes), lm_score.Within(classes, lex.home)
    grams = np.unique(rng.integers(0, classes**3, 500))
    net.fit(grams, rng.random(len(grams)), steps=5)
    within.fit(rng.poisson(0.2, (classes, len(lex.home))).astype(float), steps=10)
    mass = np.full(classes, lm_score.SMOOTH)
    for w, c in list(zip(listed, counts))[learnt:]:
        mass[lm_score.hashed_class(w)] += c + lm_score.SMOOTH
    mass[: lm_score.SINGLE] = 1.0
    scorer = lm_score.Scorer(lex, (net.R, net.Q, net.C, net.bias, within.R, within.Q, within.bias, np.log10(mass)))
    at = np.concatenate([np.arange(len(listed)), np.full(lm_score.HASHED, -1)])
    cls = np.concatenate([lex.cls[:-1], np.arange(lm_score.SINGLE, classes)])
    for a, b in rng.integers(0, classes, (20, 2)):
        logs, rest = scorer.after(np.full(len(at), a), np.full(len(at), b), at, cls)
        logs[rest] += lex.log_count[at][rest]
        assert (10.0**logs).sum() == pytest.approx(1.0, abs=1e-3)


def test_scores_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (2**60 + 1, "new words", 3), (None, "new words", 3), (4, "w " * 100_000, 4), (4, "w " * 100_000, 4)], "doc_id long, text string, n_tokens_x long")
    out = lm_score.score(docs, docs.where("doc_id = 1").select("text"), steps=20).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 3), (1, 1), (2, 1), (4, 100_001), (4, 100_001), (2**60 + 1, 3)]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    none = docs.where("doc_id < 0")
    assert lm_score.score(none, docs.select("text"), steps=20).count() == 0
    assert all(math.isfinite(r.score) for r in lm_score.score(docs, none.select("text"), steps=20).collect())


def test_language_query(spark, sf):
    truth = {r.doc_id: (r.lang, r.text) for r in read(spark, sf, "documents").collect()}
    rows = lang_id.op9_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r.lang_pred == truth[r.doc_id][0] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_language_mixtures_and_edges(spark):
    en, de = "the quick brown fox jumps over the lazy dog and runs away ", "der schnelle braune fuchs springt über den faulen hund und läuft weg "
    train = spark.createDataFrame([(en * 5, "en"), (de * 5, "de"), ("ignored", None), (None, "en")], "text string, lang string")
    model = lang_id.train(train)
    assert model.langs == ("de", "en")
    assert model.predict(en) == ("en", 1.0)
    lang, share = model.predict(en * 2 + de)
    assert lang == "en" and 0.5 < share < 0.85
    texts = [None, "", "123 !?", en, en, de * 2000, "漢字"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = [(r.lang_pred, r.score) for r in lang_id.predict(df, model).orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3] == got[4] == ("en", 1.0) and got[5][0] == "de" and got[6][0] in model.langs
    assert lang_id.predict(df.where("doc_id < 0"), model).count() == 0
    empty = lang_id.train(train.where("lang = 'xx'"))
    assert {r.lang_pred for r in lang_id.predict(df, empty).collect()} == {"und"}
    kept = lang_id.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


# ---- the pipeline ----------------------------------------------------------------------------
def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = read(spark, sf, "documents")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert 0 < docs.count() <= before
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
    assert {r[0] for r in docs.select("mix_copies").distinct().collect()} <= {1, 2}
