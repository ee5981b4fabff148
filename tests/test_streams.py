"""Sources with offsets, stored tables, ledgers, monitors and aggregates, against plain Python."""

import io
import json
import math
import os
import random
import struct
import tarfile
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from streamloom.operators import aggregates, metrics, ranges, records, sinks
from streamloom.operators.stored import SeenSet, StoredSums
from streamloom.sources import archives, files, polls, registry, shared, tail
from streamloom.spec import DistinctRule
from streamloom.streaming import ledger, monitor


@pytest.fixture
def folder(spark):
    return files.shared_folder(spark)


# ---- file tail -------------------------------------------------------------------------------
def taken(reader, at):
    """Records and end of one batch."""
    end = reader.latestOffset()
    rows = [(p, v) for part in reader.partitions(at, end) for b in reader.read(part) for p, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
    return rows, end


@pytest.mark.parametrize("mark", ["\n", "##", "ab\n"])
@pytest.mark.parametrize("bound", [0, 1, 20])
def test_every_record_once(tmp_path, mark, bound):
    """Files grow in any steps, readers restart, parts are of a few bytes; half a record waits for its delimiter."""
    rng = random.Random(bound)
    for trial in range(12):
        root = tmp_path / str(trial)
        root.mkdir()
        options = {"path": f"{root}/*.log", "delimiter": mark, "maxbytes": str(bound), "partbytes": str(rng.choice([1, 3, 1000])), "state": f"{root}/state.json"}
        reader = tail.TailReader(options)
        at, got, want = reader.initialOffset(), [], []
        for _ in range(5):
            for name in rng.sample("xyz", 2):
                with open(root / f"{name}.log", "a") as f:
                    for _ in range(rng.randrange(4)):
                        record = "".join(rng.choices("q r\u00e9", k=rng.randrange(8)))
                        f.write(record[:3])
                        f.flush()
                        rows, at = taken(reader, at)
                        got += rows
                        f.write(record[3:] + mark)
                        want += [(f"{root}/{name}.log", record)] if record else []
            if rng.random() < 0.4:
                reader = tail.TailReader(options)
        for _ in range(400):
            rows, end = taken(reader, at)
            got, done, at = got + rows, end == at, end
            if done:
                break
        assert sorted(got) == sorted(want)


def test_shrunk_gone_and_hidden_files(tmp_path):
    for name, text in (("a.log", "one\ntwo\n"), (".b.log", "no\n"), ("_c.log", "no\n"), ("d.txt", "no\n")):
        (tmp_path / name).write_text(text)
    reader = tail.TailReader({"path": f"{tmp_path}/*.log"})
    rows, at = taken(reader, reader.initialOffset())
    assert [v for _, v in rows] == ["one", "two"]
    (tmp_path / "a.log").write_text("new\n")
    rows, at = taken(reader, at)
    assert [v for _, v in rows] == ["new"]
    again = [(p.start, p.end) for p in reader.partitions({f"{tmp_path}/a.log": 8}, at)]
    assert again == [(0, 4)]  # a repeated batch reads the same
    os.remove(tmp_path / "a.log")
    assert taken(reader, at) == ([], {})


def test_bound_from_a_file(tmp_path):
    (tmp_path / "a.log").write_text("x" * 9 + "\n" + "y" * 9 + "\n")
    rate = monitor.Rate(f"{tmp_path}/bound", 10, goal_ms=100, least=5)
    reader = tail.TailReader({"path": f"{tmp_path}/*.log", "boundfile": f"{tmp_path}/bound"})
    rows, at = taken(reader, reader.initialOffset())
    assert len(rows) == 1
    assert rate.after(10, 200) == 5 and rate.after(10, 10_000) == 5 and rate.after(0, 1) == 5
    assert rate.after(10, 10) == 8 and rate.after(10, 90) == 8
    rows, at = taken(reader, at)
    assert len(rows) == 1  # one that is longer than the bound still comes


# ---- polls -----------------------------------------------------------------------------------
def test_polls_keep_until_commit(tmp_path, monkeypatch):
    reader = polls.PollReader({"url": "http://nowhere/", "keep": str(tmp_path), "sendcontent": json.dumps(["a", "b"]), "interval": "3600000"})
    asked = []
    monkeypatch.setattr(reader.http, "read", lambda part: asked.append(part.value) or iter([(part.value, f"reply {part.value}")]))
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"poll": 1} and reader.latestOffset() == end  # the interval isn't over
    for _ in range(2):
        assert [r for p in reader.partitions(start, end) for r in reader.read(p)] == [(0, "a", "reply a"), (0, "b", "reply b")]
    assert asked == ["a", "b"]
    reader.commit(end)
    assert [f.path for f in shared.listed(str(tmp_path), recursive=True)] == [f"{tmp_path}/plan.json"]
    assert polls.PollReader({"keep": str(tmp_path), "interval": "0"}).latestOffset() == {"poll": 2}


# ---- archives --------------------------------------------------------------------------------
def test_archives_of_another_writer(spark, tmp_path):
    for name, mode in (("x.tar", "w"), ("y.tgz", "w:gz"), ("sub/z.tar.bz2", "w:bz2")):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        with tarfile.open(tmp_path / name, mode) as out:
            folder = tarfile.TarInfo("d")
            folder.type = tarfile.DIRTYPE
            out.addfile(folder)
            for member, body in (("d/a.txt", b"one\r\ntwo\n\nfour"), ("empty.txt", b""), ("skip.bin", b"no\n")):
                info = tarfile.TarInfo(member)
                info.size = len(body)
                out.addfile(info, io.BytesIO(body))
    (tmp_path / "other.txt").write_text("no")
    registry.register(spark)
    rows = spark.read.format("tar_lines").option("path", str(tmp_path)).option("members", r".*\.txt").load().collect()
    assert sorted((os.path.basename(r.archive), r.member, r.line, r.value) for r in rows) == [
        (a, "d/a.txt", i, v) for a in ("x.tar", "y.tgz", "z.tar.bz2") for i, v in ((1, "one"), (2, "two"), (3, ""), (4, "four"))
    ]
    assert archives.TarReader({"path": f"{tmp_path}/none"}).partitions() == []


# ---- wire formats ----------------------------------------------------------------------------
def test_native_decoding(spark):
    rng = random.Random(5)
    numbers = [0.0, 1.5, -2.75, 5e-324, -2.2e-308, 1.7976931348623157e308, float("inf"), float("-inf"), math.pi, *[struct.unpack(">d", rng.randbytes(8))[0] for _ in range(200)]]
    types = ["NUMBER", "NUMBER(2)", "VARCHAR", "BLOB", "NUMBER"]
    rows = [[rng.randrange(-(2**63), 2**63), x, rng.choice(["", "a", "\u00e9\u8a9e" * 9]), rng.randbytes(rng.randrange(5)), -1] for x in numbers]
    fields = [(f"f{i}", t) for i, t in enumerate(types)]
    sent = spark.createDataFrame([(i, records.encode_row(r, types)) for i, r in enumerate(rows)], "id int, value binary")
    got = {r[0]: list(r[1:]) for r in records.decode_rows(sent, fields).collect()}
    for i, want in enumerate(rows):
        have = got[i]
        have[3] = bytes(have[3])
        if math.isnan(want[1]):
            assert math.isnan(have.pop(1)) and have == [want[0], *want[2:]]
        else:
            assert have == want and math.copysign(1, have[1]) == math.copysign(1, want[1])
    cut = spark.createDataFrame([(1, records.encode_row(rows[2], types)[:14]), (2, None), (3, b"")], "id int, value binary")
    assert [tuple(r)[1:] for r in records.decode_rows(cut, fields).orderBy("id").collect()] == [(rows[2][0], None, None, None, None)] + [(None,) * 5] * 2


def test_topics_without_a_shape(spark):
    sent = spark.createDataFrame([("a", struct.pack(">q", 7)), ("b", struct.pack(">i", 1) + b"x"), ("c", b"?"), ("a", None)], "topic string, value binary")
    rows = records.decode_topics(sent, {"a": [("n", "NUMBER")], "b": [("s", "VARCHAR")]}).collect()
    assert [(r.topic, r.a and r.a.n, r.b and r.b.s) for r in rows] == [("a", 7, None), ("b", None, "x"), ("c", None, None), ("a", None, None)]


# ---- stored tables ---------------------------------------------------------------------------
def test_sums_of_stopped_and_repeated_batches(spark, folder, monkeypatch):
    store = StoredSums(spark, folder, ["k"], ["n"], buckets=3)
    assert store.read() is None
    batches = [spark.createDataFrame([(f"k{(i * j) % 7}" if i % 5 else None, i) for i in range(40)], "k string, n long") for j in (1, 2, 3)]
    want: dict = {}
    for number, rows in enumerate(batches):
        import streamloom.operators.stored as module

        moved = []

        def stopping(spark, path, to, real=files.move, moved=moved):
            moved.append(to)
            if len(moved) == 2:
                raise OSError("lost")
            return real(spark, path, to)

        before = None if store.read() is None else sorted(map(tuple, store.read().collect()), key=repr)
        monkeypatch.setattr(module, "move", stopping)
        with pytest.raises(OSError):
            store.apply(rows, number)
        monkeypatch.setattr(module, "move", files.move)
        assert (None if store.read() is None else sorted(map(tuple, store.read().collect()), key=repr)) == before  # half a batch doesn't show
        store.apply(rows, number)
        store.apply(rows, number)
        for r in rows.collect():
            want[r.k] = want.get(r.k, 0) + r.n
        assert {r.k: r.n for r in store.read().collect()} == want
    with pytest.raises(ValueError):
        store.apply(batches[0], 0)
    store.apply(batches[0].limit(0), 3)
    assert {r.k: r.n for r in store.read().collect()} == want


def test_seen_set_stays_where_it_lies(spark, folder):
    seen = SeenSet(spark, f"seen_{folder[-12:]}", folder, buckets=4, bits=1 << 10)
    old = spark.createDataFrame([(None if i == 0 else f"k{i}", i % 3) for i in range(600)], "k string, g long")
    seen.add(old, [F.col("k")], F.col("g"), 0)
    again = SeenSet(spark, f"{seen.name}_b", folder, buckets=4, bits=1 << 10)  # another session finds the files
    rows = spark.createDataFrame([(None if i % 900 == 0 else f"k{i % 900}", i % 4) for i in range(1800)], "k string, g long")
    known = {(r.k, r.g) for r in old.collect()}
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table in (seen, again):
            out = table.marked(rows, [F.col("k")], F.col("g"), 1)
            assert {(r.k, r.g, r.seen) for r in out.collect()} == {(r.k, r.g, (r.k, r.g) in known) for r in rows.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
    scans = [i for i, line in enumerate(plan.splitlines()) if "Bucketed: true" in line]
    assert scans and "PartitionFilters" in plan
    for i in scans:  # from a scan of the set up to its join there is no exchange
        above = plan.splitlines()[:i][::-1]
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        at = depth(plan.splitlines()[i])
        for line in above:
            if depth(line) < at:
                at = depth(line)
                if "Join" in line:
                    break
                assert "Exchange" not in line
    assert seen.drop(lambda g, b: g < 2) == 2 and {g for g, _ in seen.partitions()} == {2}


def test_writers_at_the_same_time_take_different_numbers(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    files.make_dir(spark, folder)
    files.create_new(spark, f"{folder}/.p_h_20240101.1")  # somebody else is at this one

    def write(k):
        df = spark.createDataFrame([(f"{k}-{i}", "20240101") for i in range(30)], "value string, day string").coalesce(1)
        return sinks.write_named(df, folder, "p", "h", "dat", "day", max_bytes=60)

    with ThreadPoolExecutor(3) as pool:
        names = [n for made in pool.map(write, range(3)) for n in made]
    assert len(names) == len(set(names)) > 3 and "p_h_20240101.1.dat" not in names
    assert sorted(r.value for r in spark.read.text(f"{folder}/p_h_*").collect()) == sorted(f"{k}-{i}" for k in range(3) for i in range(30))


# ---- ledgers ---------------------------------------------------------------------------------
def test_numbers_go_on(spark, folder):
    rng = random.Random(2)
    want, got, last = [], [], {}
    for number in range(3):
        rows = [(rng.choice(["a", "b", None]), rng.random()) for _ in range(rng.choice([0, 300]) if number == 1 else 300)]
        df = spark.createDataFrame(rows, "k string, x double").repartition(3)
        for attempt in range(2):  # the second try gives the same
            out = sorted(map(tuple, ledger.numbered(df, ["k"], [F.col("x")], folder, number).collect()), key=repr)
            assert attempt == 0 or out == once
            once = out
        got += out
        for k, x in sorted(rows, key=lambda r: r[1]):
            last[k] = last.get(k, 0) + 1
            want.append((k, x, last[k]))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fates_of_nulls_and_ties(spark, folder):
    rule = DistinctRule.parse({"fields": "k", "timeRange": "h:1", "timeField": "ts", "checkRange": 1})
    seen = SeenSet(spark, f"seen_{folder[-12:]}", f"{folder}/seen", buckets=2)
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    batches = [
        [(1, "a", at(5)), (2, "a", at(5, 30)), (3, None, at(5)), (4, None, at(5)), (5, "b", None), (6, "a", at(1))],
        [(7, "a", at(4, 10)), (8, "a", at(5, 59)), (9, "a", at(3, 59)), (10, "a", at(9))],
        [(11, "a", at(5)), (12, "a", at(8)), (13, "a", at(9))],
    ]
    got = {}
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
        for _ in range(2):
            out = ledger.told_apart(df, rule, ["ts", "id"], seen, f"{folder}/ledger", number)
            got |= {r.id: r.fate for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "k", 2: "d", 3: "k", 4: "d", 5: "l", 6: "k", 7: "k", 8: "d", 9: "l", 10: "k", 11: "l", 12: "k", 13: "d"}
    assert {g // 3_600_000 % 24 for g, _ in seen.partitions()} == {8, 9}  # older generations are gone


def test_places_and_sums_are_those_of_windows(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.choice(["hot", "hot", "hot", "cold", None]), i, rng.randrange(9)) for i in range(3000)], "k string, i long, v long").repartition(7)
    w = Window.partitionBy("k").orderBy("i")
    want = df.withColumn("n", F.row_number().over(w).cast("long")).withColumn("s", F.sum("v").over(w))
    placed = ranges.placed(df, ["k"], [F.col("i")], "n")
    both = ranges.summed(placed, ["k"], [F.col("i")], F.col("v"), "s")
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


# ---- reports and aggregates ------------------------------------------------------------------
def test_report_of_many_rows(spark):
    page = "".join(metrics.html_page(spark.range(2500).select("id", F.lit("<&\"'>").alias("x"), F.lit(None).cast("string").alias("none")).orderBy("id"), "a & b"))
    assert page.count("<tr>") == 2501 and "<title>a &amp; b</title>" in page
    assert "<tr><td>2499</td><td>&lt;&amp;&quot;&#x27;&gt;</td><td></td></tr></table>" in page


def test_listener_rows(spark, tmp_path):
    listener = monitor.Progress(str(tmp_path), rows=2)
    for batch in (0, 1, 2):
        listener.held.append({"host": "h", "id": "q", "run": "r", "name": "n", "batch": batch % 2, "time": f"2024-01-0{batch + 1}", "n": batch, "ms": 1, "late": 0, "state": 0})
        listener.flush()
    assert sorted((r.batch, r.n) for r in listener.table(spark).collect()) == [(0, 2), (1, 1)]


def test_own_aggregate_is_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 5 + ["x", None]), rng.choice([None, float(rng.randrange(20))]), rng.choice([None, -1.0, 0.0, 1.0, 2.5])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(6)
    made = {"med": aggregates.WeightedMedian("v", "w"), "top": aggregates.TopValues("v", 4)}
    got = {r.k: (r.med, r.top) for r in aggregates.aggregate(df, ["k"], made, fan_in=3).collect()}
    for k in ("hot", "x", None):
        own = [(v, w) for x, v, w in rows if x == k and v is not None]
        weight = sorted((v, w) for v, w in own if w is not None and w > 0)
        total, reached, median = sum(w for _, w in weight), 0.0, None
        for v, w in weight:
            reached += w
            if median is None and reached >= total / 2:
                median = v
        assert got[k] == (median, sorted({v for v, _ in own}, reverse=True)[:4])
    assert len(got) == 3
    none = df.where("v IS NULL")
    assert {r.med for r in aggregates.aggregate(none, ["k"], made).collect()} == {None}
    assert aggregates.aggregate(df.limit(0), ["k"], made).count() == 0


def test_aggregate_of_a_users_own(spark):
    class Longest(aggregates.Aggregate):
        """An aggregate of a user's own: the longest text."""

        result = "string"

        def lift(self, rows):
            return max(rows[self.inputs[0]].dropna(), key=lambda x: (len(x), x), default=None)

        def merge(self, a, b):
            return max((x for x in (a, b) if x is not None), key=lambda x: (len(x), x), default=None)

        def finish(self, state):
            return state

    df = spark.createDataFrame([(i % 3, "z" * (i % 11)) for i in range(100)], "k long, t string")
    got = {r.k: r.t for r in aggregates.aggregate(df, ["k"], {"t": Longest("t")}).collect()}
    assert got == dict.fromkeys(range(3), "z" * 10)
