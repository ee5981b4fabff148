"""Rule tables, formats and pure functions."""

import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamloom.functions import binary as B
from streamloom.functions import scalar as S
from streamloom.operators import dedup, expr, extract, records, sinks
from streamloom.plans.control import assign, changes
from streamloom.sources import files, registry
from streamloom.spec import DistinctRule, FieldSpec, StoreSpec, StreamSpec, needs_restart, parse_config
from streamloom.streaming import twins
from streamloom.types import cast_field, field_type


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("out")).first()[0]


@pytest.mark.parametrize(
    "rule, want",
    [("0", "a"), ("idx:1", "b=c"), ("1-2", "b=c|d"), ("1-?", "b=c|d"), ("1,split:1:=", "c"), ("1,substr_s:=", "b"), ("1,substr_e:=", "c"),
     ("0,substr_s:=", ""), ("9", None), ("2-1", None), ("1-9", "b=c|d"), ("reg:$1~^(.).*$", "a"), ("reg:x~zzz", None), ("mac:WHAT", None)],
)
def test_source_field_rules(spark, rule, want):
    assert one(spark, extract.text_field(F.col("v"), rule, "|"), v="a|b=c|d") == want


@pytest.mark.parametrize(
    "value, want", [(None, False), (True, True), (False, False), (0, False), (1, True), (-1, False), (1e-7, False), (0.1, True), ("", False), ("null", False), ("x", True)]
)
def test_truthiness(spark, value, want):
    kind = "bool" if isinstance(value, bool) else "num" if isinstance(value, (int, float)) else "str"
    assert one(spark, expr.truthy(F.lit(value).cast("string") if value is None else F.lit(value), kind)) is want


@pytest.mark.parametrize("text, kind", [("12", "long"), ("1.5", "double"), ("1.a", "text"), ("x", "text")])
def test_coercion(spark, text, kind):
    assert one(spark, S.coerce_kind(F.lit(text))) == kind


@pytest.mark.parametrize(
    "declared, code, fmt",
    [("NUMBER", 2, None), ("number(2)", 4, None), ("TIME_STR(yyyyMMdd)", 8, "yyyyMMdd"), ("TIME_STR", 8, "yyyyMMddHHmmss"),
     ("TIME_LONG", 8, "yyyy-MM-dd HH:mm:ss"), ("DATE", 8, "yyyy-MM-dd HH:mm:ss"), ("BLOB", 16, None), ("VARCHAR", 1, None), ("what", 1, None), (None, 1, None)],
)
def test_declared_types(declared, code, fmt):
    assert (field_type(declared).code, field_type(declared).time_format) == (code, fmt)


@pytest.mark.parametrize(
    "value, declared, default, want",
    [("12", "NUMBER", None, 12), ("x", "NUMBER", None, None), ("x", "NUMBER", 5, 5), ("1.5", "NUMBER(2)", None, 1.5), ("1970-01-01 00:00:01", "DATE", None, 1000),
     ("77", "DATE", None, 77), ("bad", "DATE", None, 0), (None, "DATE", None, None), ("19700102", "TIME_STR(yyyyMMdd)", None, 86_400_000), ("zz", "BLOB", None, None)],
)
def test_cast_field(spark, value, declared, default, want):
    assert one(spark, cast_field(F.lit(value).cast("string"), declared, default)) == want
    assert one(spark, cast_field(F.lit("0aFF"), "BLOB")) == b"\x0a\xff"


def test_rules(spark):
    df = spark.createDataFrame([(1, "12", 2.5, None), (2, "x", 0.0, "q")], "a int, t string, d double, n string")
    values = lambda rule: [r[0] for r in df.select(expr.compile_rule(rule, df.schema)[0]).collect()]
    assert values("A + 1 == 2 && t > 10") == [True, False]
    assert values("n == nil ? 'none' : n") == ["none", "q"]
    assert values("!d || math.abs(-a) == 2") == [False, True]
    assert values("string.substring(t, 0, 1) + '!'") == ["1!", "x!"]
    assert values("t =~ /\\d+/") == [True, False]
    assert values("a % 0") == [None, None]
    assert values("1 + 2 * 3 - -1") == [8, 8]
    assert [r.a for r in expr.drop_rows(df, "expr: d").collect()] == [2]
    for bad in ("missing > 1", "a +", "(a", "nofun(a)", "a b", "=~ /x/"):
        with pytest.raises(expr.RuleError):
            expr.compile_rule(bad, df.schema)
    with pytest.raises(expr.RuleError):
        expr.drop_rows(df, "a > 1")


def test_window_floor_and_late(spark):
    t = F.timestamp_millis(F.lit(3_700_000))
    assert one(spark, dedup.window_start(t, 1_800_000)) == 3_600_000
    rule = DistinctRule.parse('{"fields":"A,B","timeRange":"h:1","predictNum":5,"partField":"P","timeField":"T"}')
    assert (rule.fields, rule.window_ms, rule.part_field, rule.expected) == (("A", "B"), 3_600_000, "P", 5)
    assert DistinctRule.parse("") is None
    for bad in ({"fields": "A"}, {"timeRange": "d:1"}, {"fields": "A", "timeRange": "w:1"}, {"fields": "A", "timeRange": "d:0"}):
        with pytest.raises(ValueError):
            DistinctRule.parse(bad)


def test_null_keys_are_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, i int")
    assert sorted(r.i for r in dedup.first_arrivals(df, DistinctRule(("k",), "d", 1), ["i"]).collect()) == [1, 3]


def test_spec_and_restart():
    text = {"msg_id": 1, "name": "s", "fields": [{"name": "b", "order": 2}, {"name": "a", "order": 1}], "params": {"x": "1"},
            "stores": [{"store_id": 1, "filter_rule": "expr: a", "distinct": {"fields": "a", "timeRange": "d:1"}, "config": "k = v\n# no\nline=\\n"}]}
    spec = StreamSpec.from_json(json.dumps(text))
    assert spec.positions == {"COLLECT_HOSTNAME": 0, "COLLECT_LOG_ID": 1, "a": 2, "b": 3}
    assert spec.stores[0].options == {"k": "v", "line": "\n"} == parse_config("k=v\nline=\\n")
    change = lambda **kw: StreamSpec.from_json(text | kw)
    store = lambda **kw: change(stores=[text["stores"][0] | kw])
    assert not needs_restart(spec, store(filter_rule="expr: b"))
    assert not needs_restart(spec, store(log_level=2))
    assert not needs_restart(spec, change(scheme="select 1"))
    assert needs_restart(spec, store(distinct={"fields": "b", "timeRange": "d:1"}))
    assert needs_restart(spec, change(params={"x": "2"}))
    assert needs_restart(spec, change(fields=[{"name": "a"}]))
    assert needs_restart(spec, change(stores=[]))
    with pytest.raises(ValueError):
        StreamSpec(1, "s", (FieldSpec("a"), FieldSpec("A")))


def test_assignment():
    found = assign([("p", 22), ("n", 14), ("w", 20), ("old", 16)], ["h1", "h2"], {"h2": ["old"], "dead": ["n"]})
    assert found == {"h1": ["p", "n"], "h2": ["p", "old", "w"]} or sum(map(len, found.values())) == 5
    assert "p" in found["h1"] and "p" in found["h2"] and "old" in found["h2"]
    assert assign([("a", 14)], []) == {}
    assert changes({"h": ["a", "b"]}, {"h": ["b", "c"]}) == {"h": ({"a"}, {"c"})}


def test_published_hash_values():
    assert B.murmur2(b"", 0) == 0
    assert B.signed32(0x17770551) == B.jenkins(b"Four score and seven years ago", 0)
    assert B.jenkins(b"", 0) == B.signed32(0xDEADBEEF)
    assert B.md5_signed(b"") == f"{int('d41d8cd98f00b204e9800998ecf8427e', 16) - (1 << 128):x}"


def test_string_hashes(spark):
    def java(s):
        h = 0
        raw = s.encode("utf-16-be")
        for (u,) in struct.iter_unpack(">H", raw):
            h = (h * 31 + u) & 0xFFFFFFFF
        return B.signed32(h)

    texts = ["", "abc", "héllo", "a😀b", "polygenelubricants"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(sinks.java_hash(F.col("t"))).collect()] == [java(t) for t in texts]
    assert java("abc") == 96354
    assert all(0 <= r[0] < 7 for r in df.select(sinks.text_partition(F.col("t"), 7)).collect())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20), max_size=5), st.booleans())
def test_frames(parts, batch):
    data = b"".join(struct.pack(">i", len(p)) + p for p in parts)
    data = struct.pack(">i", len(parts)) + data if batch else data + struct.pack(">i", 0)
    assert list(records.frames(data, batch)) == parts


@settings(max_examples=50, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False), st.text(), st.binary(), st.text(), st.integers(0, 2**40))
def test_wire_rows(n, d, s, b, host, log):
    types = ["NUMBER", "NUMBER(3)", "VARCHAR", "BLOB"]
    assert records.decode_row(records.encode_row([n, d, s, b], types), types) == [n, d, s, b]
    assert records.decode_row(records.encode_row([n, d, s, b], types, host, log), types, True)[:2] == [host, log]


def test_records(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc"), (2, None), (3, "")], "i int, value string")
    assert [r.value for r in records.split_delimited(df, "value").collect()] == ["a", "b", "c"]
    log = spark.createDataFrame([("[2024-01-01 10:00:00,123] x\n y\n[2024-01-01 10:00:01,000] z",)], "value string")
    found = records.split_multiline(log, "value", r"\[${yyyy}-${mm}-${dd} ${h}:${m}:${s},${sss}\]").collect()
    assert [r.value[-3:] for r in found] == [" y\n", "] z"]


def test_paths_and_pointer():
    import re

    assert re.fullmatch(files.path_regex("/d/app_${yyyy}${mm}*.log"), "/d/app_202401_x.log")
    assert not re.fullmatch(files.path_regex("/d/app_${yyyy}.log"), "/d/app_x.log")
    assert files.path_glob("/d/${yyyy}/x*") == "/d/*/x*"
    p = files.Pointer()
    assert p.plan([("/d/a", 1, 10), ("/d/b", 2, 5)]) == [("/d/a", 0, 10), ("/d/b", 0, 5)]
    p.advance("/d/b", 2, 5)
    again = files.Pointer(str(p))
    assert again.plan([("/d/a", 1, 10), ("/d/b", 2, 5)]) == []
    assert again.plan([("/d/b", 3, 9), ("/d/c", 4, 1)]) == [("/d/b", 5, 9), ("/d/c", 0, 1)]


def test_tailing_and_text_store(spark, tmp_path):
    path = tmp_path / "in.log"
    path.write_text("one\ntwo\n")
    assert [r.value for r in files.read_ranges(spark, [(str(path), 4, 8)]).collect()] == ["two"]
    found = files.list_files(spark, f"{tmp_path}/*.log").collect()
    assert len(found) == 1 and found[0]["size"] == 8
    df = spark.createDataFrame([("h", 1, "a", None), ("h", 2, "b", 5)], "COLLECT_HOSTNAME string, COLLECT_LOG_ID long, x string, y long")
    fields = [FieldSpec("x"), FieldSpec("y", "NUMBER")]
    for codec in ("gzip", "bzip2", "default", "snappy", "none"):
        sinks.write_text(df, str(tmp_path / codec), fields, "|", codec=codec)
        assert sorted(r[0] for r in spark.read.text(str(tmp_path / codec)).collect()) == ["h|1|a|", "h|2|b|5"]


def test_fan_out_and_stores(spark):
    spec = StreamSpec(1, "s", (FieldSpec("x"),), stores=(StoreSpec(1), StoreSpec(2, filter_rule="expr: x == 'a'"), StoreSpec(3, state=0)))
    df = spark.createDataFrame([("h", 1, "a"), ("h", 2, "b")], "COLLECT_HOSTNAME string, COLLECT_LOG_ID long, x string")
    got = {}
    sinks.write_stores(df, spec, ["COLLECT_LOG_ID"], lambda s, rows: got.setdefault(s.store_id, sorted(r.x for r in rows.collect())))
    assert got == {1: ["a", "b"], 2: ["b"]}
    log = sinks.detail_log(df, spec, spec.stores[0], "COLLECT", "COLLECT_LOG_ID").first()
    assert log["content"] == "[a]"


def test_stream_equals_batch(spark, sf, tmp_path):
    from streamloom.plans.catalog import DAY_RULE, events

    stream = twins.finish(twins.dedup_stream(twins.read_events(spark, f"{sf}/events.parquet"), DAY_RULE))
    batch = dedup.first_arrivals(events(spark, sf), DAY_RULE, ["ts", "event_id"])
    key = lambda df: sorted((r.user_id, r.event_type, str(r.ts)[:10]) for r in df.collect())
    assert key(stream) == key(batch)
    for i, rows in enumerate([["a", "a", "b"], ["b", "c"]]):
        spark.createDataFrame([("k", v) for v in rows], "k string, v string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}.parquet"))
    source = spark.readStream.schema("k string, v string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = twins.finish(twins.change_only_stream(source, "k", "v"), "append", str(tmp_path / "ck"))
    assert {r.v for r in found.collect()} == {"a", "b", "c"}


def test_sources(spark):
    assert [r.value for r in registry.callable_source(spark, "json:loads", '["a", "b"]').collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        registry.callable_source(spark, "json")
    registry.register(spark)
    assert registry.kind_of(StreamSpec(1, "s", (), trigger=12)) == "http"
    with pytest.raises(ValueError):
        registry.kind_of(StreamSpec(1, "s", (), trigger=99))


def test_http_and_socket_sources(spark):
    import http.server
    import socket
    import threading

    class Echo(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"got " + body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    registry.register(spark)
    url = f"http://127.0.0.1:{server.server_port}/x"
    df = spark.read.format("messages_http").option("url", url).option("contentKey", "q").option("sendContent", '["1","2"]').load()
    assert sorted(r.value for r in df.collect()) == ["got q=1", "got q=2"]
    server.shutdown()

    listener = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = listener.accept()
        with peer:
            peer.sendall(struct.pack(">ii2si3si", 2, 2, b"ab", 3, b"cde", 0))

    threading.Thread(target=serve, daemon=True).start()
    port = listener.getsockname()[1]
    df = spark.read.format("messages_socket").option("host", "127.0.0.1").option("port", port).option("batch", "true").load()
    assert [bytes(r.value) for r in df.collect()] == [b"ab", b"cde"]


def test_scalars(spark):
    lit = F.lit
    table = [
        (S.human_size(lit(1536)), "1.5k"), (S.byte_size(lit(1536)), "1.5KB"), (S.percent(lit(0.98769)), "98.76%"), (S.camelize(lit("ab_cd")), "AbCd"),
        (S.strip_ends(lit("[x]"), "[", "]"), "x"), (S.loose_date(lit("2024")).cast("string"), "2024-01-01 00:00:00"), (S.select_list(lit("select a, b from t")), "a, b"),
        (S.unescape(S.escape(lit("a,b\\"))), "a,b\\"), (S.duration_text(lit(3_723_000)), "1hrs, 2mins, 3sec"), (S.larger(lit("9"), lit("10")), "10"),
        (S.smaller(lit("9"), lit(None)), "9"), (S.leading_double(lit("1.5x")), 1.5), (S.is_int(lit("1.5")), False), (S.full_match(lit("ab"), "a."), True),
        (S.simple_host(lit("a.b.c")), "a"), (S.pad_front(lit("abc"), "0", 2), None), (S.recode(lit("ÄãºÃ")), "你好"), (S.split_escaped(lit("a\\,b,c,,")), ["a\\,b", "c"]),
        (S.tokens(lit(" a, ,b")), ["a", "b"]), (S.name_value(lit("a=b"), "="), ["a", "b"]), (S.name_value(lit("a"), "="), None),
        (S.now_macro("N_YYYYMMP", lit("2024-01-15").cast("timestamp")), "202312"), (S.file_name(lit("/a/b")), "b"), (S.same_text(lit("A"), lit("a")), True),
        (F.to_json(S.bracket_map(F.array(lit("[a:1]")))), '{"a":"1"}'), (F.to_json(S.arg_map(lit("a"), lit("1"), lit("b"), lit(None))), '{"a":"1"}'),
        (F.to_json(S.column_groups(lit("[f:c:[x,y]]-[g:d:[z]]"))), '[{"family":"f","col":"c","fields":["x","y"]},{"family":"g","col":"d","fields":["z"]}]'),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(table)]).first()
    assert list(row) == [want for _, want in table]
    assert B.unpack(B.pack({"a": [1]})) == {"a": [1]}
    assert B.increment(b"\x00\xff") == b"\x01\x00"
    assert B.split_range(b"\x00", b"\x10", 2) == [b"\x00", b"\x08", b"\x10"]
