"""The registered queries of the engine's own operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import scalar as S
from ..operators import dedup, expr, extract, metrics, records, sinks, topology
from ..sources import registry
from ..spec import DistinctRule, FieldSpec, StoreSpec, StreamSpec
from ..streaming import twins
from ..types import cast_field
from .builder import build, parsed
from .control import assign

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """``ts`` as an instant; it is stored without a zone and means UTC."""
    return t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def ms(col: str = "ts"):
    return F.unix_millis(F.col(col).cast("timestamp"))


# ---- the ingest plan -------------------------------------------------------------------------
DAY_RULE = DistinctRule(("user_id", "event_type"), "d", 1, time_field="ts")
INGEST = StreamSpec(
    1, "events", (FieldSpec("k", "NUMBER", "k"),), content="map",
    stores=(StoreSpec(1, filter_rule="expr: event_type == 'error' || value < 5", distinct=DAY_RULE),),
)


@query(
    """with k as (select *, cast(json_extract_string(props,'$.k') as bigint) k from events
              where not coalesce(event_type='error' or value<5, false)),
     d as (select *, row_number() over (partition by user_id,event_type,date_trunc('day',ts) order by ts,event_id) rn from k)
select event_type, count(*) n_in, cast(sum(case when rn=1 then 1 else 0 end) as bigint) n_out,
       cast(sum(case when rn>1 then 1 else 0 end) as bigint) n_dup, cast(sum(case when rn=1 then k end) as bigint) sum_k
from d group by 1"""
)
def flagship_ingest(spark, sf):
    """Messages parsed, enveloped, filtered and de-duplicated for a store, with its counters."""
    rows = extract.envelope(parsed(events(spark, sf), INGEST, "props"))
    rows = expr.drop_rows(rows, INGEST.stores[0].filter_rule)
    first = F.col("nth") == 1
    return dedup.numbered(rows, DAY_RULE, ["ts", "event_id"]).groupBy("event_type").agg(
        F.count("*").alias("n_in"), F.count_if(first).alias("n_out"), F.count_if(~first).alias("n_dup"),
        F.sum(F.when(first, F.col("k"))).alias("sum_k"),
    )


# ---- extraction ------------------------------------------------------------------------------
def messages(df: DataFrame, value, key: str) -> DataFrame:
    return df.select(key, value.alias("value"))


def spec_of(*fields: tuple[str, str, str], content: str = "text", split: str = "|") -> StreamSpec:
    return StreamSpec(7, "probe", tuple(FieldSpec(n, kind, src, i) for i, (n, kind, src) in enumerate(fields)), content=content, split=split)


def customer_text(spark, sf):
    c = t(spark, sf, "customer")
    return messages(c, F.concat_ws("|", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")


@query("select event_id, cast(json_extract_string(props,'$.k') as bigint) k, json_extract_string(props,'$.none') as gone from events")
def parse_json_map(spark, sf):
    return extract.extract(messages(events(spark, sf), F.col("props"), "event_id"), spec_of(("k", "NUMBER", "k"), ("gone", "VARCHAR", "none"), content="map"))


@query("select o_orderkey, o_orderstatus as status, o_custkey as cust, cast(null as varchar) as gone from orders")
def parse_json_array(spark, sf):
    o = t(spark, sf, "orders")
    value = F.to_json(F.array(F.col("o_orderstatus"), F.col("o_custkey").cast("string")))
    return extract.extract(messages(o, value, "o_orderkey"), spec_of(("status", "VARCHAR", "0"), ("cust", "NUMBER", "1"), ("gone", "VARCHAR", "5"), content="array"))


@query("select c_custkey, c_name as a, c_mktsegment as b from customer")
def parse_text_idx(spark, sf):
    return extract.extract(customer_text(spark, sf), spec_of(("a", "VARCHAR", "1"), ("b", "VARCHAR", "idx:3")))


@query("select c_custkey, c_name || '|' || c_nationkey as a from customer")
def parse_text_range(spark, sf):
    return extract.extract(customer_text(spark, sf), spec_of(("a", "VARCHAR", "1-2")))


@query("select c_custkey, c_nationkey || '|' || c_mktsegment as a from customer")
def parse_text_tail(spark, sf):
    return extract.extract(customer_text(spark, sf), spec_of(("a", "VARCHAR", "2-?")))


@query("select c_custkey, split_part(c_name,'#',2) as a from customer")
def parse_sub_split(spark, sf):
    return extract.extract(customer_text(spark, sf), spec_of(("a", "VARCHAR", "1,split:1:#")))


@query("select c_custkey, split_part(c_name,'#',1) as a, '' as b from customer")
def parse_substr_s(spark, sf):
    return extract.extract(customer_text(spark, sf), spec_of(("a", "VARCHAR", "1,substr_s:#"), ("b", "VARCHAR", "1,substr_s:@")))


@query("select c_custkey, substr(c_name, strpos(c_name,'#')+1) as a from customer")
def parse_substr_e(spark, sf):
    return extract.extract(customer_text(spark, sf), spec_of(("a", "VARCHAR", "1,substr_e:#")))


@query(
    """select page_id, case when regexp_matches(url,'^https?://([^/]+)/.*$') then regexp_replace(url,'^https?://([^/]+)/.*$','\\1') end as host,
       case when regexp_matches(url,'never') then url end as gone from pages"""
)
def parse_regex(spark, sf):
    pages = messages(t(spark, sf, "pages"), F.col("url"), "page_id")
    return extract.extract(pages, spec_of(("host", "VARCHAR", "reg:$1~^https?://([^/]+)/.*$"), ("gone", "VARCHAR", "reg:x~never")))


@query("select r_regionkey, '7' as id, 'node1' as host, cast(null as varchar) as other from region")
def parse_macros(spark, sf):
    r = messages(t(spark, sf, "region"), F.col("r_name"), "r_regionkey")
    return extract.extract(r, spec_of(("id", "VARCHAR", "mac:MSG_ID"), ("host", "VARCHAR", "mac:HOST"), ("other", "VARCHAR", "mac:WHAT")), host="node1")


@query(
    """select 'node1' as "COLLECT_HOSTNAME", row_number() over (partition by event_type order by ts, event_id) as "COLLECT_LOG_ID",
       event_id, event_type from events"""
)
def envelope_seq(spark, sf):
    return extract.envelope(events(spark, sf), "node1", ["ts", "event_id"], ["event_type"]).select("COLLECT_HOSTNAME", "COLLECT_LOG_ID", "event_id", "event_type")


@query(
    """select event_id, try_cast(json_extract_string(props,'$.k') as bigint) as n, try_cast(event_type as bigint) as bad,
       epoch_ms(try_strptime(strftime(ts,'%Y-%m-%d %H:%M:%S'),'%Y-%m-%d %H:%M:%S')) as at, try_cast(json_extract_string(props,'$.k') as double) as d from events"""
)
def typed_cast(spark, sf):
    e = events(spark, sf).withColumn("k", F.get_json_object("props", "$.k"))
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.select(
        "event_id", cast_field(F.col("k"), "NUMBER").alias("n"), cast_field(F.col("event_type"), "NUMBER").alias("bad"),
        cast_field(text, "DATE").alias("at"), cast_field(F.col("k"), "NUMBER(2)").alias("d"),
    )


@query("select event_id, coalesce(try_cast(event_type as bigint), 9) as n, cast(0 as bigint) as at from events")
def typed_cast_default(spark, sf):
    return events(spark, sf).select("event_id", cast_field(F.col("event_type"), "NUMBER", 9).alias("n"), cast_field(F.col("event_type"), "TIME_STR").alias("at"))


@query("select o_custkey as x, count(*) as n from orders group by 1")
def typed_parse_once(spark, sf):
    texts = t(spark, sf, "orders").select(F.to_json(F.array(F.col("o_custkey").cast("string"))).alias("value"))
    return extract.extract(texts, spec_of(("x", "NUMBER", "0"), content="array")).groupBy("x").agg(F.count("*").alias("n"))


# ---- records ---------------------------------------------------------------------------------
@query("select doc_id, line as value from (select doc_id, unnest(string_split(replace(text,chr(13),chr(10)),chr(10))) as line from documents) where line <> ''")
def batch_explode(spark, sf):
    return records.split_batch(t(spark, sf, "documents").select("doc_id", F.col("text").alias("value")), "value")


@query("select o_orderkey, unnest([o_orderstatus, o_orderpriority]) as value from orders")
def batch_explode_json(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.to_json(F.array("o_orderstatus", "o_orderpriority")).alias("value"))
    return records.split_batch(o, "value", "array")


@query(
    """select conv_id, '[2024-01-0' || (turn % 9 + 1) || ' 10:00:00] ' || replace(text, '[', '(') || chr(10) as value
       from conversations"""
)
def multiline_records(spark, sf):
    c = t(spark, sf, "conversations").where("text is not null")
    line = F.concat(F.lit("[2024-01-0"), F.col("turn") % 9 + 1, F.lit(" 10:00:00] "), F.replace("text", F.lit("["), F.lit("(")), F.lit("\n"))
    whole = c.groupBy("conv_id").agg(F.array_join(F.collect_list(line), "").alias("value"))
    return records.split_multiline(whole, "value", r"\[${yyyy}-${mm}-${dd} ${h}:${m}:${s}\]")


@query()
def xpath_node(spark, sf):
    r = t(spark, sf, "region")
    xml = F.concat(F.lit("<a><b><c>"), F.col("r_name"), F.lit("</c></b></a>"))
    return r.select("r_regionkey", records.xpath_text(xml, "/a/b/c").alias("name"), records.xpath_text(F.lit("<a><br></a>"), "/a").alias("broken"))


@query("select o_orderkey, o_totalprice, o_orderstatus from orders")
def binary_roundtrip(spark, sf):
    fields = [("o_orderkey", "NUMBER"), ("o_totalprice", "NUMBER(2)"), ("o_orderstatus", "VARCHAR")]
    o = t(spark, sf, "orders").select(*[n for n, _ in fields])
    return records.decode_rows(records.encode_rows(o, fields).select("value"), fields)


@query("select n_nationkey, cast(len(n_name) as int) as n_bytes from nation")
def frame_split(spark, sf):
    n = t(spark, sf, "nation")
    framed = n.select("n_nationkey", F.concat(F.unhex(F.lpad(F.hex(F.octet_length("n_name")), 8, "0")), F.encode("n_name", "UTF-8"), F.unhex(F.lit("00000000"))).alias("value"))
    return records.split_frames(framed, "value").select("n_nationkey", F.octet_length("value").alias("n_bytes"))


@query("select r_regionkey, 't' || r_regionkey as topic, r_name || ',x' as content from region")
def topic_split(spark, sf):
    r = t(spark, sf, "region").withColumn("v", F.concat(F.lit("t"), "r_regionkey", F.lit(","), "r_name", F.lit(",x")))
    topic, content = extract.topic_content(F.col("v"))
    return r.select("r_regionkey", topic.alias("topic"), content.alias("content"))


# ---- filters ---------------------------------------------------------------------------------
@query("select event_id from events where not coalesce((event_type = 'click' and value > 100) or user_id % 7 = 0, false)")
def filter_expr(spark, sf):
    return expr.drop_rows(events(spark, sf), "expr: (EVENT_TYPE == 'click' && value > 100) || user_id % 7 == 0").select("event_id")


@query("select l_orderkey, l_linenumber from lineitem where not (l_discount > 1e-6)")
def filter_truthy(spark, sf):
    return expr.drop_rows(t(spark, sf, "lineitem"), "expr: l_discount").select("l_orderkey", "l_linenumber")


@query("select event_id from events where event_type <> 'view'")
def filter_null(spark, sf):
    e = events(spark, sf).withColumn("maybe", F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("value")))
    return expr.drop_rows(e, "expr: maybe == nil").select("event_id")


@query("select event_id from events where user_id % 3 <> 0")
def filter_empty(spark, sf):
    e = events(spark, sf).withColumn("v", F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("event_type")))
    return parsed(e.select("event_id", "v"), spec_of(("kind", "VARCHAR", "0")), "v").select("event_id")


@query(
    """select event_id, length(event_type) > 4 and contains(event_type, 'i') as a,
       case when value > 50 then 'hi' else 'lo' end as b, regexp_matches(event_type, '^(?:s.*)$') as c, reverse(event_type) || reverse('ab') as d from events"""
)
def rule_values(spark, sf):
    e = events(spark, sf)
    rules = {"a": "string.length(event_type) > 4 && string.contains(event_type, 'i')", "b": "value > 50 ? 'hi' : 'lo'", "c": "event_type =~ /s.*/", "d": "reverse(event_type, 'ab')"}
    return e.select("event_id", *[expr.compile_rule(r, e.schema)[0].alias(n) for n, r in rules.items()])


@query(
    """select user_id, event_id, event_type from (select *, lag(event_type) over w as b, row_number() over w as r from events
       window w as (partition by user_id order by ts, event_id)) where r = 1 or event_type is distinct from b"""
)
def change_only(spark, sf):
    return expr.change_only(events(spark, sf), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("select event_type, user_id, 'known' as side from events where event_type in ('click','view') union all select event_type, user_id, 'rejected' from events where event_type not in ('click','view')")
def topic_route(spark, sf):
    specs = spark.createDataFrame([("click",), ("view",)], "event_type string")
    known, rejected = registry.route(events(spark, sf), specs, "event_type")
    cols = ["event_type", "user_id"]
    return known.select(*cols, F.lit("known").alias("side")).unionByName(rejected.select(*cols, F.lit("rejected").alias("side")))


# ---- duplicates ------------------------------------------------------------------------------
FIRST_SQL = """select event_id, user_id, event_type from events
qualify row_number() over (partition by {keys} order by ts, event_id) = 1"""


def firsts(spark, sf, rule):
    return dedup.first_arrivals(events(spark, sf), rule, ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query(FIRST_SQL.format(keys="user_id, event_type, date_trunc('day', ts)"))
def dedup_tumbling_day(spark, sf):
    return firsts(spark, sf, DAY_RULE)


@query(FIRST_SQL.format(keys="user_id, event_type, epoch_us(ts) // 7200000000"))
def dedup_tumbling_hour(spark, sf):
    return firsts(spark, sf, DistinctRule(("user_id", "event_type"), "h", 2, time_field="ts"))


@query(FIRST_SQL.format(keys="user_id, event_type, date_trunc('day', ts)"))
def dedup_partitioned(spark, sf):
    return firsts(spark, sf, DistinctRule(("user_id",), "d", 1, part_field="event_type", time_field="ts"))


@query(FIRST_SQL.format(keys="user_id, event_type"))
def dedup_global(spark, sf):
    return firsts(spark, sf, DistinctRule(("user_id", "event_type"), "d", 1))


@query("select count(*) as n_rows, (select count(*) from (select distinct user_id, event_type from events)) as n_keys, count(*) - (select count(*) from (select distinct user_id, event_type from events)) as n_dup from events")
def dup_count(spark, sf):
    return dedup.duplicates(events(spark, sf), ["user_id", "event_type"])


@query("select event_id from events where ts < timestamp '2024-01-10'")
def late_rows(spark, sf):
    return dedup.split_late(events(spark, sf), "ts", F.lit("2024-01-10").cast("timestamp"))[1].select("event_id")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def seen_anti(spark, sf):
    seen = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return dedup.unseen(t(spark, sf, "customer"), seen, ["c_custkey"]).select("c_custkey")


# ---- counters, rates and windows -------------------------------------------------------------
@query("select l_returnflag, count(*) as n, cast(sum(length(l_linestatus)) as bigint) as bytes, count(*) filter (l_discount > 0.05) as failed from lineitem group by 1")
def metric_counters(spark, sf):
    return metrics.counters(t(spark, sf, "lineitem"), ["l_returnflag"], F.octet_length("l_linestatus"), F.col("l_discount") > 0.05)


@query("select l_suppkey % 5 as host, count(*) as n from lineitem group by 1")
def metric_by_host(spark, sf):
    return metrics.group_by_method(t(spark, sf, "lineitem").withColumn("host", F.col("l_suppkey") % 5), ["host"], [("n", "COUNT", "l_orderkey")])


@query("select l_returnflag as msg, l_linestatus as store, count(*) as n from lineitem group by 1, 2")
def metric_by_msg_store(spark, sf):
    df = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("msg"), F.col("l_linestatus").alias("store"))
    return metrics.group_by_method(df, ["msg", "store"], [("n", "COUNT", "msg")])


@query("select l_returnflag as msg, to_json(map_from_entries(list((l_linestatus, n) order by l_linestatus))) as stores from (select l_returnflag, l_linestatus, count(*) n from lineitem group by 1, 2) group by 1")
def metric_store_map(spark, sf):
    each = metrics.merged_by(metric_by_msg_store(spark, sf), ["msg"], "store", "n", "stores")
    return each.select("msg", F.to_json("stores").alias("stores"))


@query("select case when grouping(h)=0 then 'host' when grouping(m)=0 then 'msg' else 'all' end as level, h, m, count(*) as n, cast(sum(l_quantity) as bigint) as qty from (select *, l_suppkey % 5 as h, l_returnflag as m from lineitem) group by grouping sets ((h),(m),())")
def metric_grouping_sets(spark, sf):
    df = t(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("h"), F.col("l_returnflag").alias("m"), "l_quantity")
    return metrics.roll_up(df, "h", "m", {"n": F.count("*"), "qty": F.sum("l_quantity").cast("bigint")})


@query("select l_returnflag, cast(sum(m) as bigint) as unsent from (select l_returnflag, l_suppkey, max(l_linenumber) m from lineitem group by 1, 2) group by 1")
def metric_nested_max(spark, sf):
    return metrics.nested_max(t(spark, sf, "lineitem"), ["l_returnflag"], ["l_suppkey"], "l_linenumber", "unsent")


@query("select event_type, epoch_us(min(ts)) // 1000 as first_ms, epoch_us(max(ts)) // 1000 as last_ms from events group by 1")
def metric_start_time(spark, sf):
    df = events(spark, sf).withColumn("at", ms())
    return metrics.group_by_method(df, ["event_type"], [("first_ms", "MIN", "at"), ("last_ms", "MAX", "at")])


@query("select user_id, case when count(*) > 1 then cast(sum(d) as bigint) // (count(*) - 1) end as rate from (select user_id, event_id - lag(event_id) over (partition by user_id order by event_id) as d from events) group by 1")
def rate_delta(spark, sf):
    return metrics.rates(events(spark, sf), ["user_id"], ["event_id"], "event_id")


@query("select epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % 5000 as window_ms, count(*) as n, count(*) // 5 as per_second from events group by 1")
def window_5s_rate(spark, sf):
    return metrics.throughput(events(spark, sf), "ts")


@query("select event_type, epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % 3600000 as slot_ms, min(epoch_us(ts) // 1000) as start_ms, max(epoch_us(ts) // 1000) as end_ms, cast(sum(length(props)) as bigint) as bytes, count(*) as n from events group by 1, 2")
def collect_log(spark, sf):
    return metrics.collect_log(events(spark, sf), "event_type", "ts", F.octet_length("props"), 60)


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def last_snapshot(spark, sf):
    return metrics.last_snapshots(events(spark, sf), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select user_id, event_id, slot from (select *, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as int) as slot from events) where slot <= 5")
def ring_last5(spark, sf):
    return metrics.ring(events(spark, sf), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "slot")


@query("select event_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from events")
def running_counter(spark, sf):
    return metrics.running(events(spark, sf), ["user_id"], ["ts", "event_id"], F.lit(1), "n").select("event_id", "n")


@query("select count(*) as buckets, count(*) filter (n=0) as empty, count(*) filter (n<15) as small, count(*) filter (n>85) as large, min(n) as least, max(n) as most, cast(sum(n) as bigint) as total, round(avg(n),6) as mean, round(var_pop(n),6) as variance from (select o_custkey % 97 as b, count(*) n from orders group by 1)")
def bucket_stats(spark, sf):
    counts = t(spark, sf, "orders").groupBy((F.col("o_custkey") % 97).alias("b")).agg(F.count("*").alias("n"))
    return metrics.bucket_stats(counts, "n").withColumns({c: F.round(c, 6) for c in ("mean", "variance")})


@query("select depth, count(*) as n_keys from (select o_custkey, count(*) as depth from orders group by 1) group by 1")
def chain_histogram(spark, sf):
    return metrics.chain_histogram(t(spark, sf, "orders"), "o_custkey")


@query("select min(o_orderkey) as lo, max(o_orderkey) as hi, cast(sum(o_custkey) as bigint) as total from orders")
def minmaxsum(spark, sf):
    return metrics.group_by_method(t(spark, sf, "orders"), [], [("lo", "MIN", "o_orderkey"), ("hi", "MAX", "o_orderkey"), ("total", "SUM", "o_custkey")])


@query("select max(o_orderkey % 1000) as m from orders")
def max_mod(spark, sf):
    return metrics.group_by_method(t(spark, sf, "orders"), [], [("m", "MAX", F.col("o_orderkey") % 1000)])


@query("select l_returnflag, count(l_orderkey) as c, max(l_quantity) as hi, min(l_quantity) as lo, cast(sum(l_quantity) as bigint) as s, round(avg(l_quantity),6) as a, cast(sum(l_linenumber * l_linenumber) as bigint) as f from lineitem group by 1")
def group_methods(spark, sf):
    fun = F.sum(F.col("l_linenumber") * F.col("l_linenumber"))
    outputs = [("c", "COUNT", "l_orderkey"), ("hi", "MAX", "l_quantity"), ("lo", "MIN", "l_quantity"), ("s", "SUM", "l_quantity"), ("a", "AVG", "l_quantity"), ("f", "FUN", fun)]
    return metrics.group_by_method(t(spark, sf, "lineitem"), ["l_returnflag"], outputs).withColumns({"s": F.col("s").cast("bigint"), "a": F.round("a", 6)})


@query("select o_custkey, cast(count(*) as bigint) as n, cast(sum(o_orderkey) as bigint) as s from orders group by 1")
def upsert_accumulate(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", F.lit(1).cast("bigint").alias("n"), F.col("o_orderkey").alias("s"))
    old = o.where("s % 2 = 0").groupBy("o_custkey").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return metrics.accumulate(old, o.where("s % 2 = 1"), ["o_custkey"], ["n", "s"])


@query("select o_orderstatus, string_agg(o_orderpriority, ';' order by o_orderpriority) as p from (select distinct o_orderstatus, o_orderpriority from orders) group by 1")
def string_aggregate(spark, sf):
    return metrics.joined(t(spark, sf, "orders"), ["o_orderstatus"], "o_orderpriority", ";").withColumnRenamed("o_orderpriority", "p")


@query("select l_orderkey, l_linenumber, greatest(l_quantity, l_tax * 100) as hi, least(l_quantity, l_tax * 100) as lo from lineitem")
def greatest_least(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.larger(F.col("l_quantity"), F.col("l_tax") * 100).alias("hi"), S.smaller(F.col("l_quantity"), F.col("l_tax") * 100).alias("lo"))


# ---- look-ups, sets and order ----------------------------------------------------------------
@query("select n_name, r_name from nation left join region on n_regionkey = r_regionkey and r_name <> 'ASIA'")
def lookup_join(spark, sf):
    rule = topology.Lookup("region", (("n_regionkey", "r_regionkey"),), ("r_name",), only="r_name != 'ASIA'")
    return topology.look_up(t(spark, sf, "nation"), t(spark, sf, "region"), rule).select("n_name", "r_name")


@query("select o_orderkey, c_mktsegment, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey where o_totalprice > 1000")
def lookup_chain(spark, sf):
    node = topology.Node(
        ("orders",), "o_totalprice > 1000",
        (
            topology.Lookup("customer", (("o_custkey", "c_custkey"),), ("c_mktsegment", "c_nationkey")),
            topology.Lookup("nation", (("c_nationkey", "n_nationkey"),), ("n_name",)),
        ),
        (("o_orderkey", "o_orderkey"), ("c_mktsegment", "c_mktsegment"), ("n_name", "n_name")),
    )
    return topology.run_topology({"out": node}, {n: t(spark, sf, n) for n in ("orders", "customer", "nation")})["out"]


@query("select c_mktsegment as segment, count(o_orderkey) as n, max(o_totalprice) as top from orders join customer on o_custkey = c_custkey group by 1 having count(o_orderkey) > 10")
def topology_group(spark, sf):
    up = topology.Node(("orders",), lookups=(topology.Lookup("customer", (("o_custkey", "c_custkey"),), ("c_mktsegment",)),), output_filter="c_mktsegment != nil")
    down = topology.Node(("up",), group_keys=("c_mktsegment",), group=(("n", "COUNT", "o_orderkey"), ("top", "MAX", "o_totalprice")), output_filter="n > 10", rename={"c_mktsegment": "segment"})
    return topology.run_topology({"down": down, "up": up}, {n: t(spark, sf, n) for n in ("orders", "customer")})["down"]


@query("select o_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey) as parts from orders join lineitem on o_orderkey = l_orderkey group by 1")
def correlated_collect(spark, sf):
    lines = t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = topology.gather(t(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey", "items", "l_linenumber", ["l_partkey"])
    return out.where("items is not null").select("o_orderkey", F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def assign_semi(spark, sf):
    return topology.known(t(spark, sf, "customer"), t(spark, sf, "orders"), ("c_custkey", "o_custkey")).select("c_custkey")


@query("select coalesce(a.k, b.k) as k, case when a.k is null then 'new' when b.k is null then 'old' else 'both' end as side from (select distinct o_custkey k from orders where o_orderkey % 2 = 0) a full join (select distinct o_custkey k from orders where o_orderkey % 3 = 0) b on a.k = b.k")
def assign_full(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return topology.compare(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), "k")


@query("select event_id from events where event_type <> 'error' qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1 order by ts, event_id limit 20")
def topk_limit(spark, sf):
    kept = expr.drop_rows(events(spark, sf), "expr: event_type == 'error'")
    first = dedup.first_arrivals(kept, DistinctRule(("user_id", "event_type"), "d", 1), ["ts", "event_id"])
    return first.orderBy("ts", "event_id").limit(20).select("event_id")


@query("select arg_min(s_suppkey, (s_acctbal, s_suppkey)) as s from supplier")
def argmin_host(spark, sf):
    return metrics.best(t(spark, sf, "supplier"), "s_suppkey", ["s_acctbal", "s_suppkey"]).toDF("s")


@query("select arg_max(s_suppkey, (s_acctbal, s_suppkey)) as s from supplier")
def argmax_part(spark, sf):
    return metrics.best(t(spark, sf, "supplier"), "s_suppkey", ["s_acctbal", "s_suppkey"], least=False).toDF("s")


@query("select n_name as name from nation union all select r_name from region")
def union_all(spark, sf):
    return topology.merged(t(spark, sf, "nation").select(F.col("n_name").alias("name")), t(spark, sf, "region").select(F.col("r_name").alias("name")))


@query("select c_custkey as k from customer except select o_custkey from orders")
def set_diff(spark, sf):
    return topology.only_in(t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), t(spark, sf, "orders").select("o_custkey"))


@query("select c_custkey as k from customer intersect select o_custkey from orders")
def set_intersect(spark, sf):
    return topology.in_both(t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), t(spark, sf, "orders").select("o_custkey"))


@query("select o_orderkey from orders where o_orderdate > timestamp '1996-01-01' order by o_orderkey")
def changed_since(spark, sf):
    o = t(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return registry.changed_since(o, "o_orderdate", "1996-01-01", "o_orderkey").select("o_orderkey")


@query("select n_name as name, n_nationkey as id, cast(null as varchar) as gone from nation where n_regionkey = 2")
def sql_poll(spark, sf):
    spec = StreamSpec(3, "nations", (FieldSpec("name", "VARCHAR", "N_NAME"), FieldSpec("id", "NUMBER", "n_nationkey"), FieldSpec("gone", "VARCHAR", "none")), trigger=14, scheme="select * from poll_nation where n_regionkey = 2")
    return registry.sql_source(spark, spec, {"poll_nation": t(spark, sf, "nation")})


# ---- scalar functions ------------------------------------------------------------------------
@query("select c_custkey, upper(substr(c_mktsegment,1,1)) || substr(c_mktsegment,2) as cap, replace(c_name,' ','_') as und, len(c_name) - len(replace(c_name,'0','')) as zeros, split_part(c_name,'#',2) as tail, reverse(c_name) as rev from customer")
def str_basics(spark, sf):
    return t(spark, sf, "customer").select(
        "c_custkey", S.capitalize(F.col("c_mktsegment")).alias("cap"), S.blanks_to_underlines(F.col("c_name")).alias("und"),
        S.count_char(F.col("c_name"), "0").cast("bigint").alias("zeros"), F.substring_index("c_name", "#", -1).alias("tail"), F.reverse("c_name").alias("rev"),
    )


@query("select p_partkey, replace(replace(replace(replace(replace(p_name,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'  ','&nbsp;&nbsp;') as html, lpad(p_brand,12,'*') as pad, replace(replace(p_name,'\\','\\\\'),',','\\,') as esc from part")
def str_escape(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey", S.escape_html(F.col("p_name")).alias("html"), S.pad_front(F.col("p_brand"), "*", 12).alias("pad"), S.escape(F.col("p_name")).alias("esc"))


@query("select page_id, regexp_extract(url,'([^/]*)$',1) as name, regexp_replace(url,'/[^/]*$','') as parent from pages")
def str_paths(spark, sf):
    return t(spark, sf, "pages").select("page_id", S.file_name(F.col("url")).alias("name"), S.parent_path(F.col("url")).alias("parent"))


@query("select c_custkey, coalesce(try_cast(split_part(c_name,'#',2) as int),0) as n, coalesce(try_cast(c_mktsegment as int),0) as bad, cast(regexp_extract(split_part(c_name,'#',2) || 'm','^[0-9]+') as bigint) as lead from customer")
def convert_basics(spark, sf):
    tail = F.substring_index("c_name", "#", -1)
    return t(spark, sf, "customer").select("c_custkey", S.to_int(tail).alias("n"), S.to_int(F.col("c_mktsegment")).alias("bad"), S.leading_long(F.concat(tail, F.lit("m"))).alias("lead"))


@query("select n_nationkey, n_nationkey::bigint * 1024 as k, n_nationkey::bigint * 1073741824 as g, cast(null as bigint) as bad from nation")
def size_parse(spark, sf):
    n = F.col("n_nationkey").cast("string")
    return t(spark, sf, "nation").select("n_nationkey", S.parse_size(F.concat(n, F.lit("k"))).alias("k"), S.parse_size(F.concat(n, F.lit("G"))).alias("g"), S.parse_size(F.lit("x1")).alias("bad"))


@query("select o_orderkey, strftime(o_orderdate,'%Y%m') as month, strftime(o_orderdate,'%Y%m%d') as day, epoch_ms(o_orderdate) // 1000 as secs, epoch_ms(strptime(strftime(o_orderdate,'%Y%m%d'),'%Y%m%d')) as back from orders")
def date_basics(spark, sf):
    o = t(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", S.month_number(F.col("o_orderdate")).alias("month"), S.day_number(F.col("o_orderdate")).alias("day"), S.seconds_of(ms("o_orderdate")).alias("secs"), S.text_millis(S.day_number(F.col("o_orderdate")), "yyyyMMdd").alias("back"))


@query("select event_id, epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % 1800000 as start_ms from events")
def date_bucket(spark, sf):
    return events(spark, sf).select("event_id", dedup.window_start(F.col("ts"), 1_800_000).alias("start_ms"))


@query("select event_id, case when value >= 3600 then cast(cast(floor(value / 3600) as bigint) as varchar) || 'hrs, ' else '' end || case when cast(floor(value / 60) as bigint) % 60 > 0 then cast(cast(floor(value / 60) as bigint) % 60 as varchar) || 'mins, ' else '' end || cast(cast(floor(value) as bigint) % 60 as varchar) || 'sec' as d from events")
def date_duration(spark, sf):
    return events(spark, sf).select("event_id", S.duration_text((F.floor("value") * 1000).cast("bigint")).alias("d"))


@query("select c_custkey, md5(c_name) as m, sha1(c_name) as s1, sha256(c_name) as s2, base64(c_name::blob) as b from customer")
def hash_md5_sha(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha1("c_name").alias("s1"), F.sha2("c_name", 256).alias("s2"), F.base64(F.encode("c_name", "UTF-8")).alias("b"))


@query("select c_custkey, lower(hex(c_name)) as h, c_name as back from customer")
def hex_roundtrip(spark, sf):
    h = B.lower_hex(F.encode("c_name", "UTF-8"))
    return t(spark, sf, "customer").select("c_custkey", h.alias("h"), F.decode(F.unhex(h), "UTF-8").alias("back"))


@query("select c_custkey, c_name as v, cast(2 as int) as n from customer")
def map_parse(spark, sf):
    text = F.concat(F.lit("a=1;bad;b="), "c_name")
    m = S.parse_map(text, ";", "=")
    return t(spark, sf, "customer").select("c_custkey", F.element_at(m, "b").alias("v"), F.size(m).alias("n"))


@query("select o_orderstatus, cast(sum(o_orderkey % 3) as bigint) as a from orders group by 1")
def map_merge(spark, sf):
    o = t(spark, sf, "orders").select("o_orderstatus", (F.col("o_orderkey") % 3).alias("v"), (F.col("o_orderkey") % 2).alias("p"))
    half = lambda p: o.where(F.col("p") == p).groupBy("o_orderstatus").agg(F.sum("v").alias("v"))
    maps = half(0).toDF("s", "x").join(half(1).toDF("s", "y"), "s", "full")
    one = lambda c: F.create_map(F.col("s"), F.coalesce(c, F.lit(0)))
    return maps.select(F.col("s").alias("o_orderstatus"), F.element_at(S.merge_add(one("x"), one("y")), F.col("s")).alias("a"))


@query()
def murmur2(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", B.murmur2_of(F.col("c_name")).alias("h"))


@query()
def jenkins(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", B.jenkins_of(F.col("c_name")).alias("h"))


@query()
def sphash(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", *[B.poly_hash(F.col("c_name"), f).alias(f"h{f}") for f in (31, 17, 19)])


@query("select c_custkey, c_name from customer")
def gzip_roundtrip(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.decode(B.gunzip_of(B.gzip_of(F.encode("c_name", "UTF-8"))), "UTF-8").alias("c_name"))


# ---- stores ----------------------------------------------------------------------------------
ORDER_FIELDS = [FieldSpec("o_orderkey", "NUMBER"), FieldSpec("o_orderstatus"), FieldSpec("o_orderpriority")]


@query("select o_custkey || '_' || o_orderkey as row_key, o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority as cell from orders")
def merged_cell(spark, sf):
    return sinks.keyed_table(t(spark, sf, "orders"), "{o_custkey}_{O_ORDERKEY}", ORDER_FIELDS, "|")


@query("select reverse(cast(o_orderkey as varchar)) as row_key, cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_orderpriority from orders")
def rowkey_expr(spark, sf):
    return sinks.keyed_table(t(spark, sf, "orders"), "reverse(str(o_orderkey))", ORDER_FIELDS)


@query("select o_orderkey, abs(o_orderkey) % 7 as p from orders")
def kafka_partition_num(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", sinks.number_partition(sinks.partition_key(o, "1:o_orderkey"), 7).alias("p"))


@query()
def kafka_partition_str(spark, sf):
    c = t(spark, sf, "customer")
    return c.select("c_custkey", sinks.java_hash(F.col("c_name")).alias("h"), sinks.text_partition(sinks.partition_key(c, "2:c_name,c_custkey"), 7).alias("p"))


@query("select 'orders' as topic, cast(o_orderkey as varchar) as key, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_orderpriority\":\"' || o_orderpriority || '\"}' as value from orders")
def kafka_rows(spark, sf):
    return sinks.key_value(t(spark, sf, "orders"), "orders", "1:o_orderkey", ORDER_FIELDS)


@query(
    """select 1 as store, event_id from events where not coalesce(event_type = 'error', false) union all
select 2, event_id from (select event_id from events where not coalesce(value < 100, false)
  qualify row_number() over (partition by user_id, event_type, date_trunc('day', ts) order by ts, event_id) = 1)"""
)
def fanout_two_stores(spark, sf):
    spec = StreamSpec(1, "events", (FieldSpec("k", "NUMBER", "k"),), content="map", stores=(StoreSpec(1, filter_rule="expr: event_type == 'error'"), StoreSpec(2, filter_rule="expr: value < 100", distinct=DAY_RULE), StoreSpec(3, state=0)))
    out = build(events(spark, sf), spec, "props", order=["ts", "event_id"])
    one, two = (out[i].select(F.lit(i).alias("store"), "event_id") for i in (1, 2))
    return one.unionByName(two)


@query("select 'h,' || event_id || ',' || event_type || ',' || strftime(ts, '%Y-%m-%d') as value from events")
def text_rows(spark, sf):
    e = events(spark, sf).select(F.lit("h").alias("COLLECT_HOSTNAME"), F.col("event_id").alias("COLLECT_LOG_ID"), "event_type", ms().alias("at"))
    return sinks.delimited(e, [FieldSpec("event_type"), FieldSpec("at", "DATE")], ",", "yyyy-MM-dd")


# ---- streams ---------------------------------------------------------------------------------
def streamed(spark, sf) -> DataFrame:
    return twins.read_events(spark, f"{sf}/events.parquet")


@query("select user_id, event_type, date_trunc('day', ts)::date::varchar as day, count(*) as n from (select user_id, event_type, ts from events qualify row_number() over (partition by user_id, event_type, date_trunc('day', ts) order by ts, event_id) = 1) group by all")
def stream_dedup(spark, sf):
    found = twins.finish(twins.dedup_stream(streamed(spark, sf), DAY_RULE))
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return found.groupBy("user_id", "event_type", day).agg(F.count("*").alias("n"))


@query("select event_id from events where not coalesce(event_type = 'error' or value < 5, false)")
def stream_filter(spark, sf):
    return twins.finish(expr.drop_rows(streamed(spark, sf), INGEST.stores[0].filter_rule)).select("event_id")


@query("select event_type, count(*) as n, cast(sum(length(props)) as bigint) as bytes from events group by 1")
def stream_counters(spark, sf):
    return twins.finish(twins.counter_stream(streamed(spark, sf), ["event_type"], F.octet_length("props")), "complete")


# ---- control plane ---------------------------------------------------------------------------
@query(
    """with h as (select r_name as host, row_number() over (order by r_name) - 1 as i, count(*) over () as n from region),
m as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as nth from nation where n_nationkey % 4 > 0)
select host, n_nationkey::varchar as task from m join h on nth % n = i union all select host, n_nationkey::varchar from h, nation where n_nationkey % 4 = 0"""
)
def task_assign(spark, sf):
    """Streams named by nations on hosts named by regions: waiting ones on every host, the others in turn."""
    tasks = [(str(r.n_nationkey), 22 if r.n_nationkey % 4 == 0 else 14) for r in t(spark, sf, "nation").orderBy("n_nationkey").collect()]
    found = assign(tasks, [r.r_name for r in t(spark, sf, "region").collect()])
    return spark.createDataFrame([(h, x) for h, xs in found.items() for x in xs], "host string, task string")


from . import catalog_more, catalog_streams  # noqa: E402, F401  (they register more queries)
