"""More registered queries: scalar functions, hashes, stores, streams and control decisions, each with its SQL."""

from __future__ import annotations

import json
from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import scalar as S
from ..operators import expr, metrics, records, sinks, topology
from ..sources import files, registry
from ..spec import DistinctRule, FieldSpec, StoreSpec, StreamSpec, needs_restart, parse_config
from ..streaming import monitor, twins
from .builder import build, parsed
from .catalog import ORACLE_SQL, events, query, t


# ---- conversion ------------------------------------------------------------------------------
@query(
    """select c_custkey, coalesce(try_cast(c_name as double), 0.0) as bad, c_acctbal as good, coalesce(c_mktsegment, '') as txt,
case when c_mktsegment = 'FURNITURE' then -1 else 5 end as num, coalesce(nullif(regexp_extract(c_custkey || '.5kg', '^[0-9]+'), ''), '0')::bigint as lead_l,
(c_custkey || '.5')::double as lead_d, cast(null as double) as no_d, true as whole, false as part from customer"""
)
def convert_more(spark, sf):
    c = t(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    number = F.when(F.col("c_mktsegment") == "FURNITURE", "x").otherwise("5")
    return c.select(
        "c_custkey", S.to_double(F.col("c_name")).alias("bad"), S.to_double(F.col("c_acctbal")).alias("good"), S.to_text(F.col("c_mktsegment")).alias("txt"),
        S.to_int(number, -1).alias("num"), S.leading_long(F.concat(key, F.lit(".5kg"))).alias("lead_l"),
        S.leading_double(F.concat(key, F.lit(".5kg"))).alias("lead_d"), S.leading_double(F.lit("-3")).alias("no_d"),
        S.is_int(key).alias("whole"), S.is_int(F.concat(key, F.lit("."))).alias("part"),
    )


@query("select c_custkey, 'long' as k, 'double' as d, 'text' as x, c_acctbal > 0 as yes from customer")
def coerce_variables(spark, sf):
    c = t(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    balance = expr.truthy(*expr.compile_rule("c_acctbal > 0", c.schema))
    kinds = [S.coerce_kind(key).alias("k"), S.coerce_kind(F.concat(key, F.lit(".25"))).alias("d"), S.coerce_kind(F.col("c_name")).alias("x")]
    return c.select("c_custkey", *kinds, balance.alias("yes"))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'B' || n_nationkey else 'A' || n_nationkey end as hi, '9' as lo, n_name as one from nation")
def larger_smaller(spark, sf):
    n = t(spark, sf, "nation")
    even = F.col("n_nationkey") % 2 == 0
    name = F.concat(F.when(even, "B").otherwise("A"), F.col("n_nationkey").cast("string"))
    return n.select(
        "n_nationkey", S.larger(name, F.lit("9")).alias("hi"), S.smaller(F.lit("9"), F.lit("10")).alias("lo"), S.larger(F.col("n_name"), F.lit(None).cast("string")).alias("one")
    )


# ---- text ------------------------------------------------------------------------------------
@query("select c_custkey, c_name || '\\,' || c_mktsegment as a, c_custkey::varchar as b, 2 as n, c_name || '|' || c_mktsegment as tok from customer")
def split_with_escape(spark, sf):
    c = t(spark, sf, "customer")
    both = F.concat("c_name", F.lit(","), "c_mktsegment")
    parts = S.split_escaped(F.concat(S.escape(both), F.lit(","), F.col("c_custkey").cast("string"), F.lit(",,")))
    tokens = S.tokens(F.concat(F.lit(" , "), "c_name", F.lit(" ,, "), "c_mktsegment"))
    return c.select("c_custkey", parts[0].alias("a"), parts[1].alias("b"), F.size(parts).alias("n"), F.array_join(tokens, "|").alias("tok"))


@query(
    """select n_nationkey, n_name as name, n_regionkey::varchar as val, true as no_pair, n_name as inner_text, '[' || n_name as kept, n_name as mapped,
'f' as family, 'c' as col, n_name || '|x' as fields from nation"""
)
def decode_texts(spark, sf):
    n = t(spark, sf, "nation")
    key = F.col("n_regionkey").cast("string")
    pair = S.name_value(F.concat(F.lit(" "), "n_name", F.lit("="), key, F.lit(" ")), "=")
    items = F.array(F.concat(F.lit("[k:"), "n_name", F.lit("]")), F.lit("[broken]"))
    group = S.column_groups(F.concat(F.lit("[f:c:["), "n_name", F.lit(",x]]-[g:d:[y]]")))[0]
    return n.select(
        "n_nationkey", pair[0].alias("name"), pair[1].alias("val"), S.name_value(F.col("n_name"), "=").isNull().alias("no_pair"),
        S.strip_ends(F.concat(F.lit("["), "n_name", F.lit("]")), "[", "]").alias("inner_text"),
        S.strip_ends(F.concat(F.lit("["), "n_name"), "[", "]").alias("kept"), S.bracket_map(items)["k"].alias("mapped"),
        group["family"].alias("family"), group["col"].alias("col"), F.array_join(group["fields"], "|").alias("fields"),
    )


@query("select n_nationkey, 'a, ' || n_name as cols, regexp_full_match(n_name, '[A-M].*') as m, true as any_text, lower(n_name) = 'china' as same, upper(n_name) || '|X' as up from nation")
def match_texts(spark, sf):
    n = t(spark, sf, "nation")
    sql = F.concat(F.lit("SELECT a, "), "n_name", F.lit(" From t"))
    up = S.upper_all(F.array(F.lower("n_name"), F.lit("x")))
    return n.select(
        "n_nationkey", S.select_list(sql).alias("cols"), S.full_match(F.col("n_name"), "[A-M].*").alias("m"), S.full_match(F.col("n_name"), None).alias("any_text"),
        S.same_text(F.col("n_name"), F.lit("China")).alias("same"), F.array_join(up, "|").alias("up"),
    )


@query(
    """select p_partkey, case when b >= 1073741824 then format('{:.1f}g', b / 1073741824) when b >= 1048576 then format('{:.1f}m', b / 1048576)
 when b >= 1024 then format('{:.1f}k', b / 1024) else b::varchar end as human, case when b < 1024 then b || 'B' when b < 1048576 then rtrim(rtrim(format('{:.2f}', round_even(b / 1024, 2)), '0'), '.') || 'KB'
 else rtrim(rtrim(format('{:.2f}', round_even(b / 1048576, 2)), '0'), '.') || 'MB' end as bytes,
 format('{:.2f}%', floor((p_size / 64) * 100 * 100) / 100) as pct, format('{:.2f}', p_size / 4) as dec
from (select *, (p_size * p_size * p_size * 512)::bigint as b from part)"""
)
def sizes_shown(spark, sf):
    p = t(spark, sf, "part").withColumn("b", (F.col("p_size").cast("bigint") * F.col("p_size") * F.col("p_size") * 512))
    return p.select(
        "p_partkey", S.human_size(F.col("b")).alias("human"), S.byte_size(F.col("b")).alias("bytes"), S.percent(F.col("p_size") / 64).alias("pct"), S.decimal_text(F.col("p_size") / 4, "0.00").alias("dec")
    )


@query("select n_nationkey, lower(n_name) as simple, 'h' || n_nationkey as host, 80 + n_nationkey as port, n_name as recoded from nation")
def hosts_and_charsets(spark, sf):
    n = t(spark, sf, "nation")
    address = F.concat(F.lit("h"), F.col("n_nationkey").cast("string"), F.lit(":"), (F.col("n_nationkey") + 80).cast("string"))
    at = S.host_port(address)
    return n.select(
        "n_nationkey", S.simple_host(F.concat(F.lower("n_name"), F.lit(".example.com"))).alias("simple"), at["host"].alias("host"), at["port"].alias("port"), S.recode(F.col("n_name")).alias("recoded")
    )


@query("select r_regionkey, 'Part' || r_regionkey as short, 'org.sample.Part' || r_regionkey as long_name from region")
def class_names(spark, sf):
    source = F.concat(F.lit("package org.sample;\nclass Other {}\npublic final class Part"), F.col("r_regionkey").cast("string"), F.lit(" {}"))
    return t(spark, sf, "region").select("r_regionkey", S.class_name(source).alias("short"), S.full_class_name(source).alias("long_name"))


# ---- dates -----------------------------------------------------------------------------------
@query(
    """select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as shown, '' as none, o_orderdate::date::varchar as day, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month_start,
strftime(o_orderdate, '%Y') || '-01-01' as year_start from orders"""
)
def dates_loose(spark, sf):
    o = t(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    text = F.date_format("at", "yyyy-MM-dd HH:mm:ss")
    day = lambda c: F.date_format(S.loose_date(c), "yyyy-MM-dd")
    return o.select(
        "o_orderkey", S.date_text(F.col("at"), "yyyy/MM/dd").alias("shown"), S.date_text(F.lit(None).cast("timestamp"), "yyyy").alias("none"),
        day(text).alias("day"), day(F.substring(text, 1, 7)).alias("month_start"), day(F.substring(text, 1, 4)).alias("year_start"),
    )


@query(
    """select o_orderkey, strftime(o_orderdate, '%Y') as y, strftime(o_orderdate - interval 1 year, '%Y') as yp, strftime(o_orderdate + interval 1 year, '%Y') as yn,
strftime(o_orderdate, '%Y%m') as m, strftime(o_orderdate - interval 1 month, '%Y%m') as mp, strftime(o_orderdate + interval 1 month, '%Y%m') as mn,
strftime(o_orderdate, '%Y%m%d') as d, strftime(o_orderdate - interval 1 day, '%Y%m%d') as dp, strftime(o_orderdate + interval 1 day, '%Y%m%d') as dn,
strftime(o_orderdate, '%m') as mm, strftime(o_orderdate, '%d') as dd, strftime(o_orderdate, '%H') as hh, strftime(o_orderdate, '%M') as mi, strftime(o_orderdate, '%S') as ss,
strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as at from orders"""
)
def now_macros(spark, sf):
    o = t(spark, sf, "orders").withColumn("now", F.col("o_orderdate").cast("timestamp"))
    names = {"y": "N_YYYY", "m": "N_YYYYMM", "d": "N_YYYYMMDD"}
    out = [S.now_macro(v + s, F.col("now")).alias(k + s.lower()) for k, v in names.items() for s in ("", "P", "N")]
    out += [S.now_macro(n, F.col("now")).alias(k) for k, n in (("mm", "N_MM"), ("dd", "N_DD"), ("hh", "N_HH"), ("mi", "N_MI"), ("ss", "N_SS"), ("at", "N_TIME"))]
    return o.select("o_orderkey", *out)


# ---- hashes and bytes ------------------------------------------------------------------------
@query(
    """with m as (select c_custkey, md5(c_name) as m from customer), d as (select *, length(rtrim(m, '0')) as last, list_transform(range(1, 33), lambda i: strpos('0123456789abcdef', m[i]) - 1) as d from m),
n as (select *, array_to_string(list_transform(range(1, 33), lambda i: '0123456789abcdef'[1 + case when i < last then 15 - d[i] when i = last then 16 - d[i] else 0 end]), '') as neg from d)
select c_custkey, case when d[1] < 8 then coalesce(nullif(ltrim(m, '0'), ''), '0') else '-' || ltrim(neg, '0') end as signed from n"""
)
def md5_signed(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", B.md5_signed_of(F.col("c_name")).alias("signed"))


HASH_SQL = """case when h >= 2147483648 then h - 4294967296 else h end"""


@query(
    f"""with b as (select c_custkey, list_transform(range(1, length(c_name) + 1), lambda i: ord(c_name[i])::bigint) as u from customer),
h as (select c_custkey, list_reduce(list_prepend(0::bigint, u), lambda h, x: (h * 31 + x) % 4294967296) as h from b)
select c_custkey, ({HASH_SQL})::int as h, abs({HASH_SQL})::bigint % 7 as p from h"""
)
def java_hash_partition(spark, sf):
    c = t(spark, sf, "customer")
    return c.select("c_custkey", sinks.java_hash(F.col("c_name")).alias("h"), sinks.text_partition(sinks.partition_key(c, "1:c_name"), 7).alias("p"))


ORACLE_SQL["kafka_partition_str"] = f"""with b as (select c_custkey, list_transform(range(1, length(c_name) + 1), lambda i: ord(c_name[i])::bigint) as u,
 list_transform(range(1, length(c_custkey || c_name) + 1), lambda i: ord((c_custkey || c_name)[i])::bigint) as v from customer),
h as (select c_custkey, list_reduce(list_prepend(0::bigint, u), lambda h, x: (h * 31 + x) % 4294967296) as h, list_reduce(list_prepend(0::bigint, v), lambda h, x: (h * 31 + x) % 4294967296) as k from b)
select c_custkey, ({HASH_SQL})::int as h, abs({HASH_SQL.replace("h ", "k ").replace("then h", "then k").replace("else h", "else k")})::bigint % 7 as p from h"""


def _poly_sql(factor: int) -> str:
    return f"(select case when h >= 2147483648 then h - 4294967296 else h end from (select list_reduce(list_prepend(0::bigint, u), lambda h, x: (h * {factor} + x) % 4294967296) as h))::int as h{factor}"


ORACLE_SQL["sphash"] = f"""with b as (select c_custkey, list_transform(range(1, length(c_name) + 1), lambda i: ord(c_name[i])::bigint) as u from customer)
select c_custkey, {_poly_sql(31)}, {_poly_sql(17)}, {_poly_sql(19)} from b"""


@query("select n_nationkey, (ord(n_name[2]) * 31 + ord(n_name[3]))::bigint as h from nation")
def text_range_hash(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", B.text_hash(F.col("n_name"), 1, 3).alias("h"))


#: Published results of the hashes, by input, seed and 32-bit value.
LOOKUP3 = (("", 0, 0xDEADBEEF), ("", 0xDEADBEEF, 0xBD5B7DDE), ("Four score and seven years ago", 0, 0x17770551), ("Four score and seven years ago", 1, 0xCD628161))


@query("select * from (values " + ", ".join(f"('{s}', {seed}::bigint, {v}::bigint)" for s, seed, v in LOOKUP3) + ") as v(input, seed, h)")
def jenkins_published(spark, sf):
    rows = [(s, seed) for s, seed, _ in LOOKUP3]
    frame = spark.createDataFrame(rows, "input string, seed long")

    def run(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([B.jenkins(x.encode(), int(s)) & B.M32 for x, s in zip(texts, seeds)])

    return frame.withColumn("h", F.pandas_udf(run, "long")("input", "seed"))


#: SQL of a query that is registered with the others.
ORACLE_SQL["murmur2"] = """with w as (select c_custkey, c_name as s, length(c_name) as n from customer),
k as (select c_custkey, n, s, list_transform(range(0, n // 4), lambda i: ord(s[4*i+1])::hugeint + ord(s[4*i+2]) * 256::hugeint + ord(s[4*i+3]) * 65536::hugeint + ord(s[4*i+4]) * 16777216::hugeint) as ks from w),
m as (select c_custkey, n, s, list_transform(ks, lambda k: (xor((k * 1540483477) % 4294967296, ((k * 1540483477) % 4294967296) // 16777216) * 1540483477) % 4294967296) as ks from k),
h as (select c_custkey, n, s, list_reduce(list_prepend(xor(4294967295::hugeint, n::hugeint), ks), lambda h, k: xor((h * 1540483477) % 4294967296, k)) as h from m),
r as (select c_custkey, case n % 4 when 0 then h when 1 then (xor(h, ord(s[n])::hugeint) * 1540483477) % 4294967296
 when 2 then (xor(h, ord(s[n-1]) + ord(s[n]) * 256::hugeint) * 1540483477) % 4294967296
 else (xor(h, ord(s[n-2]) + ord(s[n-1]) * 256::hugeint + ord(s[n]) * 65536::hugeint) * 1540483477) % 4294967296 end as h from h),
x as (select c_custkey, (xor(h, h // 8192) * 1540483477) % 4294967296 as h from r),
y as (select c_custkey, xor(h, h // 32768) as h from x)
select c_custkey, (case when h >= 2147483648 then h - 4294967296 else h end)::int as h from y"""


# ---- bytes -------------------------------------------------------------------------------------
@query(
    """select n_nationkey, n_name[1:2] as head, n_name[-2:] as tail, lower(hex(encode(n_name))) || '0000' as padded,
case when n_name < 'JAPAN' then -1 when n_name > 'JAPAN' then 1 else 0 end as cmp, starts_with(n_name, 'I') as pre, lower(lpad(to_hex(n_nationkey), 2, '0')) as vint, (n_nationkey * 1000)::bigint as back from nation"""
)
def byte_functions(spark, sf):
    n = t(spark, sf, "nation")
    raw = F.encode("n_name", "UTF-8")
    asc = lambda c: F.decode(c, "UTF-8")
    return n.select(
        "n_nationkey", asc(B.head(raw, 2)).alias("head"), asc(B.tail(raw, 2)).alias("tail"), B.lower_hex(B.pad_bytes(raw, 2)).alias("padded"),
        B.compare_bytes(raw, F.encode(F.lit("JAPAN"), "UTF-8")).alias("cmp"), B.starts_with_bytes(raw, F.encode(F.lit("I"), "UTF-8")).alias("pre"),
        B.lower_hex(B.vint_of(F.col("n_nationkey"))).alias("vint"), B.read_vint_of(B.vint_of(F.col("n_nationkey") * 1000)).alias("back"),
    )


@query("select count(*) as n, 10 as size, true as apart from customer")
def unique_ids(spark, sf):
    ids = t(spark, sf, "customer").select(B.unique_id().alias("i"))
    return ids.agg(F.count("i").alias("n"), F.max(F.length("i")).alias("size"), (F.count_distinct("i") > F.count("i") * 0.99).alias("apart"))


@query(
    """select n, (select min(k) from range(n::bigint, n::bigint + 200) as t(k) where k >= 2
and not exists (select 1 from range(2, 2000) as d(x) where x * x <= k and k % x = 0)) as prime from (select distinct p_size * 977 as n from part)"""
)
def prime_buckets(spark, sf):
    prime = F.pandas_udf(lambda sizes: sizes.map(B.prime_at_least), "long")
    return t(spark, sf, "part").select((F.col("p_size") * 977).alias("n")).distinct().withColumn("prime", prime("n"))


# ---- collections and configuration -----------------------------------------------------------
@query("select o_custkey, min(o_orderkey) as a, max(o_orderkey) as z, count(*) as n, false as none from orders group by 1")
def array_ends(spark, sf):
    each = t(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    return each.select("o_custkey", S.first_of(F.col("k")).alias("a"), S.last_of(F.col("k")).alias("z"), F.size("k").cast("bigint").alias("n"), (F.size("k") == 0).alias("none"))


@query("select event_id, case when value > 100 then 2 else 1 end as n, event_type as kind from events")
def argument_map(spark, sf):
    made = S.arg_map(F.lit("kind"), F.col("event_type"), F.lit("big"), F.when(F.col("value") > 100, F.col("value").cast("string")))
    return events(spark, sf).select("event_id", F.size(made).alias("n"), made["kind"].alias("kind"))


@query("select event_id, event_type as \"type\", try_cast(json_extract_string(props, '$.k') as bigint) as k, 3 as pos from events")
def field_positions(spark, sf):
    """Fields by the positions that a definition gives them."""
    raw = {"msg_id": 7, "name": "e", "content": "map", "fields": [{"name": "k", "data_type": "NUMBER", "order": 2}, {"name": "type", "order": 1}]}
    spec = StreamSpec.from_json(json.dumps(raw))
    value = F.to_json(F.struct(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("k")))
    rows = build(events(spark, sf).select("event_id", value.alias("value")), StreamSpec(7, "e", spec.fields, content="map", stores=(StoreSpec(1),)))[1]
    return rows.select("event_id", "type", "k", F.lit(spec.positions["k"]).alias("pos"))


@query("select n_nationkey::varchar as k, n_name as v from nation union all select 'line', chr(10)")
def store_config(spark, sf):
    """A store's configuration with a line for each nation, a remark and a broken line."""
    lines = t(spark, sf, "nation").select(F.concat_ws(" = ", "n_nationkey", "n_name").alias("v")).collect()
    found = parse_config("\n".join(["# remark", *(r.v for r in lines), "bad", "line=\\n"]))
    return spark.createDataFrame(sorted(found.items()), "k string, v string")


@query("select r_name as stream, r_regionkey in (1, 2, 3) as restart from region")
def reload_decisions(spark, sf):
    """One changed definition for each region: its filter, a field, its duplicates, its url, nothing."""
    changes = [
        {"stores": (StoreSpec(1, filter_rule="expr: x == 2"),)}, {"fields": (FieldSpec("x", "NUMBER"),)},
        {"stores": (StoreSpec(1, distinct=DistinctRule(("x",), "d", 1)),)}, {"url": "u"}, {},
    ]
    out = []
    for r in t(spark, sf, "region").collect():
        base = StreamSpec(r.r_regionkey, r.r_name, (FieldSpec("x"),), stores=(StoreSpec(1, filter_rule="expr: x == 1"),))
        out.append((r.r_name, needs_restart(base, replace(base, **changes[r.r_regionkey]))))
    return spark.createDataFrame(out, "stream string, restart boolean")


# ---- files -----------------------------------------------------------------------------------
@query(
    """select o_orderkey, o_orderkey % 4 = 0 as hit from orders"""
)
def path_macros(spark, sf):
    """Paths with a day in them; others lack a digit, have another name or lie in a folder below."""
    rule = f"^{files.path_regex('/l/a_${yyyy}${mm}${dd}.l*')}$"
    o = t(spark, sf, "orders")
    day, kind = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey") % 4
    name = F.when(kind == 0, F.concat(F.lit("/l/a_"), day)).when(kind == 1, F.concat(F.lit("/l/a_"), F.substring(day, 1, 7)))
    name = name.when(kind == 2, F.concat(F.lit("/l/b_"), day)).otherwise(F.concat(F.lit("/l/x/a_"), day))
    return o.select("o_orderkey", F.concat(name, F.lit(".log")).rlike(rule).alias("hit"))


@query(
    """select '/' || n_regionkey || '/' || n_name as path, case nth when 3 then 2 else 0 end as a, n_nationkey + 10 as z
from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as nth from nation) where nth >= 3"""
)
def pointer_plan(spark, sf):
    """What is new in a folder for each region: the third file has grown beyond its second byte, and newer ones."""
    rows = t(spark, sf, "nation").orderBy("n_nationkey").collect()
    at, place = {}, {}
    for r in rows:
        place[r.n_regionkey] = place.get(r.n_regionkey, 0) + 1
        if place[r.n_regionkey] == 3:
            at[f"/{r.n_regionkey}"] = [r.n_name, r.n_nationkey, 2]
    plan = files.Pointer(json.dumps(at)).plan([(f"/{r.n_regionkey}/{r.n_name}", r.n_nationkey, r.n_nationkey + 10) for r in rows])
    return spark.createDataFrame(plan, "path string, a int, z int")


@query("select 'cache.' || o_orderkey as name, o_orderkey as seq from orders where o_orderstatus <> 'P'")
def spill_order(spark, sf):
    name = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("cache."), "o_orderkey")).otherwise("readme")
    return files.numbered_files(t(spark, sf, "orders").select(name.alias("name")), "name")


@query("select strftime(ts, '%Y%m%d') as day, count(*) as n, true as named from events group by 1")
def named_files(spark, sf):
    """Rows written as named files of each day and read back by name."""
    path = twins.shared_folder(spark)
    rows = events(spark, sf).select(F.col("event_id").cast("string").alias("value"), F.date_format("ts", "yyyyMMdd").alias("day"))
    sinks.write_named(rows, path, "ev", "h1", day="day", codec="gzip", max_bytes=4096)
    found = spark.read.text(path).select("value", F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("name"))
    day = F.regexp_extract("name", r"^ev_h1_(\d{8})\.\d+\.dat\.gz$", 1)
    return found.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.min(day != "").alias("named"))


@query("select 3::bigint as files, 30::bigint as bytes, true as moved, true as gone")
def file_helpers(spark, sf):
    base = twins.shared_folder(spark)
    files.make_dir(spark, base)
    spark.range(3).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("value")).repartitionByRange(3, "value").write.text(f"{base}/a")
    moved = files.move(spark, f"{base}/a", f"{base}/b")
    parts = [s for n, s in files.list_dir(spark, f"{base}/b") if n.startswith("part-")]
    gone = files.delete(spark, base) and not files.list_dir(spark, base)
    return spark.createDataFrame([(len(parts), sum(parts), moved, gone)], "files long, bytes long, moved boolean, gone boolean")


@query("select 1 as old_part, min(o_orderkey) as least from orders where o_orderkey > (select max(o_orderkey) - 5 from orders)")
def newest_kept(spark, sf):
    """The newest five of a ring stay, the oldest of them is the next to go."""
    o = t(spark, sf, "orders").select(F.lit(1).alias("old_part"), "o_orderkey")
    kept = metrics.ring(o, ["old_part"], [F.desc("o_orderkey")], 5)
    return kept.groupBy("old_part").agg(F.min("o_orderkey").alias("least"))


# ---- stores ----------------------------------------------------------------------------------
ORDER_FIELDS = [FieldSpec("o_orderkey", "NUMBER"), FieldSpec("o_totalprice", "NUMBER(2)"), FieldSpec("o_orderpriority")]


@query("select o_orderkey, o_totalprice, o_orderpriority from orders")
def spill_replay(spark, sf):
    return sinks.unspilled(sinks.spilled(t(spark, sf, "orders"), [f.name for f in ORDER_FIELDS]), ORDER_FIELDS)


@query("select 'h' as host, event_id, lower(hex(encode(event_type))) as raw from events")
def stored_tuples(spark, sf):
    """Tuples in JSON form and back; bytes are hex."""
    rows = events(spark, sf).select("event_id", F.encode("event_type", "UTF-8").alias("raw"))
    e = rows.select(F.lit("h").alias("host"), "event_id", sinks.shown("raw", "BLOB").alias("raw"))
    stored = e.select(F.to_json(F.array("host", F.col("event_id").cast("string"), "raw")).alias("value"))
    spec = StreamSpec(1, "x", (FieldSpec("host"), FieldSpec("event_id", "NUMBER"), FieldSpec("raw")), content="array")
    return parsed(stored, spec)


@query("select o_orderkey, abs(o_orderkey) % 5 as p, o_orderkey || o_orderstatus as k2 from orders")
def partition_keys(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", sinks.number_partition(sinks.partition_key(o, "1:o_orderkey"), 5).alias("p"), sinks.partition_key(o, "2:o_orderstatus,o_orderkey").alias("k2"))


@query("select 1 as msg_id, 2 as store_id, event_id as log_sn, 'sent' as type, '[' || event_type || ']' as content, 'h' as host from events")
def detail_rows(spark, sf):
    spec = StreamSpec(1, "e", (FieldSpec("event_type"),))
    e = events(spark, sf).select(F.lit("h").alias("COLLECT_HOSTNAME"), F.col("event_id").alias("COLLECT_LOG_ID"), "event_type", "ts")
    return sinks.detail_log(e, spec, StoreSpec(2), "sent", "ts").drop("time")


@query("select event_id, upper(event_type) as event_type from events where event_type <> 'error'")
def hooked_store(spark, sf):
    """A store's row hook works on what its filter leaves."""
    sinks.HOOKS["upper_types"] = lambda df: df.withColumn("event_type", F.upper("event_type"))
    return sinks.branch(events(spark, sf), StoreSpec(1, filter_rule="expr: event_type == 'error'", plugin="upper_types"), ["event_id"]).select("event_id", "event_type")


# ---- topologies ------------------------------------------------------------------------------
@query("select n_name, length(n_name) as size, n_name || '!' as loud from nation")
def class_output(spark, sf):
    topology.CLASSES["Length"] = lambda df: F.length("n_name")
    expr.register_function("loud", lambda s: F.concat(s[0], F.lit("!")))
    node = topology.Node(("n",), outputs=(("n_name", "n_name"), ("size", "class:Length"), ("loud", "loud(n_name)")))
    return topology.run_node(node, {"n": t(spark, sf, "nation")})


@query("select 'errors' as subscriber, event_id from events where event_type = 'error' union all select 'large', event_id from events where value > 100")
def push_rules(spark, sf):
    sent = topology.pushes(events(spark, sf), {"errors": "event_type == 'error'", "large": "value > 100"})
    return topology.merged(*[df.select(F.lit(name).alias("subscriber"), "event_id") for name, df in sent.items()])


@query("select n_name, r_name || '2' as r_name from nation join region on n_regionkey = r_regionkey")
def dimension_refresh(spark, sf):
    """The second load of a dimension counts once an event has asked for it."""
    loads = iter((1, 2))
    region = t(spark, sf, "region")
    dim = topology.Dimension(lambda: region.withColumn("r_name", F.concat("r_name", F.lit(str(next(loads))))))
    dim.table()
    dim.refresh()
    rule = topology.Lookup("region", (("n_regionkey", "r_regionkey"),), ("r_name",))
    return topology.look_up(t(spark, sf, "nation"), dim.table(), rule).select("n_name", "r_name")


# ---- metrics ---------------------------------------------------------------------------------
@query(
    """select event_type, ((rn - 1) // 100)::int as part, epoch_us(min(ts)) // 1000 as start_ms, epoch_us(max(ts)) // 1000 as end_ms, cast(sum(length(props)) as bigint) as bytes, count(*) as n
from (select *, row_number() over (partition by event_type order by ts, event_id) as rn from events) group by 1, 2"""
)
def collect_log_by_count(spark, sf):
    return metrics.counted_log(events(spark, sf), "event_type", ["ts", "event_id"], "ts", F.octet_length("props"), 100)


@query("""select l_returnflag, '{"n":' || count(*) || ',"q":' || cast(sum(l_quantity) as bigint) || '}' as snapshot from lineitem group by 1""")
def published_snapshot(spark, sf):
    each = t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))
    return metrics.snapshot_json(each, "l_returnflag", ["n", "q"])


@query(
    """select '<html><head><title>regions</title></head><body><table><tr><th>r_regionkey</th><th>r_name</th></tr>' ||
string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', '' order by r_regionkey) || '</table></body></html>' as page from region"""
)
def dashboard(spark, sf):
    page = metrics.html_page(t(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "regions")
    return spark.createDataFrame([("".join(page),)], "page string")


# ---- sources ---------------------------------------------------------------------------------
@query("select n_nationkey, n_name as reply from nation")
def soap_replies(spark, sf):
    """The node of a reply to an envelope made from a template."""
    n = t(spark, sf, "nation")
    body = registry.soap_envelope(F.lit("<Get><name>{name}</name></Get>"), {"name": F.col("n_name")})
    return n.select("n_nationkey", records.xpath_text(body, "//name").alias("reply"))


ORACLE_SQL["xpath_node"] = "select r_regionkey, r_name as name, cast(null as varchar) as broken from region"


@query("select unnest(string_split(string_agg(n_name, ''), '')) as value from nation")
def callable_messages(spark, sf):
    """A callable's messages, here the letters of its argument."""
    names = t(spark, sf, "nation").agg(F.array_join(F.collect_list("n_name"), "").alias("v")).first().v
    return registry.callable_source(spark, "builtins:sorted", names)


@query("select event_type as topic, count(*) as n from events group by 1")
def landed_messages(spark, sf):
    """Pushed messages that a receiver has landed, by topic."""
    path = twins.shared_folder(spark)
    rows = events(spark, sf).select(F.col("event_type").alias("topic"), F.col("props").alias("content"), F.lit(False).alias("batch"))
    rows.write.json(path)
    return registry.landing_source(spark, path).groupBy("topic").agg(F.count("content").alias("n"))


# ---- streams ---------------------------------------------------------------------------------
def _stream(spark, sf):
    return twins.read_events(spark, f"{sf}/events.parquet")


@query("select count(*) as n from events")
def stream_progress(spark, sf):
    """Rows of a stream by its progress reports."""
    path = twins.shared_folder(spark)
    listener = monitor.Progress(f"{path}/progress")
    spark.streams.addListener(listener)
    writer = _stream(spark, sf).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    done = twins.run_to_end(writer)
    listener.wait_for(str(done.id), done.lastProgress["batchId"])
    spark.streams.removeListener(listener)
    return listener.table(spark).where(F.col("id") == str(done.id)).agg(F.sum("n").alias("n"))


@query("select event_type, count(*) as n from events group by 1")
def stream_restart(spark, sf):
    """A stream that runs twice with one checkpoint writes each row once."""
    path = twins.shared_folder(spark)
    for _ in range(2):
        writer = _stream(spark, sf).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
        twins.run_to_end(writer)
    return spark.read.parquet(f"{path}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select 2 as store, event_id from events where event_type <> 'error' union all select 1, event_id from events")
def stream_stores(spark, sf):
    """Each store's own query writes its batches, named by batch so that a repeated one replaces itself."""
    path = twins.shared_folder(spark)
    spec = StreamSpec(1, f"s{path[-8:]}", (), stores=(StoreSpec(1), StoreSpec(2, filter_rule="expr: event_type == 'error'"), StoreSpec(3, state=0)))

    def write(store, rows, number):
        rows.select(F.lit(store.store_id).alias("store"), "event_id").write.mode("overwrite").parquet(f"{path}/rows/{store.store_id}-{number}")

    for q in twins.start_stores(_stream(spark, sf), spec, write, f"{path}/state"):
        q.awaitTermination()
    return spark.read.parquet(f"{path}/rows/*")


@query("select user_id, event_type, ts::date::varchar as day from events group by all")
def stream_retention(spark, sf):
    rule = DistinctRule.parse({"fields": "user_id,event_type", "timeRange": "d:1", "timeField": "ts", "checkRange": 2})
    found = twins.finish(twins.dedup_stream(_stream(spark, sf), rule))
    return found.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("select r_name as name, 'start' as first, case r_regionkey % 2 when 0 then 'keep' else 'restart' end as second, 'stop' as third from region")
def hot_reload(spark, sf):
    """Streams named by regions: started, of every second one a field changed, all taken away."""
    path = twins.shared_folder(spark)
    regions = t(spark, sf, "region").collect()
    one = {r.r_name: StreamSpec(r.r_regionkey, r.r_name, (FieldSpec("x"),), stores=(StoreSpec(1),)) for r in regions}
    two = {r.r_name: replace(one[r.r_name], fields=(FieldSpec("x", "NUMBER" if r.r_regionkey % 2 else "VARCHAR"),)) for r in regions}

    def start(spec: StreamSpec) -> list:
        def write(store, rows, number):
            rows.write.mode("overwrite").parquet(f"{path}/rows/{spec.msg_id}-{number}")

        return twins.start_stores(_stream(spark, sf).select("event_id"), replace(spec, name=f"{spec.name}{path[-6:]}"), write, f"{path}/state/{spec.msg_id}", "0 seconds")

    worker = twins.Running(start)
    steps = [worker.apply(s) for s in (one, two, {})]
    return spark.createDataFrame([(n, *[s[n] for s in steps]) for n in one], "name string, first string, second string, third string")


@query(
    """select * from (values ('a', '0'), ('b', '0'), ('c', '0'), ('a', '1'), ('a', '2'), ('b', '3'), ('c', '4')) as v(host, task)"""
)
def assigned_tasks(spark, sf):
    """Waiting streams on every host, one that runs stays, others go where the fewest are."""
    from .control import assign

    found = assign([("0", 22), ("1", 14), ("2", 14), ("3", 14), ("4", 14)], ["a", "b", "c"], {"a": ["1", "2"], "gone": ["3"]})
    return spark.createDataFrame([(h, x) for h, xs in found.items() for x in xs], "host string, task string")
