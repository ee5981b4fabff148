"""Registered queries of sources, stores and streams that keep state between batches, each with its SQL."""

from __future__ import annotations

import json
import threading
from collections import Counter
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, records, topology
from ..operators.send import send
from ..operators.stored import SeenSet, StoredSums
from ..sources import archives, polls, receiver, registry, shared
from ..spec import DistinctRule, FieldSpec, StreamSpec
from ..streaming import ledger, monitor, twins
from .catalog import events, query, t


def as_batches(df: DataFrame, folder: str, number: str, count: int, start: int = 0) -> None:
    """Writes the rows of each number below ``count`` (not below ``start``) as one file, one after the other: a batch each for a stream that takes one at a time."""
    for k in range(start, count):
        df.where(F.col(number) == k).coalesce(1).write.parquet(f"{folder}/{k}")


def one_by_one(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def in_spite_of(start: Callable[[], object], failures: int) -> None:
    """Runs a stream to its end again after each of so many failures; another one is an error."""
    for k in range(failures + 1):
        try:
            twins.run_to_end(start())
            return
        except StreamingQueryException:
            if k == failures:
                raise


# ---- sources ---------------------------------------------------------------------------------
@query("select event_id, event_type from events")
def tail_stream(spark, sf):
    """Files that have grown and new ones between two runs of one stream: every record once."""
    registry.register(spark)
    path = twins.shared_folder(spark)
    rows = events(spark, sf).select("event_id", "event_type", (F.col("user_id") % 5).alias("file"))

    def whole(own):
        import pandas as pd

        own = own.sort_values(["late", "event_id"])
        lines = "".join(f"{i},{x}\n" for i, x in zip(own["event_id"], own["event_type"]))
        shared.put(f"{path}/in/{own['file'].iloc[0]}.log", lines.encode())
        return pd.DataFrame({"n": [len(own)]})

    # a file that is written again with more lines behind the same ones has grown; the fifth is new
    for part in (rows.where("event_id % 3 <> 2 AND file < 4"), rows):
        late = part.withColumn("late", (F.col("event_id") % 3 == 2).cast("int"))
        late.groupBy("file").applyInPandas(whole, "n long").agg(F.sum("n")).collect()
        tail = spark.readStream.format("tail_text").option("path", f"{path}/in/*.log").option("state", f"{path}/plan.json").load()
        writer = tail.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
        twins.run_to_end(writer)
    parts = F.split("value", ",")
    return spark.read.parquet(f"{path}/rows").select(parts[0].cast("long").alias("event_id"), parts[1].alias("event_type"))


def served(replies: dict[str, str], key: str = "content") -> tuple[ThreadingHTTPServer, Counter]:
    """A server that replies to each content, and how often each was asked for."""
    asked: Counter = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            content = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())[key][0]
            asked[content] += 1
            self.send_response(200)
            self.end_headers()
            self.wfile.write(replies[content].encode())

        def log_message(self, *args) -> None:
            return

    server = ThreadingHTTPServer(("", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, asked


@query("select c_custkey, c_mktsegment as segment, 1 as asked from customer")
def poll_stream(spark, sf):
    """One request for each segment; the first try of the batch fails after the replies are there, the second asks nobody again."""
    registry.register(spark)
    path = twins.shared_folder(spark)
    each = t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.array_join(F.sort_array(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("keys"))
    server, asked = served({r.c_mktsegment: r["keys"] for r in each.collect()})
    tries = []

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        tries.append(number)
        if len(tries) == 1:
            raise ConnectionError("the store is away")

    def start():
        host = spark.conf.get("spark.driver.host")
        reader = spark.readStream.format("poll_http").option("url", f"http://{host}:{server.server_address[1]}/").option("keep", f"{path}/keep")
        reader = reader.option("sendContent", json.dumps(sorted(r.c_mktsegment for r in each.select("c_mktsegment").collect())))
        return reader.load().writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state")

    in_spite_of(start, 1)
    server.shutdown()
    counts = spark.createDataFrame(list(asked.items()), "request string, asked int")
    rows = spark.read.parquet(f"{path}/rows/*").select("request", F.explode(F.split("value", ",")).alias("key"))
    return rows.join(F.broadcast(counts), "request").select(F.col("key").cast("long").alias("c_custkey"), F.col("request").alias("segment"), "asked")


@query("select n_name as name, n_regionkey::bigint as region, 2 as polls from nation")
def poll_sql_stream(spark, sf):
    """A definition's query at each of two polls; the first poll fails once after it has been fetched."""
    registry.register(spark)
    path = twins.shared_folder(spark)
    spec = StreamSpec(1, "nations", (FieldSpec("name", src="n_name"), FieldSpec("region", "NUMBER", "n_regionkey")), trigger=14, scheme="select * from nation_view")
    tries = []

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("poll", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/{number}")
        tries.append(number)
        if len(tries) == 1:
            raise ConnectionError("the store is away")

    def fetch() -> DataFrame:
        return registry.sql_source(spark, spec, {"nation_view": t(spark, sf, "nation")})

    for failures in (1, 0):
        in_spite_of(lambda: polls.poll_sql(spark, spec, write, path, fetch=fetch), failures)
    return spark.read.parquet(f"{path}/rows/*").groupBy("name", "region").agg(F.count_distinct("poll").cast("int").alias("polls"))


@query(
    """select 'p' || p_size || '.tar.gz' as archive, p_brand as member, row_number() over (partition by p_size, p_brand order by v) as line,
p_partkey as partkey from (select *, p_name || '|' || p_partkey as v from part)"""
)
def archive_lines(spark, sf):
    """Parts packed as archives by size with a member for each brand, and read back as lines."""
    registry.register(spark)
    path = twins.shared_folder(spark)
    parts = t(spark, sf, "part")
    named = parts.select(F.concat(F.lit("p"), "p_size").alias("archive"), F.col("p_brand").alias("member"), F.concat_ws("|", "p_name", "p_partkey").alias("value"))
    archives.pack(named, path, "archive", "member", "value").agg(F.sum("n")).collect()
    lines = spark.read.format("tar_lines").option("path", path).load()
    key = F.substring_index("value", "|", -1).cast("long").alias("partkey")
    return lines.select(F.substring_index("archive", "/", -1).alias("archive"), "member", "line", key)


@query(
    """select 'nation' as topic, n_nationkey::bigint as key, n_name as name, cast(null as double) as price from nation
union all select 'part', p_partkey, p_name, p_retailprice from part"""
)
def mixed_frames(spark, sf):
    """Binary messages of two schemas in one stream of frames, decoded by topic in one pass."""
    shapes = {"nation": [("key", "NUMBER"), ("name", "VARCHAR")], "part": [("key", "NUMBER"), ("price", "NUMBER(2)"), ("name", "VARCHAR")]}
    nation = t(spark, sf, "nation").select(F.lit("nation").alias("topic"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    part = t(spark, sf, "part").select(F.lit("part").alias("topic"), F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"))
    sent = [records.encode_rows(df, shapes[name]).select("topic", "value") for name, df in (("nation", nation), ("part", part))]
    both = records.decode_topics(sent[0].unionByName(sent[1]), shapes)
    return both.select(
        "topic", F.coalesce("nation.key", "part.key").alias("key"), F.coalesce("nation.name", "part.name").alias("name"), F.col("part.price").alias("price")
    )


# ---- stores ----------------------------------------------------------------------------------
@query(
    """select event_type as topic, user_id::varchar as key, props as value, case when event_type = 'signup' then 'unknown topic' end as reason, count(*) as n
from events group by all"""
)
def sent_rows(spark, sf):
    """Rows sent in three batches; the other side fails once in a task and once at a commit, and refuses a topic."""
    registry.register(spark)
    path = twins.shared_folder(spark)
    rows = events(spark, sf).select(F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), (F.col("event_id") % 3).alias("b"))
    as_batches(rows, f"{path}/in", "b", 3)
    local = shared.opened(path)[1]
    store = receiver.Staged(f"{local}/store", {"click", "error", "purchase", "view"})
    stage, commit, calls = store.stage, store.commit, Counter()

    def failing(name: str, call: Callable, at: int) -> Callable:
        def run(*args, **kwargs):
            calls[name] += 1
            if calls[name] == at:
                raise OSError("away")
            return call(*args, **kwargs)

        return run

    store.stage, store.commit = failing("stage", stage, 2), failing("commit", commit, 2)
    server = receiver.store_server(store)
    port = receiver.serving(server)
    options = {"url": f"http://{spark.conf.get('spark.driver.host')}:{port}", "source": "events", "retries": 0, "rows": 500, "rejected": f"{local}/rejected"}
    in_spite_of(lambda: send(one_by_one(spark, f"{path}/in", rows), f"{path}/state", **options), 2)
    server.shutdown()
    schema = "topic string, key string, value string, reason string"
    sent = spark.read.schema(schema).json(store.shown())
    refused = spark.read.schema(schema).json(f"{path}/rejected")
    return sent.unionByName(refused).groupBy("topic", "key", "value", "reason").agg(F.count("*").alias("n"))


@query("select event_type, user_id, cast(count(*) as bigint) as n, cast(sum(length(props)) as bigint) as bytes from events group by 1, 2")
def stored_upsert(spark, sf):
    """Three batches into a stored table; the second runs twice, once stopped half way and once whole again."""
    path = twins.shared_folder(spark)
    store = StoredSums(spark, path, ["event_type", "user_id"], ["n", "bytes"], buckets=4)
    rows = events(spark, sf).select("event_type", "user_id", F.lit(1).alias("n"), F.length("props").cast("long").alias("bytes"), (F.col("event_id") % 3).alias("b"))
    for k in (0, 1, 1, 2, 2):
        store.apply(rows.where(F.col("b") == k), k)
    return store.read()


@query(
    """with o as (select o_custkey % 50 as k, o_orderkey % 2 as b from orders), a as (select distinct k from o where b = 0 and k % 3 > 0)
select k, count(*) as n from o where b = 1 and k not in (select k from a) group by 1"""
)
def seen_second_run(spark, sf):
    """Keys that a first run brought drop the rows of a second one."""
    path = twins.shared_folder(spark)
    seen = SeenSet(spark, f"seen_{path[-12:]}", path, buckets=4)
    rows = t(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("k"), (F.col("o_orderkey") % 2).alias("b"))
    key, gen = [F.col("k")], F.lit(0)
    first = rows.where("b = 0 AND k % 3 > 0")
    for _ in range(2):  # a repeated run adds nothing
        seen.add(first, key, gen, 0)
    return seen.marked(rows.where("b = 1"), key, gen, 1).where("NOT seen").groupBy("k").agg(F.count("*").alias("n"))


# ---- streams ---------------------------------------------------------------------------------
@query("select event_id, event_type, row_number() over (partition by event_type order by event_id % 3, ts, event_id) as seq from events")
def running_numbers(spark, sf):
    """Numbers of each stream over three batches, a failure in the second and a restart before the third."""
    path = twins.shared_folder(spark)
    rows = events(spark, sf).select("event_id", "event_type", "ts", (F.col("event_id") % 3).alias("b"))
    tries = []

    def write(out: DataFrame, number: int) -> None:
        out.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        tries.append(number)
        if len(tries) == 2:
            raise ConnectionError("the store is away")

    def start():
        stream = one_by_one(spark, f"{path}/in", rows)
        return ledger.number_stream(stream, ["event_type"], [F.col("ts"), F.col("event_id")], path, write)

    for first, count, failures in ((0, 2, 1), (2, 3, 0)):
        as_batches(rows, f"{path}/in", "b", count, first)
        in_spite_of(start, failures)
    return spark.read.parquet(f"{path}/rows/*").select("event_id", "event_type", "seq")


@query(
    """with r as (select event_id, event_type, ts, user_id % 3 as b, date_trunc('day', ts) as d from events),
m as (select b, max(d) as top from r group by b),
l as (select r.*, coalesce(d < (select max(top) from m where m.b < r.b) - interval 20 days, false) as late from r),
f as (select *, row_number() over (partition by event_type, d order by b, ts, event_id) as nth from l where not late)
select event_id, case nth when 1 then 'kept' else 'duplicate' end as fate from f union all select event_id, 'late' from l where late"""
)
def fates(spark, sf):
    """Kept, duplicate and late rows over three batches, the second of which fails once after it is written."""
    path = twins.shared_folder(spark)
    rule = DistinctRule.parse({"fields": "event_type", "timeRange": "d:1", "timeField": "ts", "checkRange": 20})
    rows = events(spark, sf).select("event_id", "event_type", "ts", (F.col("user_id") % 3).alias("b"))
    as_batches(rows, f"{path}/in", "b", 3)
    seen = SeenSet(spark, f"seen_{path[-12:]}", f"{path}/seen", buckets=4)
    tries = []

    def write(out: DataFrame, number: int) -> None:
        out.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        tries.append(number)
        if len(tries) == 2:
            raise ConnectionError("the store is away")

    in_spite_of(lambda: ledger.told_apart_stream(one_by_one(spark, f"{path}/in", rows), rule, ["ts", "event_id"], seen, path, write), 1)
    return spark.read.parquet(f"{path}/rows/*").select("event_id", "fate")


@query("select event_id, event_type || case event_type when 'signup' then '-1' else '-0' end as label from events")
def dimension_stream(spark, sf):
    """Three batches and a dimension that changes after the first: the second still sees the old one, the third holds the event that loads it anew."""
    path = twins.shared_folder(spark)
    signup = F.col("event_type") == "signup"
    rows = events(spark, sf).select("event_id", "event_type", F.when(signup, 2).otherwise(F.col("event_id") % 2).alias("b"))
    as_batches(rows, f"{path}/in", "b", 3)
    versions = []

    def publish() -> None:
        label = F.concat_ws("-", "event_type", F.lit(len(versions)))
        rows.select("event_type", label.alias("label")).distinct().write.parquet(f"{path}/dim/{len(versions)}")
        versions.append(f"{path}/dim/{len(versions)}")

    def write(out: DataFrame, number: int) -> None:
        out.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        if number == 0:
            publish()

    publish()
    dim = topology.Dimension(lambda: spark.read.parquet(versions[-1]))
    rule = topology.Lookup("types", (("event_type", "event_type"),), ("label",))
    writer = twins.look_up_stream(one_by_one(spark, f"{path}/in", rows), dim, rule, write, "event_type == 'signup'")
    twins.run_to_end(writer.option("checkpointLocation", f"{path}/state"))
    return spark.read.parquet(f"{path}/rows/*").select("event_id", "label")


@query("select event_id % 4 as part, (event_id % 4) >= 2 as there from events group by 1")
def passed_files(spark, sf):
    """Of four files one store has read all and a slower one two: those two go."""
    path = twins.shared_folder(spark)
    rows = events(spark, sf).select("event_id", (F.col("event_id") % 4).alias("b"))

    def run(store: int) -> None:
        stream = one_by_one(spark, f"{path}/in", rows)
        writer = stream.writeStream.format("parquet").option("path", f"{path}/rows/{store}").option("checkpointLocation", f"{path}/state/{store}")
        twins.run_to_end(writer)

    as_batches(rows, f"{path}/in", "b", 2)
    run(1)
    as_batches(rows, f"{path}/in", "b", 4, 2)
    run(2)
    monitor.delete_passed(spark, [f"{path}/state/1", f"{path}/state/2"])
    left = spark.read.schema("b long").parquet(f"{path}/in/*").select("b").distinct().withColumn("there", F.lit(True))
    all_parts = rows.select(F.col("b").alias("part")).distinct()
    return all_parts.join(left, F.col("part") == F.col("b"), "left").select("part", F.coalesce("there", F.lit(False)).alias("there"))


@query("select 110 as batches, count(*) as n from events")
def progress_table(spark, sf):
    """A listener's rows for a stream of more batches than Spark remembers."""
    path = twins.shared_folder(spark)
    rows = events(spark, sf).select("event_id", "ts")
    rows.repartitionByRange(110, "event_id").write.option("maxRecordsPerFile", 0).parquet(f"{path}/in")
    listener = monitor.Progress(f"{path}/progress")
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    name = f"p{path[-12:]}"
    done = twins.run_to_end(stream.writeStream.queryName(name).format("noop").option("checkpointLocation", f"{path}/state"))
    listener.wait_for(str(done.id), done.lastProgress["batchId"])
    spark.streams.removeListener(listener)
    return listener.table(spark).where((F.col("name") == name) & (F.col("n") > 0)).agg(F.count("*").cast("int").alias("batches"), F.sum("n").alias("n"))


# ---- aggregates ------------------------------------------------------------------------------
@query(
    """with w as (select l_returnflag, l_quantity as v, sum(round(l_discount * 100)) as w from lineitem where round(l_discount * 100) > 0 group by 1, 2),
c as (select *, sum(w) over (partition by l_returnflag order by v) as reached, sum(w) over (partition by l_returnflag) as total from w),
p as (select l_returnflag, l_extendedprice as x, row_number() over (partition by l_returnflag order by l_extendedprice desc) as nth from (select distinct l_returnflag, l_extendedprice from lineitem))
select l_returnflag, min(v) filter (reached >= total / 2) as median, (select array_to_string(list(x order by x desc), '|') from p where nth <= 3 and p.l_returnflag = c.l_returnflag) as top
from c group by 1"""
)
def own_aggregates(spark, sf):
    """A weighted median and the three largest values by partial states."""
    items = t(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.round(F.col("l_discount") * 100).alias("w"), "l_extendedprice")
    made = {"median": aggregates.WeightedMedian("l_quantity", "w"), "top": aggregates.TopValues("l_extendedprice", 3)}
    return aggregates.aggregate(items, ["l_returnflag"], made).withColumn("top", F.array_join(F.col("top").cast("array<string>"), "|"))
