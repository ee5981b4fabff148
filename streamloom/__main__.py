"""``python -m streamloom start SPEC.json LANDING OUT [--http PORT] [--tcp PORT]`` and ``stop ID OUT``.

``SPEC.json`` holds a definition or a list of them. ``start`` runs every store of each over what
receivers land and writes text files below ``OUT``; with a port it runs the receiver as well.
``stop`` asks it to work off what has come in and to end.
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.records import decode_rows, split_batch
from .operators.sinks import delimited
from .plans.builder import parsed
from .sources import receiver
from .spec import HOST, LOG_ID, StreamSpec
from .streaming import ledger, twins


def mark(out: str, msg_id: int) -> str:
    return f"{out.rstrip('/')}/stop-{msg_id}"


def pushed(landed: DataFrame, spec: StreamSpec) -> DataFrame:
    """The rows of a definition's topic: texts by its rules, texts sent as a batch split as a JSON array first, binary content by its field types."""
    own = landed.where(F.col("topic") == spec.name)
    one = own.where(~F.col("binary") & ~F.col("batch")).select(F.col("content").alias("value"))
    many = own.where(~F.col("binary") & F.col("batch")).select(F.col("content").alias("value"))
    rows = parsed(one.unionByName(split_batch(many, "value", "array", "json")), spec)
    binary = own.where("binary").select(F.unbase64("content").alias("value"))
    typed = decode_rows(binary, [(f.name, f.data_type) for f in spec.fields])
    kinds = dict(rows.dtypes)
    return rows.unionByName(typed.select(*[F.col(c).cast(kinds[c]) for c in rows.columns]))


def start(
    spark: SparkSession, specs: StreamSpec | list[StreamSpec], landing: str, out: str, interval: str = "5 seconds", poll: float = 1.0,
    http: int | None = None, tcp: int | None = None, host: str = "local",
) -> None:
    """Runs until the marks of ``stop`` are there for all definitions, then drains. Log ids of a store
    count on over batches and restarts. A port of 0 is any free one; the ports are written to
    ``_ports.json`` in ``landing``."""
    specs = specs if isinstance(specs, list) else [specs]
    held = receiver.Landing(landing, {s.name for s in specs})
    servers = [make(held, port) for make, port in ((receiver.http_server, http), (receiver.tcp_server, tcp)) if port is not None]
    if servers:
        ports = [receiver.serving(s) for s in servers]
        with open(f"{landing}/.ports.json", "w", encoding="utf-8") as f:
            json.dump(ports, f)
        os.replace(f"{landing}/.ports.json", f"{landing}/_ports.json")
    landed = spark.readStream.schema("topic string, content string, batch boolean, binary boolean").json(landing)
    running: dict[int, list] = {}
    for spec in specs:

        def write(store, df, number, spec=spec) -> None:
            order = [F.col(c) for c in df.columns]
            rows = ledger.numbered(df.withColumn(HOST, F.lit(spec.name)), [HOST], order, f"{out}/_ids/{spec.msg_id}-{store.store_id}", number, LOG_ID)
            rows = rows.withColumn(HOST, F.lit(host))
            delimited(rows, list(spec.fields)).write.mode("overwrite").text(f"{out}/{spec.name}/{store.store_id}/batch={number}")

        running[spec.msg_id] = twins.start_stores(pushed(landed, spec), spec, write, f"{out}/_state/{spec.msg_id}", interval)
    while running:
        for msg_id, queries in list(running.items()):
            if os.path.exists(mark(out, msg_id)) or not all(q.isActive for q in queries):
                if len(running) == 1:
                    for server in servers:  # nobody is told ok for what no stream will read
                        server.shutdown()
                        server.server_close()
                twins.drain(running.pop(msg_id))
                if os.path.exists(mark(out, msg_id)):
                    os.remove(mark(out, msg_id))
        time.sleep(poll if running else 0)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="streamloom", description=__doc__)
    what = parser.add_subparsers(dest="what", required=True)
    run = what.add_parser("start")
    run.add_argument("spec")
    run.add_argument("landing")
    run.add_argument("out")
    run.add_argument("--interval", default="5 seconds")
    run.add_argument("--http", type=int)
    run.add_argument("--tcp", type=int)
    end = what.add_parser("stop")
    end.add_argument("msg_id", type=int)
    end.add_argument("out")
    args = parser.parse_args(argv)
    if args.what == "stop":
        os.makedirs(args.out, exist_ok=True)
        open(mark(args.out, args.msg_id), "w").close()
        return
    with open(args.spec, encoding="utf-8") as f:
        raw = json.load(f)
    specs = [StreamSpec.from_json(s) for s in (raw if isinstance(raw, list) else [raw])]
    spark = SparkSession.builder.appName("streamloom-" + "-".join(s.name for s in specs)[:60]).getOrCreate()
    start(spark, specs, args.landing, args.out, args.interval, http=args.http, tcp=args.tcp)


if __name__ == "__main__":
    main()
