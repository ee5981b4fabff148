"""WARC archives: writing with segmentation, and segment reassembly with chunked transfer framing.

A record is an HTTP response (or a revisit of an equal payload). Its payload goes out in chunked
transfer framing, and a record above ``SEGMENT`` bytes is split: the first segment carries segment
number 1, continuation records the origin's id, their numbers and, the last, the total length. The
text sink ends each record with the two line ends that the format asks for. Reading unpacks archives
piece by piece, groups continuation records by origin id, orders them by number, verifies the total
length and decodes the chunks. What can't be read is told apart with its reason, and reading goes
on at the next record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, shared_dir, source_columns, table, tidy

#: Bytes of a record's block before it is split, bytes of a chunk, records a file holds at most.
SEGMENT, CHUNK, FILE_RECORDS = 32_768, 4096, 1000
#: Bytes of a header at most.
HEAD = 1 << 20
#: Bytes of records that a worker holds before it passes them on.
SLICE = 4 << 20
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of up to ``size`` bytes that end between code points."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in cuts(payload, size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + n]
        if len(chunk) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(chunk)
        at = end + 4 + n


def records(rid: str, kind: str, page: dict, payload: bytes, segment: int = SEGMENT) -> Iterator[str]:
    """The records of one page without the final line ends; more than one if the block is long."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
    if kind == "revisit":
        block = f"{http}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    else:
        block = f"{http}Transfer-Encoding: chunked{CRLF}{CRLF}".encode() + chunked(payload)
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{rid}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", page["url"]),
        ("WARC-Page-ID", page["page_id"]),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Refers-To-Page", page["refers_to"] if kind == "revisit" else None),
        ("WARC-Refers-To-Target-URI", page.get("refers_to_url") if kind == "revisit" else None),
        ("WARC-Refers-To-Date", "2024-01-01T00:00:00Z" if kind == "revisit" else None),
        ("WARC-Profile", PROFILE if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    parts = list(cuts(block, segment))
    for k, part in enumerate(parts, 1):
        own = head if k == 1 else [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.UUID(rid), str(k))}>"),
            ("WARC-Date", "2024-01-01T00:00:00Z"),
            ("WARC-Segment-Origin-ID", f"<urn:uuid:{rid}>"),
        ]
        if len(parts) > 1:
            own = [*own, ("WARC-Segment-Number", k)]
        if len(parts) > 1 and k == len(parts):
            own = [*own, ("WARC-Segment-Total-Length", len(block))]
        lines = "".join(f"{n}: {_plain(v)}{CRLF}" for n, v in [*own, ("Content-Length", len(part))] if v is not None)
        yield f"WARC/1.1{CRLF}{lines}{CRLF}{part.decode('utf-8')}"


def _plain(value) -> str:
    """Header values are one line: control characters are percent-coded, all else stays as it is."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def unpacked(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """An archive's bytes, piece by piece: gzip members one after the other, or plain text."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + size] for i in range(0, len(content), size))
        return
    left = memoryview(content)
    while len(left):
        member = zlib.decompressobj(31)
        fed = left[:size]
        left = left[size:]
        while True:
            try:
                data = member.decompress(bytes(fed), size)
            except zlib.error:
                return  # what can't be unpacked ends the archive; the record it cut is told as broken
            if data:
                yield data
            if member.eof:
                left = memoryview(content)[len(content) - len(left) - len(member.unused_data) :]
                break
            fed = member.unconsumed_tail
            if fed or len(data) == size:
                continue
            if not len(left):
                return
            fed, left = left[:size], left[size:]


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict, bytes, str | None]]:
    """Header (names lower-cased), block and error of each record; after an error the next record is looked for."""
    held, done = b"", False
    more = iter(pieces)

    def fill(n: int) -> bool:
        nonlocal held, done
        parts, have = [held], len(held)
        while have < n and not done:
            piece = next(more, None)
            if piece is None:
                done = True
            else:
                parts.append(piece)
                have += len(piece)
        held = b"".join(parts)
        return have >= n

    while True:
        fill(8)
        start = len(held) - len(held.lstrip(b"\r\n"))
        if start:
            held = held[start:]
            continue
        if not held:
            return
        end = held.find(b"\r\n\r\n")
        while end < 0 and len(held) < HEAD and fill(len(held) + 1):
            end = held.find(b"\r\n\r\n")
        lines = held[: max(end, 0)].decode("utf-8", "replace").split(CRLF)
        head = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
        size = head.get("content-length", "")
        if end < 0 or not lines[0].startswith("WARC/") or not size.isascii() or not size.isdigit():
            known = end >= 0 and lines[0].startswith("WARC/")
            yield head if known else {}, b"", "no length" if known else "no record"
        elif not fill(end + 4 + int(size)):
            yield head, b"", "a record ends early"
        else:
            block, held = held[end + 4 : end + 4 + int(size)], held[end + 4 + int(size) :]
            yield head, block, None
            continue
        at = held.find(b"\nWARC/", 1)
        while at < 0 and not done:
            held = held[-6:]
            fill(len(held) + 1)
            at = held.find(b"\nWARC/", 1)
        if at < 0:
            return
        held = held[at + 1 :]


def write(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """One record for each row of ``pages`` (``page_id``, ``url``, ``html``) into gzipped archives at ``path``.

    Of rows with equal payloads those with the smallest ``page_id`` are responses, the others revisits
    of it; null ids are larger than all and a null ``html`` is an empty payload. Repeated rows are
    records of their own, other columns are left out, and no rows give archives without records.
    """
    source_columns(pages, "page_id", "url", "html")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sha = F.sha1(F.encode("html", "UTF-8"))
    least = rows.groupBy(sha.alias("_sha")).agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"))
    least = materialize(least, "warc-first")
    joined = rows.withColumn("_sha", sha).join(least, "_sha").drop("_sha")
    # ids travel as text: pandas would round large ones beside nulls
    joined = joined.withColumns({c: F.col(c).cast("string") for c in ("page_id", "first")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0
        for pdf in batches:
            out, size = [], 0
            for i, url, html, first, first_url in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["first"], pdf["first_url"]):
                i, first = (None if x is None else int(x) for x in (i, first))
                rid = str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}/{TaskContext.get().partitionId()}/{number}"))
                number += 1
                page = {"page_id": i, "url": url, "refers_to": first, "refers_to_url": first_url}
                out += records(rid, "response" if i == first else "revisit", page, html.encode("utf-8"), segment)
                size += len(html)
                if size > SLICE:
                    yield pd.DataFrame({"value": out})
                    out, size = [], 0
            yield pd.DataFrame({"value": out})

    archive = joined.mapInPandas(run, "value string")
    writer = archive.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS)
    writer.text(path)
    del archive, joined, writer
    release(least)
    tidy(pages.sparkSession)


def read(spark: SparkSession, path: str, broken: bool = False) -> DataFrame:
    """Reassembled records: ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest``, ``payload``.

    Responses, resources and revisits are given, other kinds (warcinfo, request, metadata...) are
    left out. ``payload`` is null for a revisit, whose length and digest the record states; for
    others both come from the payload. With ``broken`` the records that can't be read are given
    instead, by ``record_id`` and ``error``: a header or length that is none, an early end, a
    missing segment, a total length, chunk or digest that differs. Only records in segments are
    shuffled, one group for each; the archives are parsed once for them and once for the others, so
    that no parsed copy is stored. No archive gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("path").rlike(r"\.(gz|warc)$")).select("content")

    def parsed(batches: Iterator[pd.DataFrame], segments: bool) -> Iterator[list[tuple]]:
        """Records with or without a segment number, a few megabytes at a time."""
        found, size = [], 0
        for pdf in batches:
            for content in pdf["content"]:
                for head, block, error in parse(unpacked(content)):
                    stated = head.get("warc-segment-number", "")
                    number = int(stated) if error is None and stated.isdigit() else 0
                    kind = head.get("warc-type", "")
                    if segments != (number > 0) or (error is None and kind not in (*KINDS, "continuation")):
                        continue
                    meta = "\n".join(f"{k}: {v}" for k, v in head.items() if k in _KEPT)
                    if segments:
                        origin, total = head.get("warc-segment-origin-id", head.get("warc-record-id")), head.get("warc-segment-total-length", "")
                        found.append((origin, number, int(total) if total.isdigit() else None, meta, block))
                    else:
                        found.append(_row(meta, block, error))
                    size += len(block)
                    if size > SLICE:
                        yield found
                        found, size = [], 0
        yield found

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(_frame, parsed(batches, False))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in parsed(batches, True):
            yield pd.DataFrame(found, columns=["origin", "number", "total", "meta", "block"]).astype({"total": "Int64"})

    whole = files.mapInPandas(alone, _SCHEMA)
    parts = files.mapInPandas(split, "origin string, number int, total long, meta string, block binary")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        block = b"".join(map(bytes, pdf["block"]))
        total = pdf["total"].iloc[-1]
        error = None
        if pdf["number"].tolist() != list(range(1, len(pdf) + 1)):
            error = "a segment is missing or repeats"
        elif pd.isna(total) or total != len(block):
            error = f"segments of {len(block)} bytes, stated are {total}"
        return _frame([_row(pdf["meta"].iloc[0], block, error)])

    out = whole.unionByName(parts.groupBy("origin").applyInPandas(joined, _SCHEMA))
    if broken:
        return out.where("error IS NOT NULL").select("record_id", "error")
    return out.where("error IS NULL").drop("record_id", "error")


#: Kinds of records that hold or state a payload.
KINDS = ("response", "resource", "revisit")
_KEPT = ("warc-type", "warc-record-id", "warc-target-uri", "warc-page-id", "warc-payload-digest", "warc-refers-to-page")
_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, error string"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    whole = {n: pd.array([r[k] for r in rows], "Int64") for k, n in enumerate(names) if n in ("page_id", "refers_to", "payload_bytes")}
    return pd.DataFrame(rows, columns=names).assign(**whole)


def _row(meta: str, block: bytes, error: str | None = None) -> tuple:
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in meta.split("\n") if line)
    kind, rid = head.get("warc-type"), head.get("warc-record-id")
    bad = lambda why: (None, head.get("warc-target-uri"), kind, None, None, None, None, rid, why)
    if error or kind not in KINDS:
        return bad(error or f"a record of kind {kind} in segments")
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    number = lambda k: int(head[k]) if re.fullmatch(r"-?\d+", head.get(k, "")) else None
    body, fields = block, {}
    if kind != "resource":
        http, _, body = block.partition(b"\r\n\r\n")
        fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in http.decode("latin-1").split(CRLF)[1:])}
    payload, length, digest = None, fields.get("content-length", ""), stated
    size = int(length) if length.isdigit() else None
    if kind != "revisit":
        try:
            payload = unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
        except ValueError as why:
            return bad(f"chunks: {why}")
        size, digest = len(payload), digest_of(payload)
        if stated and len(stated) == 32 and digest != stated.upper():
            return bad(f"payload digest {digest} is stated as {stated}")
    return number("warc-page-id"), head.get("warc-target-uri"), kind, number("warc-refers-to-page"), size, digest, payload, rid, None


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:8]}"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
