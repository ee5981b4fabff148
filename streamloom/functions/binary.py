"""Hashes and byte functions; those that Spark lacks run on Arrow batches."""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF


def signed32(x: int) -> int:
    x &= M32
    return x - (1 << 32) if x >> 31 else x


def murmur2(data: bytes, seed: int = -1) -> int:
    """MurmurHash2, 32 bits, as published."""
    m, h = 0x5BD1E995, (seed ^ len(data)) & M32
    whole = len(data) & ~3
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        k = k * m & M32
        k ^= k >> 24
        h = (h * m & M32) ^ (k * m & M32)
    if tail := data[whole:]:
        h = (h ^ int.from_bytes(tail, "little")) * m & M32
    h = (h ^ h >> 13) * m & M32
    return signed32(h ^ h >> 15)


def _rot(x: int, k: int) -> int:
    return (x << k | x >> (32 - k)) & M32


#: Rotations of the two mixing steps of lookup3.
_MIX = ((0, 2, 1, 4), (1, 0, 2, 6), (2, 1, 0, 8), (0, 2, 1, 16), (1, 0, 2, 19), (2, 1, 0, 4))
_FINAL = ((2, 1, 14), (0, 2, 11), (1, 0, 25), (2, 1, 16), (0, 2, 4), (1, 0, 14), (2, 1, 24))


def jenkins(data: bytes, seed: int = -1) -> int:
    """lookup3 (hashlittle), 32 bits, as published."""
    start = (0xDEADBEEF + len(data) + seed) & M32
    s = [start, start, start]
    at, left = 0, len(data)
    while left > 12:
        for i, v in enumerate(struct.unpack_from("<3I", data, at)):
            s[i] = s[i] + v & M32
        for x, y, z, k in _MIX:
            s[x] = (s[x] - s[y] & M32) ^ _rot(s[y], k)
            s[y] = s[y] + s[z] & M32
        at, left = at + 12, left - 12
    if left:
        for i, v in enumerate(struct.unpack("<3I", data[at:].ljust(12, b"\0"))):
            s[i] = s[i] + v & M32
        for x, y, k in _FINAL:
            s[x] = (s[x] ^ s[y]) - _rot(s[y], k) & M32
    return signed32(s[2])


def bytes_udf(f: Callable[[bytes], object], kind: str) -> Callable[[Column], Column]:
    """A function of bytes on Arrow batches; null for null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(bytes(v)))

    return lambda c: F.pandas_udf(run, kind)(c.cast("binary"))


murmur2_of = bytes_udf(murmur2, "int")
jenkins_of = bytes_udf(jenkins, "int")
gzip_of = bytes_udf(lambda b: gzip.compress(b, mtime=0), "binary")


def _gunzip(data: bytes) -> bytes | None:
    """All that can be read, or null."""
    import zlib

    try:
        return zlib.decompressobj(31).decompress(data)
    except zlib.error:
        return None


gunzip_of = bytes_udf(_gunzip, "binary")


def poly_hash(c: Column, factor: int, bits: int = 32) -> Column:
    """``h = h * factor + byte`` over the signed UTF-8 bytes, modulo 2^32, as a signed int."""
    data = F.encode(c, "UTF-8")
    unit = lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("bigint")
    byte = lambda i: F.when(unit(i) > 127, unit(i) - 256).otherwise(unit(i))
    places = F.filter(F.sequence(F.lit(0), F.length(data)), lambda i: i < F.length(data))
    total = F.aggregate(F.transform(places, byte), F.lit(0).cast("bigint"), lambda h, b: F.pmod(h * factor + b, F.lit(1 << bits)))
    return F.when(total >= 1 << (bits - 1), total - (1 << bits)).otherwise(total).cast("int")


def md5_signed(data: bytes) -> str:
    """The digest as a signed big number in base 16: it may have a minus and lacks leading zeros."""
    n = int.from_bytes(hashlib.md5(data).digest(), "big", signed=True)
    return f"{n:x}"


def text_hash(c: Column, start: int, end: int) -> Column:
    """``h = 31 * h + unit`` over the characters from ``start`` to before ``end``, as a long that wraps. For the plane of 16 bits."""
    units = F.encode(F.substring(c, start + 1, end - start), "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(units, i * 2 + 1, F.lit(2))), 16, 10).cast("decimal(38,0)")
    n = F.floor(F.length(units) / 2).cast("int")
    places = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    wrap = F.lit(1 << 32).cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(38,0)")
    step = lambda h, u: F.pmod((h * 31 + u).cast("decimal(38,0)"), wrap).cast("decimal(38,0)")
    total = F.aggregate(F.transform(places, unit), F.lit(0).cast("decimal(38,0)"), step)
    return F.when(total >= wrap / 2, total - wrap).otherwise(total).cast("bigint")


def prime_at_least(n: int) -> int:
    """The smallest prime that is not below ``n``: a good number of buckets."""
    k = max(2, n)
    while any(k % d == 0 for d in range(2, int(k**0.5) + 1)):
        k += 1
    return k


def compare_bytes(a: Column, b: Column) -> Column:
    """-1, 0 or 1, byte by byte without sign."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def starts_with_bytes(c: Column, prefix: Column) -> Column:
    return F.substring(c, F.lit(1), F.octet_length(prefix)) == prefix


def vint(n: int) -> bytes:
    """A variable-length integer: one byte from -112 to 127, else a byte that tells sign and length, then the magnitude."""
    if -112 <= n <= 127:
        return struct.pack("b", n)
    size = n if n >= 0 else ~n
    raw = size.to_bytes((size.bit_length() + 7) // 8, "big")
    return struct.pack("b", (-112 if n >= 0 else -120) - len(raw)) + raw


def read_vint(data: bytes) -> int:
    first = struct.unpack("b", data[:1])[0]
    if first >= -112:
        return first
    n = -112 - first if first >= -120 else -120 - first
    size = int.from_bytes(data[1 : 1 + n], "big")
    return size if first >= -120 else ~size


def vint_of(c: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else vint(int(v)))

    return F.pandas_udf(run, "binary")(c.cast("string"))


read_vint_of = bytes_udf(read_vint, "long")
md5_signed_of = bytes_udf(md5_signed, "string")


def lower_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def unique_id() -> Column:
    return F.substring(F.upper(F.md5(F.concat(F.uuid(), F.current_timestamp().cast("string")))), 1, 10)


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tail(c: Column, n: int) -> Column:
    return F.substring(c, F.greatest(F.length(c) - n + 1, F.lit(1)), F.lit(n))


def pad_bytes(c: Column, n: int, front: bool = False) -> Column:
    zeros = F.unhex(F.lit("00" * n))
    return F.concat(zeros, c) if front else F.concat(c, zeros)


def increment(data: bytes, by: int = 1) -> bytes:
    """The bytes as a big-endian number plus ``by``, of the same length; it wraps."""
    n = len(data)
    return ((int.from_bytes(data, "big") + by) % (1 << (8 * n))).to_bytes(n, "big") if n else data


def split_range(low: bytes, high: bytes, parts: int) -> list[bytes]:
    """``parts + 1`` bounds from low to high at even distances."""
    n = max(len(low), len(high))
    a, b = (int.from_bytes(x.ljust(n, b"\0"), "big") for x in (low, high))
    if a > b or parts < 1:
        raise ValueError("the low bound is above the high one or there are no parts")
    return [(a + (b - a) * i // parts).to_bytes(n, "big") for i in range(parts + 1)]


def pack(value, compress: bool = True, encode: bool = True) -> str | bytes:
    """JSON of a value, gzipped and in base64 if asked for; ``unpack`` reads it."""
    import json

    raw = json.dumps(value, sort_keys=True).encode()
    raw = gzip.compress(raw, mtime=0) if compress else raw
    return base64.b64encode(raw).decode() if encode else raw


def unpack(data: str | bytes, compress: bool = True, encode: bool = True):
    import json

    raw = base64.b64decode(data) if encode else data
    return json.loads(gzip.decompress(raw) if compress else raw)
