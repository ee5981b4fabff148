"""Files: path macros, incremental pointers, byte-offset tailing."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import MACROS, macro_regex


def path_regex(pattern: str) -> str:
    """A regular expression for a path with ``${...}`` macros and ``*`` anywhere; a part never spans a folder."""
    return "/".join(macro_regex(p, wildcard=True).replace(".*", "[^/]*") for p in pattern.split("/"))


def path_glob(pattern: str) -> str:
    """The widest glob of a path with macros, for the file index."""
    return re.sub(r"\$\{(\w+)\}", lambda m: "*" if m[1].lower() in MACROS else m[0], pattern)


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``path``, ``modified`` and ``size`` of the matching files, oldest first; no content is read."""
    found = spark.read.format("binaryFile").load(path_glob(pattern)).select(
        "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")
    )
    plain = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    return found.where(plain.rlike(f"^{path_regex(pattern)}$")).orderBy("modified", "path")


def list_tree(spark: SparkSession, root: str, keep: str = ".*", skip: tuple[str, ...] = ()) -> DataFrame:
    """All files below a folder whose names match and whose paths hold none of ``skip``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    named = named.where(F.substring_index("path", "/", -1).rlike(f"^(?:{keep})$"))
    for part in skip:
        named = named.where(~F.contains("path", F.lit(part)))
    return named


def read_text(spark: SparkSession, pattern: str, line: str | None = None, whole: bool = False) -> DataFrame:
    """``value`` and ``path`` of matching text files; codecs go by file name."""
    reader = spark.read.option("wholetext", str(whole).lower())
    if line:
        reader = reader.option("lineSep", line)
    plain = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*(?=/)", "")
    return reader.text(path_glob(pattern)).select("value", plain.alias("path")).where(F.col("path").rlike(f"^{path_regex(pattern)}$"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streams"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def list_dir(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and size of what stands in a folder of any file system of Spark's; a missing folder is empty."""
    jpath, fs = _hadoop(spark, path)
    return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def make_dir(spark: SparkSession, path: str) -> bool:
    jpath, fs = _hadoop(spark, path)
    return fs.mkdirs(jpath)


def create_new(spark: SparkSession, path: str) -> bool:
    """Makes an empty file in one step; false if somebody else has it."""
    jpath, fs = _hadoop(spark, path)
    return fs.createNewFile(jpath)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a file or folder; an existing target is an error."""
    jpath, fs = _hadoop(spark, path)
    target, _ = _hadoop(spark, to)
    if fs.exists(target):
        raise FileExistsError(to)
    return fs.rename(jpath, target)


def delete(spark: SparkSession, path: str) -> bool:
    jpath, fs = _hadoop(spark, path)
    return fs.delete(jpath, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    jpath, fs = _hadoop(spark, path)
    return fs.getContentSummary(jpath).getLength()


def numbered_files(names: DataFrame, name: str, pattern: str = r"(\d+)$") -> DataFrame:
    """Rows whose file name holds a number, with it as ``seq``, in its order."""
    seq = F.regexp_extract(name, pattern, 1).try_cast("bigint")
    return names.withColumn("seq", seq).where("seq IS NOT NULL").orderBy("seq")


class Pointer:
    """How far each folder has been read: ``{folder: [name, modified ms, offset]}``."""

    def __init__(self, text: str | None = None):
        self.at: dict[str, list] = json.loads(text) if text else {}

    def plan(self, files: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """(path, from, to) of what is new in ``files`` (path, modified ms, size).

        Older files and a last file that has been read whole are skipped, a file that grew goes on
        from its offset, others start at 0.
        """
        out = []
        for path, modified, size in sorted(files, key=lambda f: (f[1], f[0])):
            folder, _, name = path.rpartition("/")
            last = self.at.get(folder)
            if last and (modified < last[1] or modified == last[1] and (name < last[0] or name == last[0] and size <= last[2])):
                continue
            start = last[2] if last and name == last[0] and size >= last[2] else 0
            if start < size:
                out.append((path, start, size))
        return out

    def advance(self, path: str, modified: int, offset: int) -> None:
        folder, _, name = path.rpartition("/")
        self.at[folder] = [name, modified, offset]

    def __str__(self) -> str:
        return json.dumps(self.at, sort_keys=True)


def read_ranges(spark: SparkSession, ranges: list[tuple[str, int, int]], delimiter: str = "\n") -> DataFrame:
    """Records of byte ranges of files, a task for each range.

    Local files are read from the offset on; files of any other file system are read by Spark, whole, and cut.
    """
    mark = delimiter.encode()

    def run(rows: Iterator) -> Iterator:
        import pandas as pd

        for pdf in rows:
            for path, start, end in zip(pdf["path"], pdf["start"], pdf["end"]):
                yield pd.DataFrame({"path": path, "value": list(_records(path, start, end, mark))})

    if not ranges:
        return spark.createDataFrame([], "path string, value string")
    tasks = spark.createDataFrame(ranges, "path string, start long, end long").repartition(len(ranges), "path", "start")
    if any("://" in p and not p.startswith("file:") for p, _, _ in ranges):
        bodies = spark.read.format("binaryFile").load([p for p, _, _ in ranges]).select("path", "content")
        cut = F.decode(F.substring("content", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")), "UTF-8")
        parts = tasks.join(bodies, "path").select("path", F.explode(F.split(cut, re.escape(delimiter), -1)).alias("value"))
        return parts.where("value <> ''")
    return tasks.mapInPandas(run, "path string, value string")


def _records(path: str, start: int, end: int, mark: bytes, block: int = 1 << 20) -> Iterator[str]:
    with open(path, "rb") as f:
        f.seek(start)
        left, held = end - start, b""
        while left > 0 and (data := f.read(min(block, left))):
            left -= len(data)
            *whole, held = (held + data).split(mark)
            yield from (r.decode("utf-8", "replace") for r in whole if r)
        if held:
            yield held.decode("utf-8", "replace")
