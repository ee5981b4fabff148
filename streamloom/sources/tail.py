"""Growing text files as a stream: offsets are bytes of files, a batch is a set of byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import shared
from .files import path_regex

#: Bytes of a task's range, and rows that it hands over at once.
PART, ROWS = 32 << 20, 10_000


class TailSource(DataSource):
    """``tail_text``: whole records of all files that match ``path`` (macros and ``*`` as in ``read_text``).

    Options: ``delimiter`` (a line end), ``maxbytes`` of a batch, ``partbytes`` of a task, ``state``
    (a file that keeps the planned position, so that a batch after a restart is bounded as well),
    ``boundfile`` (a file that holds the present ``maxbytes``, as a rate control writes it).

    A record is delivered once its delimiter is there. A file that has shrunk is read from its
    start; a file that is gone leaves the offset. A repeated batch reads the same ranges.
    """

    @classmethod
    def name(cls) -> str:
        return "tail_text"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


class Range(InputPartition):
    """Records of ``path`` that begin from ``start`` up to ``end``, of a batch that has those from ``begin`` up to ``stop``."""

    def __init__(self, path: str, start: int, end: int, begin: int, stop: int):
        self.path, self.start, self.end, self.begin, self.stop = path, start, end, begin, stop


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.mark = options.get("delimiter", "\n").encode()
        self.most, self.part = int(options.get("maxbytes", 0)), int(options.get("partbytes", PART))
        # a delimiter that may overlap itself shows where it begins only when read from a record's start on
        self.overlaps = any(self.mark.startswith(self.mark[k:]) for k in range(1, len(self.mark)))
        self.part = 1 << 62 if self.overlaps else self.part
        self.state, self.bound = options.get("state"), options.get("boundfile")
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def files(self) -> list:
        """Matching files, oldest first."""
        fixed = re.split(r"[*$]", self.pattern)[0].rpartition("/")[0]
        plain = shared.opened(self.pattern)[1]
        rule = re.compile(path_regex(plain))
        found = [f for f in shared.listed(fixed, recursive=True) if rule.fullmatch(f.path) and not re.search(r"/[._][^/]*$", f.path)]
        return sorted(found, key=lambda f: (f.mtime_ns or 0, f.path))

    def latestOffset(self) -> dict:
        """Where the whole records of each file end, as far as the bound reaches beyond the position known."""
        at = self.at if self.at is not None else shared.get_json(self.state) if self.state else None
        most = int(shared.get(self.bound) or self.most) if self.bound else self.most
        left = most if most and at is not None else None
        out = {}
        for f in self.files():
            start = (at or {}).get(f.path, 0)
            start = start if start <= f.size else 0
            end = self.whole(f.path, start, f.size, left) if f.size > start else start
            left = None if left is None else max(0, left - (end - start))
            if end or f.path in (at or {}):
                out[f.path] = end
        self.at = dict(sorted(out.items()))
        if self.state:
            shared.put_json(self.state, self.at)
        return self.at

    def whole(self, path: str, start: int, size: int, left: int | None) -> int:
        """The end of the last whole record up to ``left`` bytes beyond ``start``, of the first one if it is longer; ``start`` if there is none or nothing is left."""
        if left == 0:
            return start
        system, path = shared.opened(path)
        goal = size if left is None else min(size, start + left)
        with system.open_input_file(path) as f:
            high, step = goal, goal - start if self.overlaps else 1 << 16
            while high > start:  # backwards from the goal
                low = max(start, high - step)
                f.seek(low)
                data = f.read(min(goal, high + len(self.mark) - 1) - low)
                found = data.rfind(self.mark) if not self.overlaps else sum(len(x) + len(self.mark) for x in data.split(self.mark)[:-1]) - len(self.mark)
                if found >= 0:
                    return low + found + len(self.mark)
                high = low
        if goal == size:
            return start
        at, held = max(start, goal - len(self.mark) + 1), b""
        for data in shared.blocks(system, path, at):  # a record that is longer than the bound
            held += data
            found = held.find(self.mark)
            if found >= 0:
                end = at + found + len(self.mark)
                return end if end <= size else start
            keep = len(self.mark) - 1
            at, held = at + len(held) - keep, held[len(held) - keep :]
        return start

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            begin = begin if begin <= stop else 0  # it has shrunk
            out += [Range(path, s, min(s + self.part, stop), begin, stop) for s in range(begin, stop, self.part)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, path = shared.opened(partition.path)
        for rows in batched(records(shared.blocks(system, path, origin(partition, len(self.mark))), partition, self.mark)):
            offsets, values = zip(*rows)
            texts = [v.decode("utf-8", "replace") for v in values]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], names=["path", "offset", "value"])


def origin(part: Range, mark: int) -> int:
    """Where to read from: a record may begin at the start of a later part only if a delimiter stands before it."""
    return max(part.begin, part.start - mark)


def records(data: Iterator[bytes], part: Range, mark: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the records that begin in the part; empty records go."""
    at, held, skip = origin(part, len(mark)), b"", part.start > part.begin
    for block in data:
        held += block
        room = part.stop - at
        if len(held) > room:
            held = held[:room]
        cut = 0
        while (found := held.find(mark, cut)) >= 0:
            if not skip and at + cut >= part.end:
                return
            if not skip and found > cut:
                yield at + cut, held[cut:found]
            skip, cut = False, found + len(mark)
        if not skip and at + cut >= part.end or at + len(held) >= part.stop:
            return
        at, held = at + cut, held[cut:]


def batched(rows: Iterator[tuple], size: int = ROWS) -> Iterator[list[tuple]]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
