"""Lines of the members of tar archives, plain or compressed; an archive is a task and is read as a stream."""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import shared
from .tail import batched

#: Names of archives and how each is compressed.
KINDS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")


class TarSource(DataSource):
    """``tar_lines``: ``archive``, ``member``, ``line`` (from 1) and ``value`` for each line of each file in the archives below ``path``.

    Option ``members`` is a regular expression for whole member names, ``encoding`` that of the
    text. Folders, links and other entries that aren't files give nothing; a broken archive is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_lines"

    def schema(self) -> str:
        return "archive string, member string, line long, value string"

    def reader(self, schema) -> DataSourceReader:
        return TarReader(dict(self.options))


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.members = options["path"], options.get("members", ".*")
        self.encoding = options.get("encoding", "utf-8")

    def partitions(self) -> list[InputPartition]:
        if self.path.endswith(KINDS):
            return [InputPartition(self.path)]
        root = shared.opened(self.path)[1]
        kind = self.path[: len(self.path) - len(root)] if "://" in self.path else ""
        return [InputPartition(kind + f.path) for f in shared.listed(self.path, recursive=True) if f.path.endswith(KINDS)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        system, path = shared.opened(partition.value)
        with system.open_input_stream(path, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
            for rows in batched(self.lines(archive)):
                names, numbers, values = zip(*rows)
                arrays = [pa.array([partition.value] * len(rows)), pa.array(names), pa.array(numbers, pa.int64()), pa.array(values)]
                yield pa.RecordBatch.from_arrays(arrays, names=["archive", "member", "line", "value"])

    def lines(self, archive: tarfile.TarFile) -> Iterator[tuple[str, int, str]]:
        rule = re.compile(self.members)
        for member in archive:
            if member.isfile() and rule.fullmatch(member.name):
                for i, line in enumerate(archive.extractfile(member), 1):
                    yield member.name, i, line.decode(self.encoding, "replace").removesuffix("\n").removesuffix("\r")


def pack(df: DataFrame, folder: str, archive: str, member: str, value: str) -> DataFrame:
    """Writes ``folder``/<archive>.tar.gz with a text member for each ``member``, an archive a group; gives archive and number of lines.

    Lines stand in the order of ``value``. A repeated task replaces its archive. A member must fit in a task's memory, an archive needn't.
    """
    def run(batches: Iterator) -> Iterator:
        import os
        import tempfile
        from io import BytesIO
        from itertools import groupby

        import pandas as pd

        def rows() -> Iterator[tuple]:
            for pdf in batches:
                yield from zip(pdf[archive], pdf[member], pdf[value])

        for name, members in groupby(rows(), key=lambda r: r[0]):
            n = 0
            with tempfile.TemporaryFile() as f:
                with tarfile.open(fileobj=f, mode="w:gz") as out:
                    for inner, lines in groupby(members, key=lambda r: r[1]):
                        texts = [v for _, _, v in lines]
                        body = "".join(f"{v}\n" for v in texts).encode()
                        info = tarfile.TarInfo(str(inner))
                        info.size = len(body)
                        out.addfile(info, BytesIO(body))
                        n += len(texts)
                f.seek(0, os.SEEK_SET)
                system, path = shared.opened(f"{folder}/{name}.tar.gz")
                system.create_dir(os.path.dirname(path), recursive=True)
                with system.open_output_stream(path, compression=None) as target:
                    while block := f.read(1 << 20):
                        target.write(block)
            yield pd.DataFrame({"archive": [str(name)], "n": [n]})

    dealt = df.select(archive, member, value).repartition(archive).sortWithinPartitions(archive, member, value)
    return dealt.mapInPandas(run, "archive string, n long")
