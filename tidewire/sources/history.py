"""A chat's history as a streaming source with a cursor: Parquet exports whose rows carry a growing message number.

The offset is the last number read. The first batch takes the newest `initial` messages (all, if not given); later ones take
what came after the cursor, and once more the messages among the last `lookback` numbers up to it, marked `again`, since they
may have been edited. What a batch reads follows from its two offsets, so one that is run again after a failure reads the
same numbers. The driver reads footers, and for `initial` the numbers of the newest row groups; tasks read row groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

AGAIN = "again"
GROUPS = 8  # row groups that one task reads


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Groups(InputPartition):
    """Row groups of a file, and the numbers (low, high] to take of them; up to `seen` they are taken again."""

    file: str
    groups: tuple[int, ...]
    low: int
    high: int
    seen: int


class HistoryReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.path, self.key = options["path"], options.get("key", "id")
        self.initial = int(options["initial"]) if "initial" in options else None
        self.lookback = max(0, int(options.get("lookback", "25")))
        self.until = int(options["until"]) if "until" in options else None

    def _groups(self) -> list[tuple[str, int, int, int]]:
        """(file, row group, least number, greatest number), by greatest number from the top. Groups of nulls are left out."""
        files, root = filesystem(self.path)
        found = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or info.base_name[0] in "._" or not info.size:
                continue
            with files.open_input_file(info.path) as f:
                meta = pq.ParquetFile(f).metadata
            at = meta.schema.to_arrow_schema().get_field_index(self.key)
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(at).statistics
                if s is not None and s.has_min_max:
                    found.append((info.path, g, s.min, s.max))
        return sorted(found, key=lambda x: (-x[3], x[0], x[1]))

    def _ids(self, file: str, group: int, low: int, high: int) -> list[int]:
        files, _ = filesystem(self.path)
        with files.open_input_file(file) as f:
            got = pq.ParquetFile(f).read_row_group(group, columns=[self.key])[self.key]
        return [x for x in got.drop_null().to_pylist() if low < x <= high]

    def initialOffset(self) -> dict:
        return {"last": -1}

    def latestOffset(self) -> dict:
        groups = self._groups()
        if not groups:
            return {"last": -1}
        if self.until is None or groups[0][3] <= self.until:
            return {"last": groups[0][3]}
        best = -1
        for file, g, least, most in groups:
            if most <= best:
                break
            if least <= self.until:
                best = max([best, *(x for x in self._ids(file, g, best, self.until))])
        return {"last": best}

    def _floor(self, high: int) -> int:
        """The number before that of the `initial`-th newest message up to `high`."""
        if self.initial is None:
            return -1
        newest: list[int] = []
        for file, g, least, most in self._groups():
            full = len(newest) >= self.initial
            if full and (not newest or most <= newest[-1]):
                break
            if least <= high:
                newest = sorted(set(newest + self._ids(file, g, newest[-1] if full else -1, high)), reverse=True)[: self.initial]
        return newest[-1] - 1 if newest else high

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        last, high = start["last"], end["last"]
        if high <= last:
            return []
        low = self._floor(high) if last < 0 else max(-1, last - self.lookback)
        wanted: dict[str, list[int]] = {}
        for file, g, least, most in self._groups():
            if least <= high and most > low:
                wanted.setdefault(file, []).append(g)
        return [Groups(f, tuple(sorted(gs)[i : i + GROUPS]), low, high, last) for f, gs in sorted(wanted.items()) for i in range(0, len(gs), GROUPS)]

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.schema)
        names = [n for n in shape.names if n != AGAIN]
        files, _ = filesystem(self.path)
        with files.open_input_file(partition.file) as f:
            for b in pq.ParquetFile(f).iter_batches(row_groups=list(partition.groups), columns=list({*names, self.key}), batch_size=10_000):
                n = b[self.key]
                b = b.filter(pc.and_(pc.greater(n, partition.low), pc.less_equal(n, partition.high)))
                again = pc.less_equal(b[self.key], partition.seen)
                if len(b):
                    yield pa.RecordBatch.from_arrays([again if c.name == AGAIN else b[c.name].cast(c.type) for c in shape], schema=shape)


class History(DataSource):
    """`spark.readStream.format("history").schema(...)`. Options: path, key (the column of the message number, from 0 up),
    initial, lookback (25), until (the history as it stood when that number was the last). The column `again`, if it is in
    the schema, tells rows that were read before. Rows without a number are left out."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def streamReader(self, schema: StructType) -> HistoryReader:
        return HistoryReader(schema, dict(self.options))
