"""Live files that grow: a streaming data source over byte offsets.

Progress is a position per file, and a file is known by device and inode, so one that is renamed within the pattern
goes on where it was. A file starts again at its first byte if it is another one (another inode), was cut shorter,
or no longer begins as it did (an inode given away anew). Only whole lines are delivered; the rest of a line waits for its
end. What a batch covers follows from its two offsets alone, so a batch that is run again has the same lines.

The driver looks at the files' ends; executors read them, in splits of ``split_bytes``, so the files must lie on a file
system that all of them mount. A task reads several splits or files where there are more than enough of them for ``tasks`` tasks, up to 64 MiB. Object stores know no appends: use ``objects`` there. The offset names every file of the
pattern, some 250 bytes each.

A file that is renamed out of the pattern loses what was added to it after the last batch; a pattern that covers the
rotated names as well (``app.log*``) keeps it. A file that is gone between planning and reading ends the
query, unless ``fail_on_loss`` is off.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT = 64 << 20
_BLOCK = 1 << 16  # bytes looked at in one go for the last line end
_HEAD = 64  # first bytes by which a file is known again
_OPEN = 1 << 14  # bytes that opening a file counts as
TASKS = 48  # that a batch is dealt to at least, if it has as many splits
_ROWS, _BYTES = 10_000, 4 << 20  # of one batch for Spark


def local_path(path: str) -> str:
    """A path of the mounted file systems; other schemes have no growing files."""
    plain = re.sub(r"^file:(//)?(?=/)", "", path)
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", plain):
        raise ValueError(f"Only files of a mounted file system grow: {path}")
    return plain


@dataclass
class Stretch:
    """Bytes ``start`` to ``stop`` of a file; whole lines from ``first`` on, each to the stretch that it begins in."""

    path: str
    file: str
    first: int
    start: int
    stop: int


@dataclass
class Share(InputPartition):
    """What one task reads."""

    stretches: list[Stretch]


class GrowingFiles(DataSource):
    """``value``, ``path``, ``file`` (device and inode) and ``position`` (in bytes) of each line."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "value binary, path string, file string, position bigint"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.path = local_path(given["path"])
        self.from_start = given.get("read_from_start", "false").lower() == "true"
        self.split = int(given.get("split_bytes", SPLIT))
        self.tasks = int(given.get("tasks", TASKS))
        self.strict = given.get("fail_on_loss", "true").lower() == "true"
        self.ends: dict[str, tuple[int, int]] = {}  # size and last line end, of files as last seen

    def initialOffset(self) -> dict:
        return {} if self.from_start else self.latestOffset()

    def latestOffset(self) -> dict:
        offset, ends = {}, {}
        for path in _listed(self.path):
            try:
                with open(path, "rb") as file:
                    stat = os.fstat(file.fileno())
                    key = _key(stat)
                    size, end = self.ends.get(key, (-1, 0))
                    if size != stat.st_size:
                        end = _last_line_end(file, stat.st_size)
                    file.seek(0)
                    head = file.read(min(end, _HEAD)).hex()
            except FileNotFoundError:
                continue
            ends[key] = (stat.st_size, end)
            offset[key] = {"path": path, "end": end, "head": head}
        self.ends = ends
        return offset

    def partitions(self, start: dict, end: dict) -> list[Share]:
        stretches = self._stretches(start, end)
        costs = [s.stop - s.start + _OPEN for s in stretches]
        most = min(-(-sum(costs) // self.tasks), SPLIT)
        shares, held = [], 0
        for stretch, cost in zip(stretches, costs):
            if not shares or held + cost > most:
                shares.append(Share([]))
                held = 0
            shares[-1].stretches.append(stretch)
            held += cost
        return shares

    def _stretches(self, start: dict, end: dict) -> list[Stretch]:
        stretches = []
        for key, now in end.items():
            before = start.get(key, {"end": 0, "head": ""})
            same = before["end"] <= now["end"] and now["head"].startswith(before["head"])
            first = before["end"] if same else 0
            for at in range(first, now["end"], self.split):
                stretches.append(Stretch(now["path"], key, first, at, min(at + self.split, now["end"])))
        return stretches

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for stretch in partition.stretches:
            yield from self._read(stretch)

    def _read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        path = _find(partition.path, partition.file)
        if path is None:
            if self.strict:
                raise FileNotFoundError(f"{partition.path} is gone or another file, bytes {partition.start} to {partition.stop} are lost")
            return
        with open(path, "rb") as file:
            at = partition.start
            if at > partition.first:  # the line that is going on here belongs to the stretch before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            else:
                file.seek(at)
            lines, positions, held = [], [], 0
            while at < partition.stop:
                line = file.readline()
                if not line:
                    break
                lines.append(line.rstrip(b"\n"))
                positions.append(at)
                at += len(line)
                held += len(line)
                if len(lines) == _ROWS or held > _BYTES:
                    yield _batch(partition, lines, positions)
                    lines, positions, held = [], [], 0
            if lines:
                yield _batch(partition, lines, positions)

    def commit(self, end: dict) -> None:
        """Nothing to tidy up: files belong to whoever writes them."""

    def stop(self) -> None:
        """Nothing is held open between batches."""


def _batch(partition: Stretch, lines: list[bytes], positions: list[int]) -> pa.RecordBatch:
    same = [pa.array([text] * len(lines), pa.string()) for text in (partition.path, partition.file)]
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), *same, pa.array(positions, pa.int64())], names=["value", "path", "file", "position"])


def _key(stat: os.stat_result) -> str:
    return f"{stat.st_dev}:{stat.st_ino}"


def _listed(path: str) -> list[str]:
    """The files a path names: itself, those in a folder, or those of a pattern."""
    if os.path.isdir(path):
        found = [os.path.join(path, name) for name in os.listdir(path)]
    else:
        found = [path] if os.path.exists(path) else glob.glob(path)
    return sorted(f for f in found if os.path.isfile(f))


def _find(path: str, key: str) -> str | None:
    """Where the file lies now: a rotation may have renamed it since the batch was planned."""
    folder = os.path.dirname(path) or "."
    names = os.listdir(folder) if os.path.isdir(folder) else []
    for candidate in [path, *sorted(os.path.join(folder, name) for name in names)]:
        try:
            if _key(os.stat(candidate)) == key:
                return candidate
        except FileNotFoundError:
            continue
    return None


def _last_line_end(file, size: int) -> int:
    """The byte after the last line end; 0 if there is none."""
    stop = size
    while stop > 0:
        start = max(0, stop - _BLOCK)
        file.seek(start)
        found = file.read(stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return 0


def growing_lines(
    spark: SparkSession, path: str, read_from_start: bool = False, split_bytes: int = SPLIT, fail_on_loss: bool = True
) -> DataFrame:
    """The lines of a live file, of all files in a folder or of a pattern, as a stream of ``GrowingFiles`` rows."""
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format(GrowingFiles.name()).option("path", local_path(path))
    tasks = max(TASKS, 4 * spark.sparkContext.defaultParallelism)
    return reader.options(read_from_start=read_from_start, split_bytes=split_bytes, fail_on_loss=fail_on_loss, tasks=tasks).load()
