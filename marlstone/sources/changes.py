"""A stream of what changes in a tree of files: a Python data source whose offsets are numbered snapshots of the tree.

    spark.dataSource.register(TreeChanges)
    spark.readStream.format("tree_changes").option("path", folder).option("snapshots", state).load()

Rows are path, change (created, changed or deleted), modified, length, and text (null for what is deleted). A snapshot lists path, time of change and length of
every file that fits `pattern`; it is written to the folder `snapshots`, and the offset is its number, so that a query that starts again from its
checkpoint finds what changed, and what was deleted, while it was not running. Files that are there when a stream is first started are not told of.
With `debounce` seconds, a snapshot is given out once the tree has stayed as it is for so long: changes that come in a burst are one batch.

Paths may be in any store that pyarrow reads. Listing is done by the driver's planner; texts are read by tasks, in partitions of `files_per_partition`.
"""

from __future__ import annotations

import fnmatch
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as stores
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

COLUMNS = "path string, change string, modified double, length bigint, text string"
Snapshot = dict[str, tuple[float, int]]


def opened(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path else (stores.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, pattern: str = "*.sql") -> Snapshot:
    """Time of change and length of the files below a path."""
    store, top = opened(path)
    found = store.get_file_info(stores.FileSelector(top, allow_not_found=True, recursive=True))
    return {f.path: (f.mtime_ns / 1e9 if f.mtime_ns else 0.0, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern)}


def compared(before: Snapshot, after: Snapshot) -> list[tuple[str, str]]:
    """(path, change) of what two snapshots differ in, by path."""
    gone = [(p, "deleted") for p in before if p not in after]
    return sorted(gone + [(p, "changed" if p in before else "created") for p, told in after.items() if before.get(p) != told])


@dataclass
class Part(InputPartition):
    rows: list[tuple[str, str, float | None, int | None]]


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.folder = options["path"], options["snapshots"]
        self.pattern, self.debounce = options.get("pattern", "*.sql"), float(options.get("debounce", 0))
        self.size = int(options.get("files_per_partition", 200))
        self.last: int | None = None
        self.waiting: tuple[Snapshot, float] | None = None

    def _name(self, n: int) -> str:
        return f"{opened(self.folder)[1].rstrip('/')}/snapshot-{n:010d}.json"

    def kept(self, n: int) -> Snapshot:
        with opened(self.folder)[0].open_input_stream(self._name(n)) as f:
            return {p: tuple(told) for p, told in json.loads(f.readall()).items()}

    def keep(self, n: int, snapshot: Snapshot) -> dict:
        store, top = opened(self.folder)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{self._name(n)}.part") as f:
            f.write(json.dumps(snapshot, sort_keys=True).encode())
        store.move(f"{self._name(n)}.part", self._name(n))
        self.last = n
        return {"n": n}

    def _newest(self) -> int:
        """The number of the last snapshot; the first one is taken where there is none."""
        store, top = opened(self.folder)
        found = store.get_file_info(stores.FileSelector(top, allow_not_found=True))
        numbers = [int(f.base_name[9:-5]) for f in found if f.base_name.startswith("snapshot-") and f.base_name.endswith(".json")]
        return max(numbers) if numbers else self.keep(0, listed(self.path, self.pattern))["n"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": self._newest()}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.last is None:  # Spark may ask this first; of a query that is started again, the newest one is the last that was given out
            self.last = self._newest()
        now, at = listed(self.path, self.pattern), time.monotonic()
        if now == self.kept(self.last):
            self.waiting = None
            return {"n": self.last}
        if self.waiting is None or self.waiting[0] != now:
            self.waiting = (now, at)
        if at - self.waiting[1] < self.debounce:
            return {"n": self.last}
        self.waiting = None
        return self.keep(self.last + 1, now)

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after = self.kept(end["n"])
        rows = [(p, change, *after.get(p, (None, None))) for p, change in compared(self.kept(start["n"]), after)]
        return [Part(rows[k : k + self.size]) for k in range(0, len(rows), self.size)]

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for path, change, modified, length in partition.rows:
            text = None
            if change != "deleted":
                try:
                    with store.open_input_stream(path) as f:
                        text = f.readall().decode("utf-8", "replace")
                except FileNotFoundError:  # gone since: the next snapshot tells of it
                    change, modified, length = "deleted", None, None
            yield path, change, modified, length, text

    def commit(self, end: dict) -> None:
        """Snapshots before the last one that was handled are needed no more."""
        store, top = opened(self.folder)
        for f in store.get_file_info(stores.FileSelector(top)):
            if f.base_name.startswith("snapshot-") and f.base_name.endswith(".json") and int(f.base_name[9:-5]) < end["n"]:
                store.delete_file(f.path)


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader(dict(self.options))
