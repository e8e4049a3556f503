"""Recorded state: snapshots of small tables in a folder, and numbered pointer files of which the last one holds.

A snapshot is published by making the pointer that follows the one its run began with, which can be made once only: a run whose lock was taken
over, however late it comes, can't publish over what another one has published since.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CATALOG

TABLES = {
    "state": "object_type string, object_name string, ddl_hash string, ddl string, trigger_table string, last_applied timestamp",
    "migrations": "name string, applied_at timestamp",
    "dependencies": "dependent_type string, dependent_name string, dependency_type string, dependency_schema string, dependency_name string, dependency_kind string",
    "catalog": CATALOG,
    "events": "channel string, payload string, emitted_at timestamp",
}
#: Bytes that an event's payload may have.
MOST_PAYLOAD = 7900
#: Seconds after which a lock that its holder has not renewed may be taken over.
LEASE = 20.0


class LockTimeout(TimeoutError):
    """Another run holds the state's lock."""


class LockLost(RuntimeError):
    """The lock was taken over while this run held it; nothing was published."""


class StateStore:
    """The state of one project in a folder of a file system that its users share. All tables are small."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.held: Path | None = None
        self.base: int | None = None  # the generation when the lock was taken

    @property
    def generation(self) -> int:
        """The number of the last pointer; 0 where nothing is published."""
        return max((int(p.name.rpartition(".")[2]) for p in self.folder.glob("CURRENT.*")), default=0)

    @property
    def current(self) -> str | None:
        n = self.generation
        return self._pointer(n).read_text().strip() if n else None

    def _pointer(self, n: int) -> Path:
        return self.folder / f"CURRENT.{n:08d}"

    @property
    def fresh(self) -> bool:
        return self.current is None

    def table(self, name: str) -> DataFrame:
        if self.current is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(str(self.folder / self.current / name))  # the folder of a clone's snapshot is its template's

    def clone(self, folder: str) -> StateStore:
        """A state of its own that begins with this one's snapshot. Snapshots never change, so nothing is copied."""
        if self.current is None:
            raise ValueError("there is no state to clone")
        found = StateStore(self.spark, folder)
        part = found.folder / f".CURRENT-{uuid.uuid4().hex}"
        part.write_text(str((self.folder / self.current).absolute()))
        try:
            os.link(part, found._pointer(1))
        except FileExistsError:
            raise ValueError(f"{folder} has a state already") from None
        finally:
            part.unlink()
        return found

    def hash_of(self, kind: str, name: str) -> str | None:
        """The recorded hash of one object, or None."""
        row = self.table("state").filter((F.col("object_type") == kind) & (F.col("object_name") == name)).select("ddl_hash").first()
        return None if row is None else row["ddl_hash"]

    def publish(self, tables: dict[str, DataFrame], told: Callable[[str], None] = lambda name: None) -> None:
        """Write a whole new snapshot, then make its pointer: readers see all of it or none. told hears its name before it is published."""
        name, base = f"snapshot-{uuid.uuid4().hex}", self.generation if self.base is None else self.base
        for table, schema in TABLES.items():
            frame = tables.get(table)
            frame = self.table(table) if frame is None else frame
            frame = frame.select([c.split(" ")[0] for c in schema.split(", ")]).coalesce(1)
            frame = frame.sortWithinPartitions("object_type", "name") if table == "catalog" else frame
            frame.write.parquet(str(self.folder / name / table))
        part = self.folder / f".CURRENT-{uuid.uuid4().hex}"
        part.write_text(name)
        if self.held is not None and not self.owned(self.held):
            part.unlink()
            raise LockLost("another run has taken the lock over")
        told(name)
        try:
            os.link(part, self._pointer(base + 1))
        except FileExistsError:
            raise LockLost("another run has published since this one began") from None
        finally:
            part.unlink()
        if self.base is not None:
            self.base += 1
        for old in self.folder.glob("CURRENT.*"):  # the last two are enough for those who read now
            if int(old.name.rpartition(".")[2]) < base:
                old.unlink(missing_ok=True)

    def emit(self, channel: str, payload: dict) -> None:
        """Record an event at once, apart from the snapshots."""
        text = json.dumps(payload, sort_keys=True)
        if len(text.encode()) > MOST_PAYLOAD:
            raise ValueError("an event's payload is too large")
        with (self.folder / "events.jsonl").open("a") as f:
            f.write(json.dumps({"channel": channel, "payload": text, "emitted_at": time.time()}) + "\n")

    def emitted(self) -> list[dict]:
        path = self.folder / "events.jsonl"
        return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []

    def owned(self, mine: Path) -> bool:
        """Whether the lock is this holder's file."""
        try:
            return os.path.samefile(mine, self.folder / "LOCK")
        except FileNotFoundError:
            return False

    def _take(self, mine: Path, stale: str | None) -> bool:
        """Make the lock a link to mine: where there is none, or in place of a stale holder's, of whom a mark can be made only once."""
        path = self.folder / "LOCK"
        try:
            if stale is None:
                os.link(mine, path)
                return True
            os.close(os.open(self.folder / f".LOCK-{stale}-gone", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        part = mine.with_name(f"{mine.name}-in")
        os.link(mine, part)
        os.replace(part, path)
        return True

    @contextmanager
    def lock(self, limit: float = 30.0, retry: float = 1.0, lease: float = LEASE):
        """Hold the state alone; LockTimeout after limit seconds.

        The holder renews its lock while it works. One that has not changed for lease seconds, by the clock of the run that waits, is taken
        over, on whatever machine its holder was; a holder that comes back late can publish nothing (LockLost).
        """
        token, began, seen = uuid.uuid4().hex, time.monotonic(), (None, 0.0)
        path, mine = self.folder / "LOCK", self.folder / f".LOCK-{token}"
        mine.write_text(token)
        done = threading.Event()
        try:
            while not self._take(mine, None):
                try:
                    state = (path.read_text(), path.stat().st_mtime_ns)
                except FileNotFoundError:
                    continue
                if state != seen[0]:
                    seen = (state, time.monotonic())
                elif time.monotonic() - seen[1] >= lease and self._take(mine, state[0]):
                    break
                if time.monotonic() - began >= limit:
                    raise LockTimeout(f"another run has held the lock for {limit:g} s")
                time.sleep(min(retry, max(0.01, limit - (time.monotonic() - began))))

            def renew() -> None:
                while not done.wait(lease / 4):
                    os.utime(mine)

            self.held, self.base = mine, self.generation
            threading.Thread(target=renew, daemon=True).start()
            yield
        finally:
            done.set()
            self.held = self.base = None
            if self.owned(mine):
                path.unlink(missing_ok=True)
            mine.unlink(missing_ok=True)
