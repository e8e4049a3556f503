"""Watching a tree of SQL files: changes are gathered until they pause, then planned, applied and tested.

Spark's file source tells of new files only; sources/changes.py gives changed and removed ones too, debounced, as a stream. files_stream gives new files
to those who want just these.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tap import impacted, parse_tap, touched
from ..plans.applying import ApplyError, ApplyResult, apply_plan
from ..plans.planning import Plan, PlanError, make_plan
from ..sources.changes import TreeChanges
from ..sources.parsed import ParsedStore
from ..sources.scan import TEST_MARK, read_files, test_dependencies
from ..sources.state import LockTimeout, StateStore

DEBOUNCE, POLL = 0.5, 0.1


@dataclass
class Batch:
    """What one pause in the changes led to."""

    migrations: set[str]
    tests: set[str]
    code: set[str]
    plan: Plan | None = None
    result: ApplyResult | None = None
    impacted: list[str] = field(default_factory=list)
    error: str | None = None


def routed(paths: set[str], migrations: str | None) -> Batch:
    """Migrations are told of only; tests are run; the rest is planned."""
    in_migrations = {p for p in paths if migrations and f"/{migrations.strip('/')}/" in p}
    tests = {p for p in paths - in_migrations if TEST_MARK in p.rsplit("/", 1)[-1]}
    return Batch(in_migrations, tests, paths - in_migrations - tests)


def test_edges(spark: SparkSession, folder: str) -> DataFrame:
    """file, kind, name of everything that the tests of a tree may touch."""
    rows = [(r["file"], c, str(i)) for r in read_files(spark, folder, "*.test.sql").collect() for c, i in test_dependencies(r["text"]).rows()]
    return touched(spark.createDataFrame(rows, "file string, dep_class string, name string"))


def impacted_tests(spark: SparkSession, folder: str, changed: list[tuple[str, str]]) -> list[str]:
    found = impacted(test_edges(spark, folder), spark.createDataFrame(changed, "kind string, name string"))
    return sorted(r["file"] for r in found.collect())


def process(spark: SparkSession, store: StateStore, folder: str, batch: Batch, auto_apply: bool = True, parsed: ParsedStore | None = None) -> Batch:
    """Plan and, if wanted, apply the code that changed, and find the tests to run. Errors are kept, not raised."""
    changed: list[tuple[str, str]] = []
    if batch.code:
        try:
            with store.lock() if auto_apply else nullcontext():
                batch.plan = make_plan(spark, store, folder, parsed=parsed)
                changed = [(c.object_type, c.name) for c in batch.plan.changes if c.type in ("create", "update")]
                if auto_apply:
                    batch.result = apply_plan(spark, store, batch.plan)
        except (PlanError, ApplyError, LockTimeout) as e:
            batch.error = str(e)
    found = impacted_tests(spark, folder, changed) if changed else []
    batch.impacted = sorted({*found, *batch.tests})
    return batch


def watched(spark: SparkSession, store: StateStore, folder: str, on_batch: Callable[[Batch], None], migrations: str | None = None, auto_apply: bool = True, debounce: float = DEBOUNCE, poll: float = POLL) -> StreamingQuery:
    """A running query that hands every pause in the changes of a tree to on_batch, planned against what is parsed already.

    Its checkpoint and snapshots stand beside the state, so that a query that is started again goes on where the last one ended.
    """
    own = f"{store.folder.absolute()}/watch"
    parsed = ParsedStore(spark, f"{own}/parsed")
    spark.dataSource.register(TreeChanges)
    changes = spark.readStream.format("tree_changes").option("path", str(Path(folder).absolute())).option("snapshots", f"{own}/snapshots").option("debounce", str(debounce)).load()

    def handle(rows: DataFrame, _: int) -> None:
        paths = {r["path"] for r in rows.select("path").distinct().collect()}  # of the files that changed
        if paths:
            on_batch(process(spark, store, folder, routed(paths, migrations), auto_apply, parsed))

    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", f"{own}/checkpoint").trigger(processingTime=f"{int(poll * 1000)} milliseconds").start()


def watch(spark: SparkSession, store: StateStore, folder: str, on_batch: Callable[[Batch], None], migrations: str | None = None, auto_apply: bool = True, debounce: float = DEBOUNCE, poll: float = POLL, until: Callable[[], bool] = lambda: False) -> None:
    """Watch until told to stop."""
    query = watched(spark, store, folder, on_batch, migrations, auto_apply, debounce, poll)
    try:
        while not until() and not query.awaitTermination(max(1, round(poll))):
            pass
    finally:
        query.stop()


def files_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new files: file, text."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.sql").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def run_test(spark: SparkSession, text: str):
    """Run a test's statements; the first column of every row of their results is its output. Client commands are refused."""
    from ..functions.sqltext import split_statements

    if any(line.lstrip().startswith("\\") for line in text.split("\n")):
        raise ValueError("commands of a client (\\...) are not SQL")
    lines: list[str] = []
    for s in split_statements(text):
        if s.sql.split(None, 1)[0].rstrip(";").lower() not in ("begin", "commit", "rollback"):
            lines += [str(r[0]) for r in spark.sql(s.sql).collect() if len(r) and r[0] is not None]
    return parse_tap(lines)
