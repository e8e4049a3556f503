"""Plans: what has to change for the recorded state to become what files define."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.idents import KINDS, Ident
from ..functions.sqltext import SqlSyntaxError, split_statements
from ..operators import diff, graph, severity
from ..operators.storage import stored
from ..sources.catalog import result_type
from ..sources.parsed import ParsedStore
from ..sources.scan import UNREAD, as_object, builtins, dependencies_of, objects_of, read_files, scan_migrations, scan_objects
from ..sources.state import StateStore

#: Kinds that may not be defined twice under one name.
UNIQUE_KINDS = tuple(k for k in KINDS if k not in ("operator", "comment", "cron_job"))


class PlanError(ValueError):
    """Files that cannot be planned: doubled names, unsafe deletions."""


@dataclass
class Change:
    type: str
    object_type: str | None = None
    name: str | None = None
    old_hash: str | None = None
    new_hash: str | None = None
    reason: str | None = None
    rank: int = severity.BREAKING
    migration: str | None = None

    @property
    def node(self) -> str:
        return f"{self.object_type}::{self.name}"

    def json(self) -> dict:
        return {"type": self.type, "object_type": self.object_type, "object_name": self.name, "old_hash": self.old_hash, "new_hash": self.new_hash, "reason": self.reason, "severity": severity.LABELS[self.rank], "migration": self.migration}


@dataclass
class Plan:
    changes: list[Change]
    objects: dict[str, dict]  # file objects by node
    recorded: dict[str, dict]  # state rows by node
    deps: DataFrame
    edges: DataFrame  # for ordering: of new and recorded dependencies
    new_migrations: list[tuple[str, str]]
    problems: list[str] = field(default_factory=list)

    @property
    def worst(self) -> str:
        return severity.LABELS[max((c.rank for c in self.changes), default=severity.SAFE)]

    def json(self) -> str:
        counts = {name: sum(c.rank == k for c in self.changes) for k, name in enumerate(severity.LABELS)}
        nodes = {x for r in self.edges.select("src", "dst").collect() for x in r} | set(self.objects)
        return json.dumps({"changes": [c.json() for c in self.changes], "new_migrations": [n for n, _ in self.new_migrations], "severity": self.worst, "severity_counts": counts, "dependency_graph": {"node_count": len(nodes), "edge_count": self.edges.count()}}, indent=2)

    def report(self) -> str:
        """The plan as text: a line a change, parents before their comments."""
        signs = {"create": "+", "update": "~", "delete": "-", "apply_migration": ">"}
        lines = [f"{signs[c.type]} {c.migration or f'{c.object_type} {c.name}'} [{severity.LABELS[c.rank]}]" + (f" ({c.reason})" if c.reason else "") + (f" {(c.old_hash or '')[:8]}->{(c.new_hash or '')[:8]}" if c.type == "update" else "") for c in self.changes]
        return "\n".join([*(lines or ["no changes"]), f"severity: {self.worst}"])


def node(kind: str = "object_type", name: str = "state_name"):
    return F.concat_ws("::", kind, name)


def rank_of(spark: SparkSession, change: Change, old: dict | None, new: dict | None, returns: dict[str, str]) -> int:
    if change.type == "create" or change.object_type in severity.UNNOTICED:
        return severity.SAFE
    if change.type == "delete" or change.object_type == "table" or not old or not old["ddl"]:
        return severity.BREAKING
    a, b = as_object(old), as_object(new)
    shapes = None
    if a.kind in ("view", "materialized_view"):
        try:
            shapes = tuple([(c or f.name, f.dataType) for c, f in zip((*o.details["columns"], *[None] * 999), spark.sql(o.ddl[o.details["from"] :]).schema, strict=False)] for o in (a, b))
        except Exception:  # a body that Spark cannot analyse: the shape is unknown
            shapes = None
    found = severity.rank_of_update(a, b, shapes, returns)
    return severity.BREAKING if found is None else found


def make_plan(spark: SparkSession, store: StateStore, code: str | DataFrame | None, migrations: str | None = None, parsed: ParsedStore | None = None) -> Plan:
    """Compare a code tree (a folder, or a frame of file and text) and a folder of migrations with recorded state.

    With a store of parsed objects, only what has changed in the folder is read and parsed.
    """
    rows = stored(objects_of(code) if isinstance(code, DataFrame) else scan_objects(spark, code) if parsed is None else parsed.rows(code))
    objects = rows.filter("object_type is not null")
    problems = [f"{r['file']}: {r['problem']}" for r in rows.filter("problem is not null").orderBy("seq").collect()]
    if unread := [p for p in problems if p.partition(": ")[2].startswith(UNREAD)]:
        raise PlanError("; ".join(unread))
    doubled = diff.duplicates(objects.filter(F.col("object_type").isin(*UNIQUE_KINDS)).withColumn("name", F.concat_ws(".", "schema", "name", F.when(F.col("object_type") == "trigger", F.col("trigger_table")))).withColumn("file", F.concat_ws(":", "file", "start_line"))).collect()
    if doubled:
        raise PlanError("defined more than once: " + "; ".join(f"{r['name']} in {r['places']}" for r in doubled))
    state, recorded_deps = store.table("state"), store.table("dependencies")
    found = objects.select("object_type", "state_name", "ddl_hash")
    had = state.select("object_type", F.col("object_name").alias("state_name"), "ddl_hash")
    order = {r["n"]: r["seq"] for r in objects.select(node().alias("n"), "seq").collect()}
    raw = sorted(diff.changes(found, had, ["object_type", "state_name"]).collect(), key=lambda r: (r["type"] != "delete", order.get(f"{r['object_type']}::{r['state_name']}", ""), r["object_type"], r["state_name"]))
    new_migrations = []
    if migrations is not None:
        new_migrations = [(r["name"], r["text"]) for r in diff.pending(scan_migrations(spark, migrations), store.table("migrations")).orderBy("name").collect()]
    changes = [Change("apply_migration", migration=n, rank=severity.rank_of_migration(t)) for n, t in new_migrations]
    for n, t in new_migrations:  # it is rated breaking, and alters no table as far as is known
        try:
            split_statements(t)
        except SqlSyntaxError as e:
            problems.append(f"migration {n}: cannot be split: {e}")
    changes += [Change(r["type"], r["object_type"], r["state_name"], r["old_hash"], r["new_hash"]) for r in raw]
    deps = stored(dependencies_of(rows, builtins(spark)))
    by_node = {f"{r['object_type']}::{r['state_name']}": r.asDict() for r in objects.collect()}
    recorded = {f"{r['object_type']}::{r['object_name']}": r.asDict() for r in state.collect()}
    going = {c.node for c in changes if c.type == "delete"}
    for c in changes:  # a name may not be a function and a procedure at once
        other = {"function": "procedure", "procedure": "function"}.get(c.object_type)
        if c.type == "create" and other and f"{other}::{c.name}" in recorded and f"{other}::{c.name}" not in going:
            raise PlanError(f"{c.object_type} {c.name}: a {other} of this name is there already")
    deleted = [c for c in changes if c.type == "delete"]
    old_objects = state.select("object_type", F.col("object_name").alias("state_name"), F.when(F.locate(".", "object_name") > 0, F.split_part("object_name", F.lit("."), F.lit(1))).alias("schema"), F.element_at(F.split("object_name", r"\."), -1).alias("name"), "trigger_table").withColumn("seq", F.lit("\U0010ffff"))
    columns = ["object_type", "state_name", "schema", "name", "trigger_table", "seq"]
    gone = old_objects.join(found.select("object_type", "state_name"), ["object_type", "state_name"], "left_anti")
    everything = objects.select(columns).union(gone.select(columns))
    validation = graph.edges_of(everything, deps)
    if deleted:
        bad = graph.unsafe_deletions(validation, spark.createDataFrame([(c.node,) for c in deleted], "node string"), objects.select(node().alias("node"))).orderBy("src", "dst").collect()
        if bad:
            raise PlanError("still needed: " + "; ".join(f"{r['src']} by {r['dst']}" for r in bad))
    old_deps = recorded_deps.select(F.col("dependent_type").alias("object_type"), F.col("dependent_name").alias("state_name"), F.col("dependency_type").alias("dep_class"), F.col("dependency_schema").alias("dep_schema"), F.col("dependency_name").alias("dep_name"))
    edges = graph.edges_of(everything, deps.union(old_deps).distinct())
    listed = {c.node for c in changes if c.object_type}

    def add(reached: list[str], reason: str) -> None:
        for n in sorted(reached, key=lambda x: order.get(x, "")):
            if n in by_node and n not in listed:
                r = by_node[n]
                changes.append(Change("update", r["object_type"], r["state_name"], recorded.get(n, {}).get("ddl_hash"), r["ddl_hash"], reason))
                listed.add(n)

    altered = sorted({t for _, text in new_migrations for t in severity.altered_tables(text)})
    if altered:
        names = spark.createDataFrame([(t,) for t in altered], "spelled string")
        spelled = old_deps.filter("dep_class = 'relation'").withColumn("spelled", F.concat_ws(".", "dep_schema", "dep_name"))
        add([r["n"] for r in spelled.join(names, "spelled", "left_semi").select(node().alias("n")).distinct().collect()], "Migration alters dependent table")
    updated = [c.node for c in changes if c.type == "update"]
    if updated:
        add([r["node"] for r in graph.closure(edges, spark.createDataFrame([(n,) for n in updated], "node string"), most_local=graph.FEW).collect()], "Dependency requires recreation")
    behind = {str(as_object(r[c.node]).details["procedure"]) for c in changes if c.object_type == "operator" and c.type == "update" for r in (recorded, by_node) if r[c.node]["ddl"]}
    returns = {p: t for p in behind for t in [result_type(store.table("catalog"), Ident.parse(p).name, Ident.parse(p).schema)] if t}
    for c in changes:
        if c.object_type:
            c.rank = rank_of(spark, c, recorded.get(c.node), by_node.get(c.node), returns)
    return Plan(changes, by_node, recorded, deps, edges, new_migrations, problems)


def ordered(spark: SparkSession, plan: Plan, nodes: list[str]) -> tuple[list[str], str | None]:
    """nodes with dependencies first, ties in plan order; a circle keeps the plan's order and gives a warning."""
    if len(nodes) < 2:
        return nodes, None
    every = spark.createDataFrame([(n,) for n in {*nodes, *plan.objects, *plan.recorded}], "node string")
    try:
        level = {r["node"]: r["level"] for r in graph.levels(every, plan.edges, graph.FEW).collect()}
    except graph.CycleError as e:
        return nodes, str(e)
    return sorted(nodes, key=lambda n: level.get(n, 1 << 30)), None


def pending_changes(spark: SparkSession, store: StateStore, code: str, migrations: str | None = None, parsed: ParsedStore | None = None) -> tuple[bool, int]:
    """Whether anything has changed, and how much, without graphs and severities."""
    rows = scan_objects(spark, code) if parsed is None else parsed.rows(code)
    found = rows.filter("object_type is not null").select("object_type", "state_name", "ddl_hash")
    had = store.table("state").select("object_type", F.col("object_name").alias("state_name"), "ddl_hash")
    n = diff.changes(found, had, ["object_type", "state_name"]).count()
    if migrations is not None:
        n += diff.pending(scan_migrations(spark, migrations), store.table("migrations")).count()
    return n > 0, n


def content_checksum(files: DataFrame) -> str:
    """One digest over the names and texts of files (file, text): whether a prepared copy is still good.

    Each file has a digest of its own; of these, sums of parts that do not depend on an order are taken, so that texts stay where they are.
    """
    own = files.select(F.sha2(F.concat_ws("\x01", F.element_at(F.split("file", "/"), -1), "text"), 256).alias("d"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("d", k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(1, 64, 12)]
    return own.agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *parts), 256).alias("sum")).first()["sum"]


def prepared(spark: SparkSession, templates: str, folder: str, code: str, build: Callable[[StateStore], object]) -> tuple[StateStore, bool]:
    """A state for a code tree, cloned from the template that stands for its content, and whether the template was there: where it is not, build fills it first."""
    store = StateStore(spark, f"{templates}/{content_checksum(read_files(spark, code))}")
    there = not store.fresh
    if not there:
        build(store)  # under its own lock: of two that build at once, the second one finds nothing to do
    return store.clone(folder), there
