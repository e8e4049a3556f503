"""Applying a plan in Spark, with all-or-nothing state.

Views become temporary views, materialized views stored tables behind a view, SQL functions of one expression temporary functions; what Spark cannot
run (types, domains, indexes, triggers, procedures, operators, comments, cron jobs, other functions) is recorded only. Migrations run in a
transaction (plans/transactions.py): when an apply fails, tables are as they were, and definitions of the last snapshot are made again. The first apply
of a project and tests of it run without one, as each statement stands by itself there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import SPARK_TYPES, as_spark, spark_type
from ..functions.idents import TARGETS, Ident
from ..functions.errors import told as told_of
from ..functions.identify import SqlObject, identify
from ..functions.lint import Finding, lint, report
from ..functions.routines import Untranslated, arguments, expression, inputs, script, statements_of
from ..functions.sqltext import split_statements, tokens
from ..operators import diff
from ..operators.folding import folded
from ..operators.severity import enum_additions
from ..operators.storage import stored
from ..sources.catalog import catalog_of
from ..sources.scan import as_object
from ..sources.state import StateStore
from .planning import Plan, make_plan, ordered
from .transactions import Transaction, opened, recover


class ApplyError(RuntimeError):
    """A plan that could not be applied; nothing of it was recorded."""


class MigrationError(RuntimeError):
    """A statement of a migration that failed."""

    def __init__(self, name: str, statement: int, line: int, message: str):
        super().__init__(f"migration {name}, statement {statement}, line {line}: {message}")
        self.name, self.statement, self.line, self.message = name, statement, line, message


@dataclass
class ApplyResult:
    migrations_applied: list[str] = field(default_factory=list)
    objects_created: list[str] = field(default_factory=list)
    objects_updated: list[str] = field(default_factory=list)
    objects_deleted: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    severity: str = "safe"


class Executor:
    """Makes and drops objects in a Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @staticmethod
    def spelled(name: str) -> str:
        return name.replace(".", "__").replace('"', "")

    def create(self, ddl: str) -> bool:
        """Whether Spark runs this definition."""
        o = identify(ddl)
        name = self.spelled(str(o.ident))
        if o.kind in ("view", "materialized_view"):
            body = as_spark(ddl[o.details["from"] :].rstrip().rstrip(";"))
            for r in sorted((r for r in o.dependencies.relations if r.schema), key=str):
                if self.spark.catalog.tableExists(self.spelled(str(r))):  # made here; others are the catalog's
                    body = re.sub(rf"\b{re.escape(r.schema)}\.{re.escape(r.name)}\b", self.spelled(str(r)), body)
            df = self.spark.sql(body)
            if o.details["columns"]:
                df = df.toDF(*o.details["columns"], *df.columns[len(o.details["columns"]) :])
            (stored(df) if o.kind == "materialized_view" else df).createOrReplaceTempView(f"`{name}`")
            return True
        if o.kind == "aggregate":
            given = {k.lower(): v.strip() for k, v in re.findall(r"(?i)\b(sfunc|stype|initcond|combinefunc|finalfunc)\s*=\s*('[^']*'|[\w.]+(?:\s+precision)?)", ddl)}
            self.aggregates()[name] = Aggregate(given.get("sfunc", ""), given.get("stype", ""), given["initcond"].strip("'") if "initcond" in given else None, given.get("combinefunc"), given.get("finalfunc"))
            return given.get("sfunc") in FOLDS or self.spelled(given.get("sfunc", "")) in self.routines()
        if o.kind == "operator" and o.details["procedure"]:
            self.operators()[str(o.ident)] = str(o.details["procedure"])
            return True
        if o.kind in ("function", "procedure"):
            self.routines()[name] = o
        if o.kind == "procedure" or o.kind == "function" and o.details["language"] == "plpgsql":
            return self._translated(o, name)
        if o.kind == "function" and o.details["language"] == "sql":
            body = (o.details["body"] or "").strip().rstrip(";")
            if re.match(r"(?is)select\b", body) and ";" not in body and all(a["name"] for a in o.details["args"]):
                kind = lambda text: SPARK_TYPES.get(text.removeprefix("pg_catalog."), "string")
                args = ", ".join(f"{a['name']} {kind(a['text'])}" for a in o.details["args"] if a["mode"] == "in")
                columns = ", ".join(f"{a['name']} {kind(a['text'])}" for a in o.details["args"] if a["mode"] == "table")
                if o.details["set"] and not columns:
                    return False
                simple = re.fullmatch(r"(?is)select\s+(.*)", body)[1]
                told = f"SELECT {as_spark(simple)}" if columns else as_spark(simple) if not re.search(r"(?i)\bfrom\b", simple) else f"({as_spark(body)})"
                self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {f'TABLE ({columns})' if columns else kind(o.details['returns'])} RETURN {told}")
                return True
        return False

    def _translated(self, o: SqlObject, name: str) -> bool:
        """Whether a procedure or PL/pgSQL function runs: as an expression that queries inline, or else as a script for each call."""
        try:
            if o.kind == "function":
                try:
                    value = expression(o)
                except Untranslated:  # it may have a script
                    value = None
                if value is not None and not o.details["set"] and all(a["name"] and a["mode"] == "in" for a in o.details["args"]):
                    args = ", ".join(f"{a['name']} {spark_type(a['text'])}" + (f" DEFAULT {''.join(t.text for t in a['default'])}" if a["default"] else "") for a in o.details["args"])
                    self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {spark_type(o.details['returns'])} RETURN {value}")
                    return True
                self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")  # of an older definition
            statements_of(o)
        except Untranslated:
            return False
        return True

    def call(self, sql: str) -> DataFrame:
        """CALL of a procedure, or of a function that only has a script, run once by SQL scripting."""
        toks = list(tokens(sql.strip().rstrip(";")))
        at = next((k for k, t in enumerate(toks) if t.text == "("), len(toks))
        name = "".join(t.text for t in toks[1:at])
        if toks[0].lower != "call" or self.spelled(name) not in self.routines() or at == len(toks):
            raise Untranslated(f"no routine {name} to call")
        o = self.routines()[self.spelled(name)]
        return self.spark.sql(script(o, arguments(o, toks[at:], sql.strip().rstrip(";"))))

    def _made(self, kind: str) -> dict:
        return MADE.setdefault(self.spark, {}).setdefault(kind, {})

    def routines(self) -> dict[str, SqlObject]:
        """Functions and procedures made in this session."""
        return self._made("routines")

    def aggregates(self) -> dict[str, Aggregate]:
        return self._made("aggregates")

    def operators(self) -> dict[str, str]:
        """The function behind each operator made in this session."""
        return self._made("operators")

    def aggregated(self, df: DataFrame, keys: list[str], aggregate: str, column: str, alias: str, order: list[str] | None = None) -> DataFrame:
        """df grouped by keys under an aggregate, by what its state function does (operators/folding.py), or Spark's own for built-in ones."""
        made = self.aggregates()[self.spelled(aggregate)]
        kind = df.schema[column].dataType
        if made.sfunc in FOLDS and not made.final:
            return df.groupBy(*keys).agg(FOLDS[made.sfunc](F.col(column), F.lit(made.first or None).cast(kind)).cast(kind).alias(alias))

        def inlined(function: str) -> Callable[..., str]:
            o = self.routines()[self.spelled(function)]
            return lambda *given: f"CAST(({expression(o, dict(zip([a['name'] for a in inputs(o)], given, strict=True)))}) AS {state if function != made.final else spark_type(o.details['returns'])})"

        state = spark_type(made.stype)
        first = "NULL" if made.first is None else f"'{made.first}'"
        known = {"combine": inlined(made.combine) if made.combine else None, "final": inlined(made.final) if made.final else None}
        return folded(df, keys, column, f"CAST({first} AS {state})", inlined(made.sfunc), order=order or [], **known).withColumnRenamed("value", alias)

    def applied(self, operator: str, left: Column | None, right: Column) -> Column:
        """An operator's function on its sides; a prefix operator has no left one."""
        return F.call_function(self.operators()[operator], *([] if left is None else [left]), right)

    def drop(self, kind: str, name: str) -> None:
        """What has a name and kind goes, whatever the signature that it was made with."""
        spelled = self.spelled(name)
        if kind in ("view", "materialized_view"):
            self.spark.catalog.dropTempView(spelled)
        elif kind == "function":
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {spelled}")
        for kinds, held, key in ((("function", "procedure"), self.routines(), spelled), (("aggregate",), self.aggregates(), spelled), (("operator",), self.operators(), name)):
            if kind in kinds:
                held.pop(key, None)


@dataclass(frozen=True)
class Aggregate:
    """State, combine and final function of an aggregate, its state's type and first state."""

    sfunc: str
    stype: str = ""
    first: str | None = None
    combine: str | None = None
    final: str | None = None


#: Routines, aggregates and operators that were made, by session; they end with it.
MADE: WeakKeyDictionary[SparkSession, dict[str, dict]] = WeakKeyDictionary()
#: State functions whose states of parts can be put together, with the first state: fixed names.
FOLDS = {
    **dict.fromkeys(("int4pl", "int8pl", "float8pl", "numeric_add"), lambda x, first: F.coalesce(F.sum(x), F.lit(0)) + F.coalesce(first, F.lit(0))),
    **dict.fromkeys(("int4larger", "int8larger", "float8larger", "text_larger"), lambda x, first: F.greatest(F.max(x), first)),
    **dict.fromkeys(("int4smaller", "int8smaller", "float8smaller", "text_smaller"), lambda x, first: F.least(F.min(x), first)),
}
def bound(o: SqlObject, sql: str) -> str:
    """A statement of an object's body in Spark's dialect, with the parameters that it names standing as nulls of their types."""
    args = [a for a in o.details.get("args", ()) if a["name"] and a["mode"] in ("in", "inout", "variadic")]
    if not args or not re.match(r"(?is)\s*(select|with)\b", sql):
        return as_spark(sql)
    given = ", ".join(f"CAST(NULL AS {SPARK_TYPES.get(a['text'].removeprefix('pg_catalog.'), 'string')}) AS `{a['name']}`" for a in args)
    return f"SELECT 1 FROM (SELECT {given}) AS given, LATERAL ({as_spark(sql)}) AS body"


def findings_of(spark: SparkSession, plan: Plan, made: list[str]) -> list[Finding]:
    """What is found in the objects that were made, and errors of the routines that only call them and were not made again."""
    calls = plan.edges.filter("kind = 'soft'").join(spark.createDataFrame([(n,) for n in made] or [("",)], "src string"), "src", "left_semi")
    callers = sorted({r["dst"] for r in calls.select("dst").distinct().collect()} - set(made))
    read_one = lambda n: lint(spark, as_object(plan.objects[n]), ready=bound)
    return [f for n in made for f in read_one(n)] + [f for n in callers if n in plan.objects for f in read_one(n) if f.level == "error"]


def apply(spark: SparkSession, store: StateStore, code, migrations: str | None = None, lock_limit: float = 30.0, development: bool = False, gate: bool = False, transactional: bool | None = None) -> ApplyResult:
    """Plan and apply under the state's lock; what a lost run has left behind is undone first."""
    with store.lock(lock_limit):
        left = recover(spark, store.folder, store.current)
        result = apply_plan(spark, store, make_plan(spark, store, code, migrations), development, gate, transactional)
        result.warnings += [f"migrations of a run that was lost were {how}" for how in left]
        return result


def migrate(spark: SparkSession, name: str, text: str, work: Transaction | None) -> list[str]:
    """Run a migration's statements, in a transaction if there is one; its warnings. An error says which statement it was, and where."""
    warnings = []
    early = dict(enum_additions(text))
    for k, s in enumerate(split_statements(text), 1):
        if s.sql in early:  # Spark has no enum types: the label is told, as nothing runs
            warnings.append(f"recorded only: {early[s.sql]}")
            continue
        try:
            if re.match(r"(?i)call\b", s.sql):
                Executor(spark).call(s.sql)
                if work is not None:
                    work.lasting.append(s.sql[:80])
            elif work is None:
                spark.sql(as_spark(s.sql))
            else:
                work.run(s.sql)
        except Exception as e:
            raise MigrationError(name, k, s.start_line, told_of(e, s.sql, None, s.start_line)) from e
    return warnings


def apply_plan(spark: SparkSession, store: StateStore, plan: Plan, development: bool = False, gate: bool = False, transactional: bool | None = None) -> ApplyResult:
    """Drop, migrate, create, in dependency order; then publish the new state at once.

    Migrations run in a transaction unless this is the first apply (or transactional is False). In development, a gate lints what was made and the
    routines that call it: errors end the apply before anything is published.
    """
    result, run = ApplyResult(severity=plan.worst, warnings=list(plan.problems)), Executor(spark)
    transactional = not store.fresh if transactional is None else transactional
    work = opened(spark, store.folder) if transactional and plan.new_migrations else None
    named = lambda c: {"object_type": c.object_type, "name": c.name}
    if not plan.changes:
        return result
    store.emit("apply_initiated", {"changes": len(plan.changes), "severity": plan.worst})
    by = {c.node: c for c in plan.changes if c.object_type}
    try:
        drops, warning = ordered(spark, plan, [n for n, c in by.items() if c.type != "create"])
        result.warnings += [warning] if warning else []
        for n in reversed(drops):
            run.drop(by[n].object_type, by[n].name)
            if by[n].type == "delete":
                result.objects_deleted.append(by[n].name)
        for name, text in plan.new_migrations:
            result.warnings += migrate(spark, name, text, work)
            result.migrations_applied.append(name)
        makes, warning = ordered(spark, plan, [n for n, c in by.items() if c.type != "delete"])
        result.warnings += [warning] if warning else []
        for n in makes:
            o = plan.objects[n]
            run.create(o["ddl"])
            shown = o["name"] if o["object_type"] == "trigger" else by[n].name
            (result.objects_created if by[n].type == "create" else result.objects_updated).append(shown)
            if development:
                store.emit("object_loaded", {**named(by[n]), "file": o["file"], "start_line": o["start_line"], "end_line": o["end_line"]})
        if development and gate:
            found = findings_of(spark, plan, makes)
            result.warnings += [report([f]) for f in found if f.level != "error"]
            if wrong := [f for f in found if f.level == "error"]:
                raise ApplyError("; ".join(report([f]) for f in wrong))
        told = (lambda snapshot: None) if work is None else work.publishing
        publish(spark, store, plan, [by[n] for n in makes], [c for c in by.values() if c.type == "delete"], told)
    except Exception as e:
        if work is not None:
            work.rollback()
        restore(run, plan, by)
        result.errors.append(str(e) if isinstance(e, MigrationError) else str(e).split("\n")[0])
        store.emit("apply_failed", {"error": "; ".join(result.errors)[:1000]})
        raise ApplyError("; ".join(result.errors)) from e
    if work is not None:
        result.warnings += [f"could not have been undone: {what}" for what in work.lasting]
        work.commit()
    store.emit("apply_succeeded", {"created": len(result.objects_created), "updated": len(result.objects_updated), "deleted": len(result.objects_deleted), "migrations": len(result.migrations_applied)})
    return result


def restore(run: Executor, plan: Plan, by: dict) -> None:
    """Definitions as the last snapshot has them: new objects go, changed and dropped ones are made again."""
    for n, c in by.items():
        if c.type == "create":
            run.drop(c.object_type, c.name)
    waiting = [r["ddl"] for n, r in plan.recorded.items() if n in by and r["ddl"]]
    while waiting:
        left = []
        for ddl in waiting:
            try:
                run.create(ddl)
            except Exception:  # it may need another one first
                left.append(ddl)
        if len(left) == len(waiting):
            return
        waiting = left


def comment_keys(kind: str, name: str) -> list[tuple[str]]:
    """The keys under which comments on an object are recorded."""
    word = kind if kind in ("table", "view", "materialized_view", "function", "procedure", "operator", "type", "trigger", "domain") else None
    trigger, _, table = name.partition(":")
    if kind == "trigger" and table:  # a table of the schema public may be spelled without it
        other = table.removeprefix("public.") if table.startswith("public.") else f"public.{table}" if "." not in table else table
        return [(f"trigger:{trigger}:{t}",) for t in dict.fromkeys((table, other))]
    return [] if word is None else [(f"{word}:{name}{'()' if kind in ('function', 'procedure') else ''}",)]


def publish(spark: SparkSession, store: StateStore, plan: Plan, made: list, deleted: list, told: Callable[[str], None]) -> None:
    now = datetime.now(UTC).replace(tzinfo=None)
    keys = ["object_type", "object_name"]
    touched = [(c.object_type, c.name) for c in [*made, *deleted]]
    owners = spark.createDataFrame(touched, "object_type string, object_name string")
    rows = [(c.object_type, c.name, plan.objects[c.node]["ddl_hash"], plan.objects[c.node]["ddl"], plan.objects[c.node]["trigger_table"], now) for c in made]
    state = diff.replace_of(store.table("state"), spark.createDataFrame(rows, store.table("state").schema), owners, keys)
    gone = spark.createDataFrame(sorted({k for c in deleted for k in comment_keys(c.object_type, c.name)}), "_key string") if deleted else None
    if gone is not None:  # comments on what is gone, by their whole keys; a relation's columns have its name before theirs
        state = state.join(F.broadcast(gone), (F.col("object_type") == "comment") & (F.col("object_name") == F.col("_key")), "left_anti")
        for c in deleted:
            if c.object_type in ("table", "view", "materialized_view", "type"):
                state = state.filter(~((F.col("object_type") == "comment") & F.startswith("object_name", F.lit(f"column:{c.name}."))))
            if c.object_type == "trigger" and ":" not in c.name:  # recorded before triggers had their tables
                state = state.filter(~((F.col("object_type") == "comment") & F.startswith("object_name", F.lit(f"trigger:{c.name}:"))))
    kept = {(c.object_type, c.name) for c in made}
    deps = plan.deps.join(spark.createDataFrame(sorted(kept) or [("", "")], "object_type string, state_name string"), ["object_type", "state_name"], "left_semi")
    soft = (F.col("dep_class") == "function") & F.col("object_type").isin("function", "procedure")
    new_deps = deps.select(F.col("object_type").alias("dependent_type"), F.col("state_name").alias("dependent_name"), F.col("dep_class").alias("dependency_type"), F.col("dep_schema").alias("dependency_schema"), F.col("dep_name").alias("dependency_name"), F.when(soft, "soft").otherwise("hard").alias("dependency_kind"))
    old = store.table("dependencies")
    both = diff.replace_of(old, new_deps, owners.toDF("dependent_type", "dependent_name"), ["dependent_type", "dependent_name"])
    for c in deleted:  # rows that name what is gone as what they depend on
        target = Ident.parse(c.name)
        kind = next((k for k, kinds in TARGETS.items() if c.object_type in kinds), None)
        both = both.filter(~((F.col("dependency_type") == F.lit(kind)) & F.col("dependency_schema").eqNullSafe(F.lit(target.schema)) & (F.col("dependency_name") == F.lit(target.name))) | F.lit(kind is None))
    applied = spark.createDataFrame([(n, now) for n, _ in plan.new_migrations], store.table("migrations").schema)
    named = spark.createDataFrame([(c.object_type, i.schema, i.name) for c in [*made, *deleted] for i in [Ident.parse(c.name.partition(":")[0] if c.object_type == "trigger" else c.name)]], "object_type string, schema string, name string")
    again = spark.createDataFrame([(plan.objects[c.node]["ddl"],) for c in made] or [("",)], "ddl string")
    keyed = lambda df: df.withColumn("_key", F.concat_ws("\x01", "object_type", F.coalesce("schema", F.lit("")), "name"))
    catalog = diff.replace_of(keyed(store.table("catalog")), keyed(catalog_of(again)), keyed(named), ["_key"])
    store.publish({"catalog": catalog, "state": state, "dependencies": both, "migrations": diff.insert_if_absent(store.table("migrations"), applied, ["name"])}, told)
