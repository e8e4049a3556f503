"""How much a change breaks for programs that use the database: safe, transient or breaking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dependencies import Cursor, TYPE_NAMES
from ..functions.identify import SqlObject
from ..functions.sqltext import SqlSyntaxError, split_statements, tokens

SAFE, TRANSIENT, BREAKING = 0, 1, 2
LABELS = ("safe", "transient", "breaking")
#: Kinds whose removal or change no program notices.
UNNOTICED = ("comment", "index", "trigger", "cron_job")


def label(rank: Column) -> Column:
    """The label of a rank; an unknown one is breaking."""
    return F.element_at(F.array(*map(F.lit, LABELS)), F.coalesce(rank, F.lit(BREAKING)) + 1)


def rank_of_change(kind: Column, change: Column, probed: Column) -> Column:
    """The rank of a change to an object: probed is what comparing its definitions gave, null where it is unknown."""
    quiet = kind.isin(*UNNOTICED)
    return F.when(change == "create", SAFE).when(quiet, SAFE).when(change == "delete", BREAKING).when(kind == "table", BREAKING).otherwise(F.coalesce(probed, F.lit(BREAKING)))


def rollup(ranks: DataFrame, rank: str = "severity_rank") -> DataFrame:
    """One row: how many changes of each severity, and the worst (safe where there are none)."""
    n = [F.count_if(F.col(rank) == k).alias(f"n_{name}") for k, name in enumerate(LABELS)]
    return ranks.agg(*n, F.coalesce(F.max(rank), F.lit(SAFE)).alias("worst_rank")).withColumn("worst", label(F.col("worst_rank")))


def is_ordered_subsequence(old: Column, new: Column) -> Column:
    """Whether all labels of old stand in new in the same order: an enum that only gained labels."""
    at = F.aggregate(new, F.lit(0), lambda k, x: F.when((k < F.size(old)) & (F.get(old, k) == x), k + 1).otherwise(k))
    return at == F.size(old)


def same_shape(old: Column, new: Column) -> Column:
    """Whether two arrays of (name, type) are equal, order included."""
    return old == new


def subsequence(old: list[str], new: list[str]) -> bool:
    it = iter(new)
    return all(x in it for x in old)


def canonical(text: str) -> str:
    base = text.removesuffix("[]")
    base = base.removeprefix("pg_catalog.")
    return TYPE_NAMES.get(base, base) + text[len(text.removesuffix("[]")) :]


def routine_interface(o: SqlObject) -> tuple | None:
    """Inputs, their names, outputs, result and set flag; None where a %TYPE leaves it open."""
    args = o.details["args"]
    if any("%type" in a["text"] for a in args) or "%type" in o.details["returns"]:
        return None
    ins = [a for a in args if a["mode"] in ("in", "inout", "variadic")]
    outs = [(a["name"], canonical(a["text"])) for a in args if a["mode"] in ("out", "inout", "table")]
    return [canonical(a["text"]) for a in ins], [a["name"] for a in ins], outs, canonical(o.details["returns"]), o.details["set"]


def rank_of_update(old: SqlObject, new: SqlObject, shapes: tuple | None = None, returns: Mapping[str, str] | None = None) -> int | None:
    """The rank of an update by the two definitions; None: unknown.

    shapes: output columns of an old and new view; returns: result types of the recorded functions by name, for the result of an operator.
    """
    if old.kind in UNNOTICED:
        return SAFE
    if old.kind in ("function", "procedure"):
        a, b = routine_interface(old), routine_interface(new)
        if a is None or b is None:
            return None
        names = all(not x or x == y for x, y in zip(a[1], b[1], strict=False))
        result = a[2] == b[2] if a[2] or b[2] else a[3] == b[3]
        return TRANSIENT if a[0] == b[0] and names and a[4] == b[4] and result else BREAKING
    if old.kind == "aggregate":
        same = [[canonical(x["text"]) for x in o.details["args"]] for o in (old, new)]
        return TRANSIENT if same[0] == same[1] and old.details["final"] == new.details["final"] and (new.details["final"] or canonical(old.details["state"]) == canonical(new.details["state"])) else BREAKING
    if old.kind in ("view", "materialized_view"):
        return None if shapes is None else TRANSIENT if shapes[0] == shapes[1] else BREAKING
    if old.kind == "type":
        if "labels" in old.details and "labels" in new.details:
            return TRANSIENT if subsequence(old.details["labels"], new.details["labels"]) else BREAKING
        if "fields" in old.details and "fields" in new.details:
            a, b = ([(f["name"], canonical(f["text"])) for f in o.details["fields"]] for o in (old, new))
            return TRANSIENT if a == b else BREAKING
        return BREAKING
    if old.kind == "domain":
        return TRANSIENT if canonical(old.details["base"]) == canonical(new.details["base"]) else BREAKING
    if old.kind == "operator":
        if any(canonical(old.details[k]) != canonical(new.details[k]) for k in ("left", "right")):
            return BREAKING
        # another function may give another type; one that is not recorded is rated by its own change
        before, after = ((returns or {}).get(str(o.details["procedure"])) for o in (old, new))
        return BREAKING if before and after and canonical(before) != canonical(after) else TRANSIENT
    return BREAKING


#: Words between CREATE and the kind of what is created: fixed values.
MODIFIERS = frozenset("or replace temp temporary global local unlogged unique constraint recursive materialized".split())
#: Kinds whose creation adds to what is there, kinds that ALTER ... OWNER TO reshapes as it does tables, and heads of statements that leave interfaces as they are: fixed values.
ADDED = frozenset("table index sequence extension schema view function procedure trigger domain aggregate operator type collation text".split())
LIKE_TABLES = frozenset("table view index sequence materialized foreign".split())
QUIET_HEADS = frozenset("insert update delete select values table copy set reset truncate cluster vacuum analyze analyse comment".split())


def _top_level(words: list[str]) -> list[str] | None:
    """Words outside of parentheses; None where these do not close."""
    out, depth = [], 0
    for w in words:
        depth -= w == ")"
        if depth < 0:
            return None
        if depth == 0 and w not in "()":
            out.append(w)
        depth += w == "("
    return None if depth else out


def _after_name(words: list[str], at: int) -> int:
    """The place behind a name that may have a schema before it."""
    return _after_name(words, at + 2) if words[at + 1 : at + 2] == ["."] else at + 1


def rank_of_statement(sql: str) -> int:
    """The rank of one statement of a migration: what only adds, and what changes rows alone, is safe; what is not known is breaking."""
    try:
        words = [t.lower for t in tokens(sql) if t.lower != ";"]
    except SqlSyntaxError:
        return BREAKING
    if not words:
        return SAFE
    outer = _top_level(words)
    if outer is None:
        return BREAKING
    if words[0] == "(":  # a query in parentheses
        words = words[next(k for k, w in enumerate(words) if w != "(") :]
    head = words[0]
    if head == "with":
        head = next((w for w in outer[1:] if w in ("select", "insert", "update", "delete", "values", "table", "merge")), "")
    if head == "create":
        at = next((k for k, w in enumerate(words) if k and w not in MODIFIERS), len(words))
        kind, then = (*words[at : at + 2], "", "")[:2]
        named = _after_name(words, at + 1)
        range_type = kind == "type" and words[named : named + 2] == ["as", "range"]
        return BREAKING if kind not in ADDED or range_type or (kind == "operator" and then in ("class", "family")) else SAFE
    if head == "alter":
        kind = (*words, "")[1]
        if kind == "type":
            at = _after_name(words, 2)
            if words[at : at + 2] == ["add", "value"]:
                return SAFE
        return SAFE if words[-3:-1] == ["owner", "to"] and kind not in LIKE_TABLES else BREAKING
    if head == "grant":  # of privileges; a grant of roles names no object
        return SAFE if "on" in outer else BREAKING
    if head == "set" and words[1:2] == ["constraints"]:
        return BREAKING
    return SAFE if head in QUIET_HEADS else BREAKING


def rank_of_migration(text: str) -> int:
    """The worst of its statements; a migration that cannot be read is breaking, an empty one safe."""
    try:
        return max((rank_of_statement(s.sql) for s in split_statements(text)), default=SAFE)
    except SqlSyntaxError:
        return BREAKING


def altered_tables(text: str) -> set[str]:
    """Tables that ALTER TABLE, VIEW or INDEX statements of a migration name; none where it cannot be read."""
    out = set()
    try:
        for s in split_statements(text):
            c = Cursor(list(tokens(s.sql)))
            if c.accept("alter") and (c.accept("table") or c.accept("view") or c.accept("index") or c.accept("materialized", "view")):
                c.accept("if", "exists")
                c.accept("only")
                name = c.qualified()
                if name is not None and not (c.accept("rename")):
                    out.add(str(name))
    except SqlSyntaxError:
        return set()
    return out


def enum_additions(text: str) -> list[tuple[str, str]]:
    """(statement, the same with IF NOT EXISTS) of every ALTER TYPE ... ADD VALUE."""
    out = []
    for s in split_statements(text):
        toks = list(tokens(s.sql))
        words = [t.lower for t in toks]
        at = _after_name(words, 2) + 1
        if words[:2] == ["alter", "type"] and words[at - 1 : at + 1] == ["add", "value"]:
            again = s.sql if words[at + 1 : at + 4] == ["if", "not", "exists"] else s.sql[: toks[at].end] + " IF NOT EXISTS" + s.sql[toks[at].end :]
            out.append((s.sql, again))
    return out
