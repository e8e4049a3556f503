"""Checking the bodies of routines and views, with places in their files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import as_spark
from .identify import SqlObject
from .routines import Untranslated, fragments, returns_always, unused
from .sqltext import line_of, split_statements


@dataclass(frozen=True)
class Finding:
    object_type: str
    name: str
    level: str
    message: str
    line: int
    source_line: int | None


def source_line(start: Column, body_offset: Column, line: Column) -> Column:
    """The line in a file of a line in a body."""
    return start + body_offset + line - 1


#: Error conditions of statements that fail whenever they run.
CERTAIN = ("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND", "WRONG_NUM_ARGS", "DATATYPE_MISMATCH")


def lint(spark: SparkSession, o: SqlObject, analyse: bool = True, ready: Callable[[SqlObject, str], str] = lambda o, sql: sql) -> list[Finding]:
    """Findings for a routine of language sql or plpgsql, or a view: what Spark cannot parse or resolve. Names that begin with _ are left out.

    ready writes a statement of o as Spark is to analyse it.
    """
    if o.ident.name.startswith("_"):
        return []
    if o.kind in ("function", "procedure") and o.details["language"].lower() == "plpgsql":
        return _plpgsql(spark, o, analyse)
    if o.kind in ("function", "procedure"):
        if o.details["language"].lower() != "sql":
            return []
        body = o.details["body"]
    elif o.kind in ("view", "materialized_view"):
        body = o.ddl[o.details["from"] :]
    else:
        return []
    offset, out = o.ddl[: max(0, o.ddl.find(body))].count("\n"), []
    for s in split_statements(body):
        try:
            if analyse:
                _ = spark.sql(ready(o, s.sql)).schema
            else:
                spark._jsparkSession.sessionState().sqlParser().parsePlan(s.sql)
        except (AnalysisException, ParseException) as e:
            level = "error" if isinstance(e, ParseException) or any(x in str(e) for x in CERTAIN) else "warning"
            out.append(Finding(o.kind, str(o.ident), level, str(e).split("\n")[0], s.start_line, None if o.start_line is None else o.start_line + offset + s.start_line - 1))
    return out


def _plpgsql(spark: SparkSession, o: SqlObject, analyse: bool) -> list[Finding]:
    """Each expression and query of a body is read with the variables in its scope as typed nulls; nothing is run.

    Further: variables that nothing reads (warning extra), and functions with a way to their end that does not return.
    """
    body = o.details["body"] or ""
    offset = o.ddl[: max(0, o.ddl.find(body))].count("\n")
    in_file = lambda line: None if o.start_line is None else o.start_line + offset + line - 1
    tell = lambda level, message, line: Finding(o.kind, str(o.ident), level, message, line, in_file(line))
    try:
        found, idle = fragments(o), unused(o)
    except Untranslated as e:
        return [tell("warning", f"not checked: {e}", 1)]
    out, rows = [], {}
    for f in found:
        line, scope, known = line_of(body, f.at), [], True
        text = as_spark(f.text)
        for name, kind in f.scope:
            if kind.startswith(":"):  # the row of a loop has the columns of its query
                known = known and rows.get(kind) is not None
                kind = rows.get(kind) or "string"
            scope.append(f"CAST(NULL AS {kind}) AS `{name}`")
        given = f"(SELECT {', '.join(scope)}) AS given" if scope else "(SELECT 1 AS one) AS given"
        asked = f"SELECT {text} FROM {given}" if f.kind == "expression" else f"SELECT 1 FROM {given}, LATERAL ({text}) AS body"
        try:
            if f.kind == "statement" or not analyse or not known:
                spark._jsparkSession.sessionState().sqlParser().parsePlan(text if f.kind != "expression" else asked)
                continue
            spark.sql(asked).schema  # noqa: B018  analysed, not run
            if f.kind == "query":
                rows[f":{f.text}"] = spark.sql(f"SELECT body.* FROM {given}, LATERAL ({text}) AS body").schema.simpleString()
        except (AnalysisException, ParseException) as e:
            level = "error" if isinstance(e, ParseException) or any(x in str(e) for x in CERTAIN) else "warning"
            out.append(tell(level, str(e).split("\n")[0], line))
    out += [tell("warning extra", f"unused variable {name}", line_of(body, at)) for name, at in idle]
    if o.kind == "function" and o.details["returns"] not in ("", "void", "trigger") and not o.details["set"] and returns_always(o) is False:
        out.append(tell("error", "control may reach the end of the function without RETURN", line_of(body, len(body.rstrip()))))
    return out


def level_counts(findings: DataFrame) -> DataFrame:
    """One row: errors and warnings, by how their level begins."""
    return findings.agg(F.count_if(F.startswith("level", F.lit("error"))).alias("errors"), F.count_if(F.startswith("level", F.lit("warning"))).alias("warnings"))


def report(findings: list[Finding]) -> str:
    """Findings as text, warnings first."""
    rank = {"warning": 0, "error": 1}
    return "\n".join(f"{f.level}: {f.object_type} {f.name}" + (f" (line {f.source_line})" if f.source_line else "") + f": {f.message}" for f in sorted(findings, key=lambda f: (rank.get(f.level.split()[0], 2), f.name, f.line)))
