"""Errors of statements told with their place: file, line and column, the line with a mark under it, and what may help."""

from __future__ import annotations

import os

from pyspark.errors import PySparkException

from .sqltext import line_and_column

#: What may help against Spark's errors, by their class: fixed texts.
HINTS = {
    "TABLE_OR_VIEW_NOT_FOUND": "is the object defined in a file, or spelled with another schema?",
    "UNRESOLVED_COLUMN": "check the column's name, and whether a migration has dropped or renamed it",
    "UNRESOLVED_ROUTINE": "is the function defined in a file? Bodies that are only recorded cannot be called",
    "PARSE_SYNTAX_ERROR": "the statement is run as Spark SQL: some of PostgreSQL's forms have none there",
    "TABLE_OR_VIEW_ALREADY_EXISTS": "use IF NOT EXISTS, or CREATE OR REPLACE for a view",
    "DATATYPE_MISMATCH": "add a cast",
    "UNSUPPORTED_DATATYPE": "this type has no name in Spark",
}


def relative(path: str, base: str | None = None) -> str:
    """A path as seen from a folder, the current one unless given; paths outside of it stay whole."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if "://" in plain:
        return path
    base = os.path.abspath(base or os.getcwd())
    whole = os.path.abspath(plain)
    return os.path.relpath(whole, base) if whole.startswith(base.rstrip("/") + "/") else whole


def excerpt(text: str, offset: int) -> str:
    """The line that an offset is in, with a mark under its column; long lines are cut around it."""
    line, column = line_and_column(text, offset)
    shown = text.split("\n")[line - 1].replace("\t", " ")
    begin = max(0, column - 80)
    return f"  {shown[begin : begin + 160]}\n  {' ' * (column - 1 - begin)}^"


def offset_of(error: Exception, source: str) -> int | None:
    """Where in a statement's source an error of Spark points to: the place of the fragment that it names, if the source has it once."""
    if not isinstance(error, PySparkException):
        return None
    for context in error.getQueryContext() or []:
        try:
            fragment = context.fragment()
        except Exception:  # contexts of DataFrame calls have none
            continue
        if fragment and source.count(fragment) == 1:
            return source.index(fragment)
    return None


def hint_of(error: Exception) -> str | None:
    found = error.getCondition() if isinstance(error, PySparkException) else None
    return HINTS.get((found or "").split(".")[0])


def told(error: Exception, source: str, file: str | None = None, start_line: int = 1, base: str | None = None) -> str:
    """An error of a statement (source, beginning on start_line of file) in one text."""
    message = str(error).split("\n")[0]
    offset = offset_of(error, source)
    line, column = line_and_column(source, offset) if offset is not None else (1, None)
    place = ":".join(str(x) for x in (relative(file, base) if file else None, start_line + line - 1, column) if x is not None)
    parts = [f"{place}: {message}", excerpt(source, offset) if offset is not None else None, f"hint: {hint_of(error)}" if hint_of(error) else None]
    return "\n".join(p for p in parts if p)


def chain(error: BaseException) -> str:
    """An error and what it was caused by, a line each."""
    out, e = [str(error).split("\n")[0]], error.__cause__
    while e is not None:
        out.append(f"  caused by: {str(e).split(chr(10))[0]}")
        e = e.__cause__
    return "\n".join(out)
