"""Migrations that leave no trace when they fail: copy-on-write versions of catalog tables and an undo log by statement.

Spark's own catalog has no transactions. A statement that would change a table in place makes a new version of it under another name instead, which then
takes the table's name, while the old one is kept; rows that are only added are known by the files that were there before. What undoes a statement is
written to the log before the statement runs, so that a run that is lost on the way is undone by the next one.

| Statement | What it does here | What undoes it |
|-|-|-|
| CREATE TABLE, VIEW, SCHEMA | runs | drops it |
| INSERT INTO | runs | deletes the files that were not there, and partitions left empty |
| INSERT OVERWRITE, UPDATE, DELETE, TRUNCATE | writes a new version | the kept version takes its name back |
| ALTER TABLE ADD, DROP, RENAME, ALTER COLUMN | a new version; over the same files where a column without a default is added | the same |
| DROP TABLE | gives it another name | gives it its name back |
| DROP, CREATE OR REPLACE VIEW | runs | the old view is made again, after all tables |
| ALTER TABLE RENAME TO, SET, temporary views | runs | as it was |

Anything else runs and is listed in `lasting`: it cannot be undone. What is kept is dropped when the transaction is committed. Versions are written by Spark, a table is
never copied by the driver; the driver lists the files of tables that rows are added to, as Spark itself does to plan a scan of them.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.dependencies import Cursor
from ..functions.dialect import as_spark, spark_type
from ..functions.sqltext import Token, tokens

#: The property of a table whose files are a version that a transaction wrote.
MARK = "marlstone.version"


class CannotRun(ValueError):
    """A form of a statement that is not run here."""


def _outer(toks: list[Token]) -> list[tuple[int, str]]:
    """(place, word) of the tokens outside of parentheses."""
    out, depth = [], 0
    for k, t in enumerate(toks):
        depth -= t.text in (")", "]")
        if depth == 0:
            out.append((k, t.lower))
        depth += t.text in ("(", "[")
    return out


class Statement:
    """A statement's tokens, its clauses, and the text between places."""

    def __init__(self, sql: str):
        self.sql = sql.strip().rstrip(";")
        self.toks = list(tokens(self.sql))
        self.outer = _outer(self.toks)

    def place(self, *words: str, after: int = 0) -> int:
        """The place of the first of some words outside of parentheses; that of the end where there is none."""
        return next((k for k, w in self.outer if k >= after and w in words), len(self.toks))

    def text(self, a: int, b: int) -> str:
        return self.sql[self.toks[a].start : self.toks[b - 1].end] if a < b else ""

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """What commas part between two places."""
        cuts = [k for k, w in self.outer if w == "," and a <= k < b]
        return list(zip([a, *[k + 1 for k in cuts]], [*cuts, b], strict=True))


class Transaction:
    """Runs statements so that all of them can be undone. Without a log file, the log is kept in memory."""

    def __init__(self, spark: SparkSession, log: Path | None = None, entries: list[dict] | None = None):
        self.spark, self.log, self.id = spark, log, uuid.uuid4().hex[:8]
        self.entries: list[dict] = entries or []
        self.temporary: list[tuple[str, DataFrame | None]] = []
        self.lasting: list[str] = []
        self.made = 0

    # the log

    def note(self, **entry) -> None:
        """Write an entry down before what it undoes is done."""
        self.entries.append(entry)
        if self.log is not None:
            with self.log.open("a") as f:
                f.write(json.dumps(entry) + "\n")
                f.flush()
                os.fsync(f.fileno())

    def publishing(self, snapshot: str) -> None:
        """Say which snapshot is about to be published: if it is, this transaction stands."""
        self.note(op="publishing", snapshot=snapshot)

    # the catalog

    def named(self, c: Cursor) -> str:
        found = c.qualified()
        if found is None:
            raise CannotRun("a name is missing")
        return ".".join(f"`{p.replace('`', '``')}`" for p in (found.schema, found.name) if p)

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name.replace("`", ""))

    def is_temporary(self, name: str) -> bool:
        return self.exists(name) and self.spark.catalog.getTable(name.replace("`", "")).isTemporary

    def described(self, name: str) -> dict[str, str]:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
        at = next(k for k, r in enumerate(rows) if r["col_name"].startswith("# Detailed"))
        return {r["col_name"]: r["data_type"] for r in rows[at + 1 :]}

    def version_of(self, name: str) -> str | None:
        row = self.spark.sql(f"SHOW TBLPROPERTIES {name} ('{MARK}')").first()
        return None if row is None or "does not have property" in row["value"] else row["value"]

    def partitions(self, name: str) -> list[str]:
        return [c.name for c in self.spark.catalog.listColumns(name.replace("`", "")) if c.isPartition]

    def fresh(self, name: str, what: str) -> str:
        """A new name beside a table's own."""
        self.made += 1
        return f"{name[:-1]}__{what}_{self.id}_{self.made}`"

    def rename(self, old: str, new: str) -> None:
        self.spark.sql(f"ALTER TABLE {old} RENAME TO {new}")

    def path(self, text: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def delete(self, text: str) -> None:
        path, fs = self.path(text)
        fs.delete(path, True)

    def files(self, name: str) -> list[str]:
        self.spark.catalog.refreshTable(name.replace("`", ""))
        return self.spark.table(name).inputFiles()

    # statements

    def run(self, sql: str) -> None:
        """Run one statement, able to be undone. One that fails has changed nothing beyond what the log undoes."""
        s = Statement(sql)
        c = Cursor(s.toks)
        head = c.word()
        c.at += 1
        work = getattr(self, f"_{head}", None) if head in ("create", "insert", "update", "delete", "truncate", "drop", "alter", "set") else None
        if work is not None:
            work(s, c)
        else:
            if head not in ("select", "with", "values", "table", "show", "describe", "explain", "refresh", "analyze", "comment", "grant"):
                self.lasting.append(s.text(0, min(3, len(s.toks))))
            self.spark.sql(as_spark(s.sql))

    def _create(self, s: Statement, c: Cursor) -> None:
        replace = c.accept("or", "replace")
        c.accept("global")
        temporary = c.accept("temp") or c.accept("temporary")
        kind = c.word()
        c.at += 1
        if_not = c.accept("if", "not", "exists")
        if kind == "view" and temporary:
            self._keep_temporary(self.named(c))
        elif kind in ("table", "view"):
            name = self.named(c)
            if self.exists(name) and not (if_not or kind == "table") and replace:
                self._keep_view(name)
            elif not self.exists(name):
                self.note(op="made", kind=kind, name=name)
        elif kind in ("schema", "database"):
            name = self.named(c)
            if not self.spark.catalog.databaseExists(name.replace("`", "")):
                self.note(op="schema", name=name)
        else:
            self.lasting.append(s.text(0, min(3, len(s.toks))))
        self.spark.sql(as_spark(s.sql))

    def _keep_temporary(self, name: str) -> None:
        self.temporary.append((name.replace("`", ""), self.spark.table(name) if self.is_temporary(name) else None))
        self.note(op="temporary", k=len(self.temporary) - 1)

    def _insert(self, s: Statement, c: Cursor) -> None:
        overwrite = c.accept("overwrite")
        if not overwrite and not c.accept("into"):
            raise CannotRun("INSERT without INTO or OVERWRITE")
        c.accept("table")
        name = self.named(c)
        if overwrite:
            rest = s.text(c.at, len(s.toks))
            self._rewritten(name, lambda new: self.spark.sql(f"INSERT INTO {new} {as_spark(rest)}"))
            return
        if self.exists(name) and not self.is_temporary(name):
            self.note(op="rows", name=name, files=self._manifest(name))
        self.spark.sql(as_spark(s.sql))

    def _manifest(self, name: str) -> list[str] | str:
        """The files of a table, beside the log where there is one."""
        files = self.files(name)
        if self.log is None:
            return files
        self.made += 1
        path = self.log.with_name(f"{self.log.stem}-{self.made}.files")
        path.write_text("\n".join(files))
        return str(path)

    def _keep_view(self, name: str) -> None:
        self.note(op="view", name=name, ddl=self.spark.sql(f"SHOW CREATE TABLE {name}").first()[0])

    def _swap(self, name: str, new: str | None, shared: bool = False) -> None:
        """Keep a table under another name, and give its name to a new version."""
        kept = self.fresh(name, "kept")
        self.note(op="swap", name=name, kept=kept, new=new, shared=shared)
        self.rename(name, kept)
        if shared:  # a managed table takes its files along
            self.spark.sql(f"ALTER TABLE {new} SET LOCATION '{self.described(kept)['Location']}'")
        if new is not None:
            self.rename(new, name)
            if self.partitions(name):
                self.spark.sql(f"MSCK REPAIR TABLE {name}")

    def _rewritten(self, name: str, fill=None, query: str | None = None) -> None:
        """A new version of a table: of the same columns, filled by a function, or of those of a query."""
        told = self.described(name)
        new = self.fresh(name, "new")
        folder = f"{told['Location'].rstrip('/')}__{self.id}_{self.made}"
        self.note(op="made", kind="table", name=new, data=folder)
        path, fs = self.path(folder)
        fs.mkdirs(path)  # a version may have no rows
        if query is None:
            self.spark.sql(f"CREATE TABLE {new} LIKE {name} LOCATION '{folder}'")
            if fill is not None:
                fill(new)
        else:
            columns = self.spark.sql(query).columns
            by = [p for p in self.partitions(name) if p in columns]
            parted = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in by)})" if by else ""
            self.spark.sql(f"CREATE TABLE {new} USING {told['Provider']} {parted} LOCATION '{folder}' AS {query}")
        self.spark.sql(f"ALTER TABLE {new} SET TBLPROPERTIES ('{MARK}' = '{folder}')")
        self._swap(name, new)

    def _target(self, s: Statement, c: Cursor, stop: tuple[str, ...]) -> tuple[str, str]:
        """The name of a table that rows are changed in, and that it goes by."""
        c.accept("only")
        name = self.named(c)
        c.accept("as")
        alias = name
        if c.word() not in stop and c.peek() is not None:
            alias = f"`{c.peek().name}`"
            c.at += 1
        return name, alias

    def _condition(self, s: Statement, at: int, using: int) -> str | None:
        """What follows WHERE; tables of USING become a subquery."""
        end = s.place("returning")
        where = as_spark(s.text(at + 1, end)) if at < end else None
        if end < len(s.toks):
            raise CannotRun("RETURNING is not run")
        if using < at:
            return f"EXISTS (SELECT 1 FROM {as_spark(s.text(using + 1, at))}{f' WHERE {where}' if where else ''})"
        return where

    def _delete(self, s: Statement, c: Cursor) -> None:
        if not c.accept("from"):
            raise CannotRun("DELETE without FROM")
        name, alias = self._target(s, c, ("where", "using", "returning"))
        where, using = s.place("where"), s.place("using")
        when = self._condition(s, where, using)
        short = alias.split(".")[-1]
        fill = None if when is None else lambda new: self.spark.sql(f"INSERT INTO {new} SELECT {short}.* FROM {name} AS {short} WHERE NOT coalesce({when}, false)")
        self._rewritten(name, fill)

    def _update(self, s: Statement, c: Cursor) -> None:
        name, alias = self._target(s, c, ("set",))
        begin, where, other = s.place("set"), s.place("where"), s.place("from")
        if other < where:
            raise CannotRun("UPDATE ... FROM is not run: several rows may meet one")
        when = self._condition(s, where, len(s.toks))
        given: dict[str, str] = {}
        for a, b in s.parts(begin + 1, min(where, s.place("returning"))):
            if s.toks[a].text == "(" or b - a < 3 or s.toks[a + 1].text != "=":
                raise CannotRun("SET of several columns at once is not run")
            given[s.toks[a].name] = as_spark(s.text(a + 2, b))
        schema = self.spark.table(name).schema
        if missing := [g for g in given if g not in {f.name.lower() for f in schema}]:
            raise CannotRun(f"no column {missing[0]} in {name}")
        short = alias.split(".")[-1]
        own = lambda f: f"{short}.`{f.name}`"
        changed = lambda f: f"CAST({given[f.name.lower()]} AS {f.dataType.simpleString()})" if f.name.lower() in given else own(f)
        listed = lambda make: ", ".join(f"{make(f)} AS `{f.name}`" for f in schema)
        source = f"FROM {name} AS {short}"
        if when is None:
            query = f"SELECT {listed(changed)} {source}"
        elif any(t.lower == "select" for t in s.toks[where:]):  # a condition with a subquery stands in a filter only
            query = f"SELECT {listed(changed)} {source} WHERE {when} UNION ALL SELECT {listed(own)} {source} WHERE NOT coalesce({when}, false)"
        else:
            query = f"SELECT {listed(lambda f: f'CASE WHEN {when} THEN {changed(f)} ELSE {own(f)} END' if f.name.lower() in given else own(f))} {source}"
        self._rewritten(name, lambda new: self.spark.sql(f"INSERT INTO {new} {self._in_order(new, query)}"))

    def _in_order(self, new: str, query: str) -> str:
        columns = ", ".join(f"`{c}`" for c in self.spark.table(new).columns)
        return f"SELECT {columns} FROM ({query})"

    def _truncate(self, s: Statement, c: Cursor) -> None:
        c.accept("table")
        while c.peek() is not None:
            c.accept("only")
            self._rewritten(self.named(c))
            if not c.accept(","):
                return

    def _drop(self, s: Statement, c: Cursor) -> None:
        kind = c.word()
        c.at += 1
        if kind not in ("table", "view"):
            self.lasting.append(s.text(0, min(3, len(s.toks))))
            self.spark.sql(as_spark(s.sql))
            return
        if_exists = c.accept("if", "exists")
        while c.peek() is not None:
            name = self.named(c)
            if self.is_temporary(name):
                self._keep_temporary(name)
                self.spark.catalog.dropTempView(name.replace("`", ""))
            elif self.exists(name) and kind == "view":
                self._keep_view(name)
                self.spark.sql(f"DROP VIEW {name}")
            elif self.exists(name):
                self._swap(name, None)
            elif not if_exists:
                raise CannotRun(f"there is no {kind} {name}")
            if not c.accept(","):
                return

    def _set(self, s: Statement, c: Cursor) -> None:
        key = s.text(1, s.place("=", "to"))
        self.note(op="set", key=key, value=self.spark.conf.get(key, None))
        value = s.text(s.place("=", "to") + 1, len(s.toks))
        self.spark.sql(f"SET {key} = {value.strip(chr(39))}")

    def _alter(self, s: Statement, c: Cursor) -> None:
        if not c.accept("table"):
            self.lasting.append(s.text(0, min(3, len(s.toks))))
            self.spark.sql(as_spark(s.sql))
            return
        if_exists = c.accept("if", "exists")
        c.accept("only")
        name = self.named(c)
        if if_exists and not self.exists(name):
            return
        for a, b in s.parts(c.at, len(s.toks)):
            name = self._altered(s, Cursor(s.toks[:b], a), b, name)

    def _altered(self, s: Statement, c: Cursor, end: int, name: str) -> str:
        """One action of an ALTER TABLE; the table's name after it."""
        columns = self.spark.table(name).columns
        quoted = lambda n: f"`{n.replace('`', '``')}`"
        position = {n.lower(): n for n in columns}

        def known(given: str) -> str:
            if given not in position:
                raise CannotRun(f"no column {given} in {name}")
            return position[given]

        rewrite = lambda make: self._rewritten(name, query="SELECT " + ", ".join(make(n) for n in columns) + f" FROM {name}")
        if c.accept("rename", "to"):
            to = self.named(c)
            to = to if "." in to else ".".join([*name.split(".")[:-1], to])
            self.note(op="rename", name=name, to=to)
            self.rename(name, to)
            return to
        if c.accept("rename"):
            c.accept("column")
            old = known(c.peek().name)
            c.at += 1
            if not c.accept("to"):
                raise CannotRun("RENAME without TO")
            new = c.peek().name
            rewrite(lambda n: f"{quoted(n)} AS {quoted(new)}" if n == old else quoted(n))
        elif c.accept("add"):
            c.accept("column") or c.accept("columns")
            if_not = c.accept("if", "not", "exists")
            if c.word() in ("constraint", "primary", "unique", "foreign", "check", "("):
                raise CannotRun("constraints and lists of columns are not run")
            column = c.peek().name
            c.at += 1
            if column in position:
                if if_not:
                    return name
                raise CannotRun(f"column {column} stands in {name} already")
            kind, default = c.at, next((k for k, w in s.outer if w == "default" and c.at <= k < end), end)
            stop = next((k for k, w in s.outer if w in ("not", "null", "default", "check", "references", "primary", "unique", "constraint") and kind <= k < end), end)
            told = spark_type(s.text(kind, stop))
            if default < end:
                last = next((k for k, w in s.outer if w in ("not", "check", "references", "primary", "unique", "constraint") and default < k < end), end)
                self._rewritten(name, query=f"SELECT *, CAST({as_spark(s.text(default + 1, last))} AS {told}) AS {quoted(column)} FROM {name}")
            else:
                self._widened(name, f"{quoted(column)} {told}")
        elif c.accept("drop"):
            c.accept("column")
            if_exists = c.accept("if", "exists")
            column = c.peek().name
            if column not in position and if_exists:
                return name
            gone = known(column)
            if len(columns) == 1:
                raise CannotRun("a table keeps a column at least")
            self._rewritten(name, query="SELECT " + ", ".join(quoted(n) for n in columns if n != gone) + f" FROM {name}")
        elif c.accept("alter"):
            c.accept("column")
            column = known(c.peek().name)
            c.at += 1
            c.accept("set", "data")
            if not c.accept("type"):
                raise CannotRun("only the type of a column is altered")
            using = next((k for k, w in s.outer if w == "using" and c.at <= k < end), end)
            told = spark_type(s.text(c.at, using))
            value = as_spark(s.text(using + 1, end)) if using < end else quoted(column)
            rewrite(lambda n: f"CAST({value} AS {told}) AS {quoted(n)}" if n == column else quoted(n))
        else:
            raise CannotRun(f"ALTER TABLE {s.text(c.at, end)} is not run")
        return name

    def _widened(self, name: str, column: str) -> None:
        """A version with one more column over the same files."""
        told = self.described(name)
        new = self.fresh(name, "new")
        self.note(op="made", kind="table", name=new)
        self.spark.sql(f"CREATE TABLE {new} LIKE {name} LOCATION '{told['Location']}'")
        self.spark.sql(f"ALTER TABLE {new} ADD COLUMNS ({column})")
        self._swap(name, new, shared=True)
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{MARK}' = '{self.described(name)['Location']}')")

    # the end

    def rollback(self) -> None:
        """Undo everything, the last first. What is undone already, or was never done, is passed over."""
        for e in reversed(self.entries):
            getattr(self, f"_undo_{e['op']}")(e)
        views = {e["name"]: e["ddl"] for e in reversed(self.entries) if e["op"] == "view"}
        while views:  # over tables as they are again, and over each other
            left = {}
            for name, ddl in views.items():
                try:
                    self.spark.sql(f"DROP VIEW IF EXISTS {name}")
                    self.spark.sql(ddl)
                except AnalysisException:
                    left[name] = ddl
            if len(left) == len(views):
                raise CannotRun(f"views could not be made again: {', '.join(left)}")
            views = left
        self.close()

    def _undo_view(self, e: dict) -> None:
        pass  # made again when all tables are back

    def _undo_publishing(self, e: dict) -> None:
        pass

    def _undo_made(self, e: dict) -> None:
        self.spark.sql(f"DROP {e['kind'].upper()} IF EXISTS {e['name']}")
        if e.get("data"):
            self.delete(e["data"])

    def _undo_schema(self, e: dict) -> None:
        self.spark.sql(f"DROP SCHEMA IF EXISTS {e['name']}")

    def _undo_swap(self, e: dict) -> None:
        if self.exists(e["kept"]):
            if self.exists(e["name"]) and e["new"] is not None:
                self.rename(e["name"], e["new"])
            if e["shared"]:  # the new version must not hold the files when it is dropped
                self.spark.sql(f"DROP TABLE IF EXISTS {e['new']}")
            self.rename(e["kept"], e["name"])

    def _undo_rename(self, e: dict) -> None:
        if self.exists(e["to"]) and not self.exists(e["name"]):
            self.rename(e["to"], e["name"])

    def _undo_rows(self, e: dict) -> None:
        if not self.exists(e["name"]):
            return
        before = set(e["files"] if isinstance(e["files"], list) else Path(e["files"]).read_text().split("\n"))
        folders = set()
        for f in self.files(e["name"]):
            if f not in before:
                self.delete(f)
                folders.add(f.rpartition("/")[0])
        for folder in folders if self.partitions(e["name"]) else ():
            path, fs = self.path(folder)
            if not any(s.isFile() and not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(path)):
                fs.delete(path, True)
        if self.partitions(e["name"]):
            self.spark.sql(f"MSCK REPAIR TABLE {e['name']} SYNC PARTITIONS")
        self.spark.catalog.refreshTable(e["name"].replace("`", ""))

    def _undo_set(self, e: dict) -> None:
        self.spark.conf.unset(e["key"]) if e["value"] is None else self.spark.conf.set(e["key"], e["value"])

    def _undo_temporary(self, e: dict) -> None:
        if e["k"] < len(self.temporary):  # those of a lost session are gone with it
            name, before = self.temporary[e["k"]]
            self.spark.catalog.dropTempView(name) if before is None else before.createOrReplaceTempView(name)

    def commit(self) -> None:
        """Drop what was kept."""
        for e in self.entries:
            if e["op"] == "swap" and self.exists(e["kept"]):
                folder = None if e["shared"] else self.version_of(e["kept"])
                if e["shared"] and self.described(e["kept"])["Type"] == "MANAGED":  # its files are those of the new version
                    self.spark.sql(f"ALTER TABLE {e['kept']} SET LOCATION '{self.described(e['kept'])['Location']}__none_{self.id}'")
                self.spark.sql(f"DROP TABLE {e['kept']}")
                if folder:
                    self.delete(folder)
        self.close()

    def close(self) -> None:
        if self.log is not None:
            for e in self.entries:
                if e["op"] == "rows" and isinstance(e["files"], str):
                    Path(e["files"]).unlink(missing_ok=True)
            self.log.unlink(missing_ok=True)
        self.entries = []


def opened(spark: SparkSession, folder: Path) -> Transaction:
    """A transaction whose log stands in a folder."""
    return Transaction(spark, folder / f"undo-{uuid.uuid4().hex}.jsonl")


def recover(spark: SparkSession, folder: Path, current: str | None) -> list[str]:
    """End the transactions of runs that were lost: those whose snapshot was published stand, others are undone. Their outcomes."""
    out = []
    for log in sorted(folder.glob("undo-*.jsonl")):
        entries = []
        for line in log.read_text().splitlines():
            try:
                entries.append(json.loads(line))
            except json.JSONDecodeError:  # the last entry was cut off: what it undoes was not done
                break
        found = Transaction(spark, log, entries)
        stands = any(e["op"] == "publishing" and e["snapshot"] == current for e in entries)
        found.commit() if stands else found.rollback()
        out.append("committed" if stands else "undone")
    return out
