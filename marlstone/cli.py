"""Command line: python -m marlstone.cli COMMAND. Settings come from marlstone.toml where it exists, and from options."""

from __future__ import annotations

import argparse
import contextlib
import json
import re
import shutil
import sys
import tomllib
from dataclasses import asdict
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.errors import told
from .functions.sqltext import split_statements

SAMPLE = '# Settings of marlstone; options of the command line come before them.\ncode_dir = "sql"\nmigrations_dir = "migrations"\nseed_dir = "seeds"\nstate_dir = ".marlstone"\ndevelopment = false\n'
DEFAULTS = {"code_dir": "sql", "migrations_dir": "migrations", "seed_dir": "seeds", "state_dir": ".marlstone", "development": False}


def settings(path: str = "marlstone.toml", **given) -> dict:
    """Defaults, then the file, then what was given."""
    file = Path(path)
    read = tomllib.loads(file.read_text()) if file.exists() else {}
    return {**DEFAULTS, **read, **{k: v for k, v in given.items() if v is not None}}


def new_migration(folder: str, name: str, now: datetime | None = None) -> Path:
    """An empty migration file with a time in its name."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError("a migration's name has letters, digits, _ and - only")
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"{(now or datetime.now(UTC)):%Y%m%d%H%M%S}_{name}.sql"
    path.write_text(f"-- {name}\n")
    return path


def seed(spark: SparkSession, folder: str) -> list[str]:
    """Run all seed files in order; stops at the first error and says where."""
    from .sources.scan import read_files

    done = []
    for r in read_files(spark, folder, recursive=False).orderBy("file").collect():
        for s in split_statements(r["text"]):
            try:
                spark.sql(s.sql)
            except Exception as e:
                raise RuntimeError(told(e, s.sql, r["file"], s.start_line)) from e
        done.append(r["file"])
    return done


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marlstone")
    parser.add_argument("command", choices=["init", "plan", "status", "apply", "migrate", "watch", "reset", "test", "seed", "new", "check", "run"])
    parser.add_argument("target", nargs="?")
    for name in ("code-dir", "migrations-dir", "seed-dir", "state-dir", "graph"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--gate", action="store_true", help="in development, end an apply on errors in routines that were made or call them")
    given = parser.parse_args(args)
    if given.command == "init":
        Path("marlstone.toml").write_text(SAMPLE)
        return 0
    conf = settings(code_dir=given.code_dir, migrations_dir=given.migrations_dir, seed_dir=given.seed_dir, state_dir=given.state_dir)
    if given.command == "new":
        print(new_migration(conf["migrations_dir"], given.target or ""))
        return 0
    if given.command == "reset":
        if not given.force and input(f"type {conf['state_dir']} to delete the recorded state: ") != conf["state_dir"]:
            return 1
        shutil.rmtree(conf["state_dir"], ignore_errors=True)
        return 0
    from .functions import lint
    from .operators import graph
    from .plans.applying import ApplyError, Executor, apply, bound
    from .plans.planning import PlanError, make_plan
    from .sources.scan import as_object, scan_objects, test_files
    from .sources.state import StateStore
    from .streaming.watch import run_test, watch

    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    store = StateStore(spark, conf["state_dir"])
    migrations = conf["migrations_dir"] if Path(conf["migrations_dir"]).is_dir() else None
    try:
        if given.command in ("plan", "status"):
            plan = make_plan(spark, store, conf["code_dir"], migrations)
            print(plan.json() if given.json else plan.report())
            if given.graph:
                Path(given.graph).write_text(graph.dot(sorted(plan.objects), sorted(tuple(r) for r in plan.edges.select("src", "dst", "kind").collect())))
        elif given.command in ("apply", "migrate"):
            result = apply(spark, store, conf["code_dir"], migrations, development=conf["development"], gate=given.gate)
            print(json.dumps(asdict(result), indent=2) if given.json else "\n".join(f"{k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in asdict(result).items()))
        elif given.command == "watch":
            watch(spark, store, conf["code_dir"], lambda b: print(b.error or (b.plan.report() if b.plan else "no code changed"), *b.impacted, sep="\n"), conf["migrations_dir"])
        elif given.command == "seed":
            print(*seed(spark, conf["seed_dir"]), sep="\n")
        elif given.command == "run":
            for s in split_statements(Path(given.target).read_text()):
                spark.sql(s.sql).show(truncate=False)
        elif given.command == "check":
            rows = [r.asDict() for r in scan_objects(spark, conf["code_dir"]).filter("object_type is not null").collect()]
            made = Executor(spark)
            for r in rows * 2:  # what stands before its dependencies is made the second time
                with contextlib.suppress(Exception):  # it is told below
                    made.create(r["ddl"])
            findings = [f for r in rows for f in lint.lint(spark, as_object(r), ready=bound)]
            print(lint.report(findings) or "nothing found")
            return int(any(f.level.startswith("error") for f in findings))
        elif given.command == "test":
            failed = 0
            for r in test_files(spark, given.target or conf["code_dir"]).collect():
                out = run_test(spark, r["text"])
                failed += out.failed
                print(f"{r['file']}: {out.passed} passed, {out.failed} failed, {out.skipped} skipped")
            return int(bool(failed))
    except (PlanError, ApplyError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
