"""Results of tests in the Test Anything Protocol, and which tests a change touches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds that a dependency of a test may refer to.
KINDS = {"relation": ("table", "view", "materialized_view"), "function": ("function", "procedure"), "type": ("type", "domain")}


def status(line: Column) -> Column:
    """skip, pass or fail of a line; null for one that is not a result."""
    result = line.startswith("ok ") | line.startswith("not ok ")
    return F.when(result & line.contains("# SKIP"), "skip").when(line.startswith("ok "), "pass").when(line.startswith("not ok "), "fail")


@dataclass
class TapResult:
    run: int = 0
    passed: int = 0
    skipped: int = 0
    failures: list[dict] = field(default_factory=list)

    @property
    def failed(self) -> int:
        return len(self.failures)


def description(line: str) -> str:
    """What follows " - ", or else the second space."""
    if " - " in line:
        return line.split(" - ", 1)[1].strip()
    parts = line.split(" ", 2 if line.startswith("ok ") else 3)
    return parts[-1].strip() if len(parts) > (2 if line.startswith("ok ") else 3) else ""


def parse_tap(lines: list[str]) -> TapResult:
    """Counts and failures of a test's output; lines with # after a failure are its diagnostics."""
    out, last = TapResult(), None
    for line in (x.strip() for text in lines for x in text.split("\n")):
        result = line.startswith(("ok ", "not ok "))
        if result and "# SKIP" in line:
            out.run, out.skipped, last = out.run + 1, out.skipped + 1, None
        elif line.startswith("ok "):
            out.run, out.passed, last = out.run + 1, out.passed + 1, None
        elif line.startswith("not ok "):
            last = {"description": description(line), "diagnostics": []}
            out.run += 1
            out.failures.append(last)
        elif line.startswith("#") and last is not None:
            last["diagnostics"].append(line[1:].strip())
    return out


def touched(deps: DataFrame) -> DataFrame:
    """file, kind, name: the objects that tests may touch, from their dependencies (file, dep_class, name)."""
    kinds = F.create_map(*[x for c, k in KINDS.items() for x in (F.lit(c), F.array(*map(F.lit, k)))])
    return deps.select("file", F.explode(kinds[F.col("dep_class")]).alias("kind"), "name")


def impacted(tests: DataFrame, changed: DataFrame) -> DataFrame:
    """The distinct files of tests that touch a changed object (kind, name)."""
    return tests.join(changed.select("kind", "name").distinct(), ["kind", "name"], "left_semi").select("file").distinct()
