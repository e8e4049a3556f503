"""Aggregates of any state function: folds in bounded chunks, whose states a combine function puts together.

A group's rows are dealt to chunks of about CHUNK rows; each is folded where it lies, by an expression inside Spark's own `aggregate`, and the states of up to FAN chunks
are combined at a time until a group has one: a group of n rows takes log n / log FAN rounds, and no task holds more than a chunk of it. Without a
combine function a fold is one chain by nature: chunks follow each other in the order that is given, a round a chunk, each joined with the state that the
one before it has left.

Defined cases: rows of null keys are a group; a group's values may be null, and the state function sees them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Rows that are folded in one piece, and states that are combined at once.
CHUNK, FAN = 10_000, 100
Inlined = Callable[..., str]


def _same(keys: list[str]) -> str:
    return " AND ".join(f"a.`{k}` <=> b.`{k}`" for k in keys) or "true"


def folded(df: DataFrame, keys: list[str], column: str, first: str, step: Inlined, combine: Inlined | None = None, final: Inlined | None = None, order: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """keys and value: what folding column over each group gives. first is the first state as an expression; step(state, value), combine(a, b) and final(state) give expressions.

    Without combine, rows are folded by order (then by value, so that a result does not depend on where rows lie).
    """
    fold = lambda values, start: F.expr(f"aggregate({values}, {start}, (acc, x) -> {step('acc', 'x.v')})")
    ends = lambda state: F.expr(final(state)) if final else F.expr(state)
    rows = df.select(*keys, F.col(column).alias("v"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order or [])])
    if combine is None:
        by = [*[f"_o{k}" for k in range(len(order or []))], "v"]
        place = F.row_number().over(Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*by)) if keys else F.row_number().over(Window.orderBy(*by))
        dealt = rows.withColumn("_n", place).groupBy(*keys, F.floor((F.col("_n") - 1) / chunk).alias("_c"))
        chunks = stored(dealt.agg(F.array_sort(F.collect_list(F.struct("_n", "v"))).alias("xs")))
        last = chunks.agg(F.max("_c")).first()[0]
        states = chunks.filter("_c = 0").select(*keys, fold("xs", first).alias("s"))
        for c in range(1, (last or 0) + 1):
            now = chunks.filter(F.col("_c") == c).alias("b")
            met = states.alias("a").join(now, F.expr(_same(keys)), "left")
            states = stored(met.select(*[F.col(f"a.{k}") for k in keys], F.when(F.col("b.xs").isNull(), F.col("a.s")).otherwise(fold("b.xs", "a.s")).alias("s")))
        return states.select(*keys, ends("s").alias("value"))
    # places are written down, so that a task that runs again deals rows as before
    placed = stored(rows.withColumn("_i", F.monotonically_increasing_id()))
    sizes = stored(placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_chunks")))
    most = sizes.agg(F.max("_chunks")).first()[0] or 1
    hot = F.broadcast(sizes.filter("_chunks > 1").limit(CHUNK)) if most > 1 else None  # the largest groups need not be shuffled to be cut
    if hot is None:
        dealt = placed.withColumn("_c", F.lit(0))
    elif sizes.filter("_chunks > 1").count() <= CHUNK:
        dealt = placed.alias("a").join(hot.alias("b"), F.expr(_same(keys)), "left").select("a.*", F.pmod(F.xxhash64("a._i"), F.coalesce("b._chunks", F.lit(1))).alias("_c"))
    else:
        dealt = placed.alias("a").join(sizes.alias("b"), F.expr(_same(keys))).select("a.*", F.pmod(F.xxhash64("a._i"), F.col("b._chunks")).alias("_c"))
    states = dealt.groupBy(*keys, "_c").agg(F.collect_list(F.struct("v")).alias("xs")).select(*keys, "_c", fold("xs", first).alias("s"))
    while most > 1:
        merged = F.expr(f"aggregate(slice(ss, 2, size(ss)), ss[0].s, (acc, x) -> {combine('acc', 'x.s')})")
        states = states.groupBy(*keys, F.floor(F.col("_c") / FAN).alias("_c")).agg(F.collect_list(F.struct("s")).alias("ss")).select(*keys, "_c", merged.alias("s"))
        most = -(-most // FAN)
    return states.select(*keys, ends("s").alias("value"))
