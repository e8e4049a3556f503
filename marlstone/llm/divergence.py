"""Source divergence audit: how far the term shares of sources stand apart, by K-squared quadtrees over the matrix of groups and terms.

A group is a (lang, source); a term is a run of letters, A-Z lower-cased. Each language keeps the terms that stand in at least LEAST of its rows. A
group of N occurrences among V kept terms gives a term of c occurrences the share p = 1 + floor(10^9 (c + 1) / (N + V)); the divergence of p from q
is floor((p - q)^2 / q). All arithmetic is exact.

1. Tasks count terms by group before anything is shuffled; sums of these are the nonzero cells of each language's matrix.
2. Columns (terms) are dealt to blocks of about CELLS cells by hash, whatever the number of groups. A task holds one block: columns are ordered so that
   those of equal groups stand together, and the cells become a K-squared tree (K = 2): at each level the quadrants that hold a cell; leaves
   are LEAF_ROWS x LEAF_COLUMNS. Languages of very many groups are cut into stripes of rows as well, so that a task returns about PAIRS sums.
3. The trees of all pairs of groups are walked jointly from the root: where both quadrants are all zero, the share depends on the group alone, so the
   quadrant's columns are only counted and priced at once; where one is not, their four quarters follow, down to the leaves, which are
   computed cell by cell.
4. Sums of blocks are added by pair, and ranked. The closest terms of each group are ranked among its nonzero cells; only a group's first TOP rows of
   each task reach the window.

Defined cases: null text, lang and source are empty strings; every row counts as a document, repeated rows and equal or null doc_ids too; a group without
terms, or in a language without kept terms, has its pairs (of value 0 if V is 0) and no terms; one source alone in its language has no pairs; ties are
ranked by the item's bytes; an empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, lean, staged, table

#: Documents that a kept term stands in at least, terms listed for each group, and the unit of shares.
LEAST, TOP, UNIT = 3, 200, 1_000_000_000
#: Cells of a block of columns, sums that a task returns, and entries that a worker counts before it passes them on.
CELLS, PAIRS, FLUSH = 1 << 17, 1 << 18, 1 << 18
LEAF_ROWS, LEAF_COLUMNS = 8, 64

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (rows that hold it), summed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            many = pa.array(np.repeat(np.arange(len(held)), [len(own) for own in held.values()]))
            names = [pa.array([group[k] for group in held], pa.string()).take(many) for k in (0, 1)]
            terms = pa.array([t for own in held.values() for t in own], pa.binary()).cast(pa.string())
            both = np.fromiter((x for own in held.values() for x in own.values()), np.int64, len(many))
            held.clear()
            yield pa.record_batch([*names, terms, pa.array(both >> 32), pa.array(both & 0xFFFFFFFF)], names=["lang", "source", "term", "n", "d"])

        entries = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                own = held.setdefault((lang, source), {})
                before = len(own)
                for term, n in Counter(text.as_py().translate(LETTERS).split()).items():
                    own[term] = own.get(term, 0) + (n << 32 | 1)
                entries += len(own) - before + 1
                if entries > FLUSH:
                    yield from out()
                    entries = 0
        yield from out()

    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partly = named.mapInArrow(lean(read), "lang string, source string, term string, n bigint, d bigint")
    return partly.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column | int, total: Column) -> Column:
    """1 + floor(UNIT (n + 1) / total), exactly."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)")) + 1


def shares(n: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same for arrays: a long division in base 1000, for totals up to 9 * 10^15."""
    whole, rest = np.divmod(n + 1, totals)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Quadtree:
    """Which quadrants of a matrix of cells hold one, level by level from the leaves up."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int):
        self.rows, self.columns = -(-n_rows // LEAF_ROWS), -(-n_columns // LEAF_COLUMNS)
        self.height = max(0, int(max(self.rows, self.columns) - 1).bit_length())
        r, c = rows // LEAF_ROWS, columns // LEAF_COLUMNS
        self.leaf_of = self._code(r, c)
        self.levels = [np.unique(self.leaf_of)]
        for _ in range(self.height):
            below = self.levels[-1]
            self.levels.append(np.unique(self._code((below >> 32) >> 1, (below & 0xFFFFFFFF) >> 1)))

    @staticmethod
    def _code(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return r.astype(np.int64) << 32 | c.astype(np.int64)

    def find(self, level: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The number of each quadrant among those of its level that hold a cell; -1 where it is all zero."""
        codes, known = self._code(r, c), self.levels[level]
        if not len(known):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, at, -1)

    def jointly(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, row a, row b, column, leaf a, leaf b) where a walk ends, for leaf rows a from first to last - 1 and all b.

        It ends where both quadrants are all zero (leaf a and leaf b are -1) at any level, and at level 0.
        """
        level, a, b, c = self.height, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            fit = (a << level < last) & (a + 1 << level > first) & (b << level < self.rows) & (c << level < self.columns)
            a, b, c = a[fit], b[fit], c[fit]
            x, y = self.find(level, a, c), self.find(level, b, c)
            done = (x < 0) & (y < 0) | (level == 0)
            yield level, a[done], b[done], c[done], x[done], y[done]
            if level == 0:
                return
            a, b, c = a[~done], b[~done], c[~done]
            turn = np.arange(8)
            a, b, c = ((2 * v[:, None] + (turn >> k & 1)).ravel() for v, k in ((a, 2), (b, 1), (c, 0)))
            level -= 1


def pair_sums(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, totals: np.ndarray, n_columns: int, first: int, last: int) -> np.ndarray:
    """The divergences of groups first to last - 1 (whole leaf rows) from all groups, summed over the columns; cells are (row, column, count)."""
    n = len(totals)
    tree = Quadtree(rows, columns, n, n_columns)
    zero = np.ones(tree.rows * LEAF_ROWS, np.int64)
    zero[:n] = shares(np.zeros(n, np.int64), totals)
    # leaves: shares of cells, those of no occurrence elsewhere, and 1 (which prices to 0) beyond the last column
    real = (np.arange(tree.columns * LEAF_COLUMNS) < n_columns).reshape(-1, 1, LEAF_COLUMNS)
    flat = lambda r, c: np.where(real[c], zero.reshape(-1, LEAF_ROWS, 1)[r], 1)
    codes = tree.levels[0]
    leaves = flat(codes >> 32, codes & 0xFFFFFFFF)
    leaves[np.searchsorted(codes, tree.leaf_of), rows % LEAF_ROWS, columns % LEAF_COLUMNS] = shares(counts, totals[rows])
    low, high = first // LEAF_ROWS, -(-last // LEAF_ROWS)
    sums = np.zeros((high - low, tree.rows, LEAF_ROWS, LEAF_ROWS), np.int64)
    empty = np.zeros((high - low, tree.rows), np.int64)
    for level, a, b, c, x, y in tree.jointly(low, high):
        bare = (x < 0) & (y < 0)
        width = np.minimum((c[bare] + 1) * (LEAF_COLUMNS << level), n_columns) - c[bare] * (LEAF_COLUMNS << level)
        sides = -(-tree.rows >> level) + 1
        seen = np.zeros((sides, sides), np.int64)
        np.add.at(seen, (a[bare], b[bare]), width)
        empty += np.repeat(np.repeat(seen, 1 << level, 0)[low:high], 1 << level, 1)[:, : tree.rows]
        at = np.flatnonzero(~bare)
        for k in range(0, len(at), 128):
            i = at[k : k + 128]
            p = np.where((x[i] >= 0)[:, None, None], leaves[x[i]], flat(a[i], c[i]))
            q = np.where((y[i] >= 0)[:, None, None], leaves[y[i]], flat(b[i], c[i]))
            np.add.at(sums, (a[i] - low, b[i]), apart(p[:, :, None, :], q[:, None, :, :]).sum(axis=3))
    parts = zero.reshape(-1, LEAF_ROWS)
    sums += empty[:, :, None, None] * apart(parts[low:high, None, :, None], parts[None, :, None, :])
    return sums.transpose(0, 2, 1, 3).reshape((high - low) * LEAF_ROWS, -1)[: last - first, :n]


def _together(rows: np.ndarray, columns: np.ndarray, n_columns: int) -> np.ndarray:
    """New places of the columns: those of like groups side by side."""
    many = np.bincount(columns, minlength=n_columns)
    least, most = np.full(n_columns, 1 << 60), np.full(n_columns, -1)
    np.minimum.at(least, columns, rows)
    np.maximum.at(most, columns, rows)
    place = np.empty(n_columns, np.int64)
    place[np.lexsort((most, least, many))] = np.arange(n_columns)
    return place


def block_sums(cells: pa.Table) -> pa.Table:
    """lang, source, item and value of the pairs of one block and stripe; a row without a term is a group, with its total and the stripe's size."""
    groups = cells.filter(pc.is_null(cells.column("term"))).sort_by("source")
    cells = cells.filter(pc.is_valid(cells.column("term")))
    names = groups.column("source").combine_chunks()
    totals, n = groups.column("n").to_numpy(), len(names)
    rows = pc.index_in(cells.column("source"), names).to_numpy().astype(np.int64)
    columns = pc.dictionary_encode(cells.column("term").combine_chunks()).indices.to_numpy().astype(np.int64)
    n_columns = int(columns.max()) + 1 if len(columns) else 0
    if n_columns:
        columns = _together(rows, columns, n_columns)[columns]
    stripe, size = groups.column("stripe")[0].as_py(), groups.column("size")[0].as_py()
    first, last = min(n, stripe * size), min(n, (stripe + 1) * size)
    if n_columns and last > first:
        value = pair_sums(rows, columns, cells.column("n").to_numpy(), totals, n_columns, first, last)
    else:
        value = np.zeros((last - first, n), np.int64)
    a, b = np.nonzero(np.arange(first, last)[:, None] != np.arange(n))
    lang = pa.array([groups.column("lang")[0].as_py()]).take(pa.array(np.zeros(len(a), np.int64)))
    return pa.table([lang, names.take(pa.array(a + first)), names.take(pa.array(b)), pa.array(value[a, b])], names=["lang", "source", "item", "value"])


def divergences(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: how far every other source of the language is (part pair), and which terms stand out (part term)."""
    bound_batches(docs.sparkSession)
    cells = staged(counted(docs), "cells")
    terms = cells.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("d").alias("all_d")).filter(F.col("all_d") >= LEAST).drop("all_d")
    kept = staged(cells.drop("d").join(terms, ["lang", "term"]), "kept")
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    # stored, so that Spark knows their sizes: a row a group, a row a language
    groups = named.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("of_group"), F.count(F.lit(1)).alias("held")), ["lang", "source"], "left").na.fill(0)
    groups = staged(groups, "groups")
    words = kept.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("of_lang"), F.count(F.lit(1)).alias("v"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("held").alias("cells")).join(words, "lang", "left").na.fill(0)
    size = F.expr(f"greatest({LEAF_ROWS}, {PAIRS} div sources div {LEAF_ROWS} * {LEAF_ROWS})")
    langs = langs.withColumn("size", size).withColumn("blocks", F.expr(f"greatest(1, ceil(cells / {CELLS}))")).withColumn("stripes", F.expr("ceil(sources / size)"))
    langs = staged(langs, "langs")

    dealt = lambda block: [block.alias("block"), F.explode(F.expr("sequence(0L, stripes - 1)")).alias("stripe")]
    laid = kept.join(langs, "lang").select("lang", "source", "term", "n", "size", *dealt(F.pmod(F.xxhash64("term"), F.col("blocks"))))
    every = groups.join(langs, "lang").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    every = every.select("lang", "source", F.lit(None).cast("string").alias("term"), (F.col("of_group") + F.col("v")).alias("n"), "size", *dealt(F.col("block")))
    parts = laid.unionByName(every).groupBy("lang", "block", "stripe").applyInArrow(lean_table(block_sums), "lang string, source string, item string, value bigint")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share(F.col("n"), F.col("of_group") + F.col("v")), share(F.col("all_n"), F.col("of_lang") + F.col("v"))
    told = kept.join(groups.drop("held"), ["lang", "source"]).join(langs.select("lang", "v", "of_lang"), "lang")
    above = told.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    named_part = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named_part(pairs.withColumn("rank", rank), "pair").unionByName(named_part(above.withColumn("rank", rank).filter(F.col("rank") <= TOP), "term"))


def lean_table(work):
    """work over one group, as a function that Spark can send: memory is released after it."""

    def run(group: pa.Table) -> pa.Table:
        return next(lean(lambda tables: map(work, tables))(iter([group])))

    return run


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources of a language, and up to 200 terms of each group, by divergence."""
    return divergences(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents),
seen AS (SELECT lang, source, id, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM seen GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM seen SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source) USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
