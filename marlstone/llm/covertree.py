"""Exact cosine near-duplicates by dual traversal of cover trees.

Vectors are scaled to length 1 in double precision, so a cosine of 0.9 or more is a distance of at most sqrt(0.2). Equal unit vectors
are one class with a count. Classes are dealt to blocks of about BLOCK rows by the nearest of some pivots (a bounded sample of the
classes), large cells being split by hash; each block becomes one cover tree, stored in one row: nested levels of nodes with halving
radii, each with the true radius that covers its points. Blocks are gathered around some of their own centres; pairs of such gatherings, and then
pairs of their blocks, are dropped by covering radii, and every pair of blocks that is left is traversed at once: a pair of nodes is dropped where the distance of its centres is over both radii and the limit, counted whole where it is
under the limit with both radii, and opened otherwise. At the leaves the dot products are taken in double precision.
Tasks return counts for each class and its component within the pair of blocks, never all pairs. Vectors of each length are compared among
themselves.

Defined cases: a vector that is null, zero, empty or that holds a null or non-finite component links with nothing; a row whose vec_id is null links
with nothing either; vectors of different lengths never link; rows of one vec_id are one node; repeated rows link with each other; an empty table
gives no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, staged, table
from .components import components

COSINE = 0.9
#: Rows of a block, and pivots that deal rows to blocks (a sample of the classes by hash; it decides speed, not results).
BLOCK, MOST_PIVOTS = 4096, 1024
#: Gatherings of blocks whose centres and radii are compared on the driver.
MOST_GATHERINGS = 2048
LINKS = "a long, b long, links long"
#: Radii of the levels below the root, whose own is 2 at most. Below 0.5, few unrelated vectors share a node.
RADII = tuple(2.0**-k for k in range(1, 7))
#: Pairs of nodes that are looked at together, and the radius below which a node is a tight one.
PAIRS, TIGHT = 1 << 15, 0.02
#: Slack of all bounds, far above rounding errors and far below distances that matter.
SLACK = 1e-5


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the place of its centre: centres are over radius apart, points within radius of theirs. The first is a centre."""
    centre = np.full(len(points), -1)
    chosen = np.empty(0, np.int64)
    limit = 1 - radius * radius / 2
    points = points.astype(np.float32)
    for at in range(0, len(points), 512):
        part = points[at : at + 512]
        own = np.full(len(part), -1)
        for lo in range(0, len(chosen), 2048):
            some = chosen[lo : lo + 2048]
            free = np.flatnonzero(own < 0)
            if len(free):
                near = part[free] @ points[some].T
                ok = np.flatnonzero(near.max(1) >= limit)
                own[free[ok]] = some[near[ok].argmax(1)]
        free = np.flatnonzero(own < 0)
        if len(free):
            near = part[free] @ part[free].T >= limit
            left = np.ones(len(free), bool)
            fresh = []
            for k in range(len(free)):
                if left[k]:
                    mine = near[k] & left
                    mine[k] = True
                    own[free[mine]] = at + free[k]
                    left &= ~mine
                    fresh.append(at + free[k])
            chosen = np.concatenate([chosen, fresh])
        centre[at : at + 512] = own
    return centre


class CoverTree:
    """Levels of nodes over points in an order in which every node is a range. Level 0 is the root, the last one the leaves.

    starts[l] has the first point, the centre, of every node of level l and, at its end, the number of points; radius[l] the distance from the centre to
    the farthest point of the node. A node's centre is the centre of one of its children.
    """

    def __init__(self, order: np.ndarray, starts: list[np.ndarray], points: np.ndarray, radius: list[np.ndarray] | None = None):
        self.order, self.starts, self.points = order, starts, points
        self.rough = points.astype(np.float32)
        self.radius = radius or []
        for s in starts if radius is None else ():
            sizes = np.diff(s)
            d2 = 2 - 2 * np.einsum("ij,ij->i", points, np.repeat(points[s[:-1]], sizes, axis=0))
            self.radius.append(np.sqrt(np.maximum(np.maximum.reduceat(d2, s[:-1]), 0)) if len(points) else np.empty(0))

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        order = np.arange(len(points))
        starts = [np.array([0, len(points)])]
        for radius in RADII:
            cuts = [np.array([0])]
            for lo, hi in zip(starts[-1][:-1], starts[-1][1:], strict=True):
                if hi - lo == 1:
                    cuts.append(np.array([hi]))
                    continue
                own = net(points[order[lo:hi]], radius)
                put = np.lexsort((np.arange(hi - lo) != own, own))  # a centre stands first in its node; the node's own centre stays first
                order[lo:hi] = order[lo:hi][put]
                cuts.append(lo + np.append(np.flatnonzero(np.diff(own[put])) + 1, hi - lo))
            starts.append(np.concatenate(cuts))
        return cls(order, starts, points[order])


def dual(x: CoverTree, y: CoverTree, cosine: float = COSINE, same: bool = False) -> Iterator[tuple]:
    """Ranges (a, b, c, d) of x and y all of whose pairs link, and pairs of arrays (i, j) that do, by place in the trees' order.

    same: x is y; each pair of points comes once then, besides whole nodes with themselves.
    """
    limit = math.sqrt(2 - 2 * cosine)
    todo = [(0, np.array([0]), np.array([0]))]  # node pairs of one level
    last = len(x.starts) - 1
    while todo:
        level, a, b = todo.pop()
        if len(a) > PAIRS:
            todo += [(level, a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)]
            continue
        xs, ys = x.starts[level], y.starts[level]
        d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x.points[xs[a]], y.points[ys[b]]), 0))
        reach = x.radius[level][a] + y.radius[level][b]
        inside = d + reach <= limit - SLACK
        inside &= (xs[a + 1] - xs[a]) * (ys[b + 1] - ys[b]) > 1
        for p, q in zip(a[inside], b[inside], strict=True):
            yield xs[p], xs[p + 1], ys[q], ys[q + 1]
        keep = (d - reach <= limit + SLACK) & ~inside
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        sizes = (xs[a + 1] - xs[a]) * (ys[b + 1] - ys[b])
        if level == last:
            alone = sizes == 1
            i, j = xs[a[alone]], ys[b[alone]]
            ok = np.einsum("ij,ij->i", x.points[i], y.points[j]) >= cosine
            if same:
                ok &= i < j
            yield i[ok], j[ok]
            for p, q in zip(a[~alone], b[~alone], strict=True):
                i, j = np.nonzero(x.points[xs[p] : xs[p + 1]] @ y.points[ys[q] : ys[q + 1]].T >= cosine)
                i, j = i + xs[p], j + ys[q]
                if same:
                    i, j = i[i < j], j[i < j]
                yield i, j
            continue
        nx, ny = x.starts[level + 1], y.starts[level + 1]
        xr, yr = x.radius[level + 1], y.radius[level + 1]
        lo_a, lo_b = np.searchsorted(nx, xs[a]), np.searchsorted(ny, ys[b])
        n_a, n_b = np.searchsorted(nx, xs[a + 1]) - lo_a, np.searchsorted(ny, ys[b + 1]) - lo_b
        few = n_a * n_b <= 64
        # pairs of few children: all of them, at once
        each = (n_a * n_b)[few]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        of_b = np.repeat(n_b[few], each)
        i, j = np.repeat(lo_a[few], each) + at // np.maximum(of_b, 1), np.repeat(lo_b[few], each) + at % np.maximum(of_b, 1)
        if same:
            i, j = i[i <= j], j[i <= j]
        if len(i):
            todo.append((level + 1, i, j))
        for k in np.flatnonzero(~few):
            ca, cb = np.arange(lo_a[k], lo_a[k] + n_a[k]), np.arange(lo_b[k], lo_b[k] + n_b[k])
            # tight nodes and wide ones apart: the bound of a sheet is that of its widest nodes
            for some_b in (cb[yr[cb] < TIGHT], cb[yr[cb] >= TIGHT]):
                far = y.rough[ny[some_b]].T
                for wide in (False, True):
                    mine = ca[(xr[ca] >= TIGHT) == wide]
                    for begin in range(0, len(mine) if len(some_b) else 0, 512):
                        some = mine[begin : begin + 512]
                        reach = min(2.0, limit + xr[some].max() + yr[some_b].max() + SLACK)
                        i, j = np.nonzero(x.rough[nx[some]] @ far >= 1 - reach * reach / 2 - SLACK)
                        i, j = some[i], some_b[j]
                        if same:
                            i, j = i[i <= j], j[i <= j]
                        if len(i):
                            todo.append((level + 1, i, j))


class Joined:
    """Components of numbered nodes, by arrays of links; a node's label is the least node of its component."""

    def __init__(self, nodes: int):
        self.label, self.held, self.n = np.arange(nodes), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i, j))
        self.n += len(i)
        if self.n > 1 << 17:
            self.labels()

    def labels(self) -> np.ndarray:
        i, j = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (self.label[:0],) * 2
        self.held, self.n = [], 0
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return self.label
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (up := self.label[self.label])[self.label != up].size:
                self.label = up


def links_between(x: CoverTree, ids_x: np.ndarray, n_x: np.ndarray, y: CoverTree, ids_y: np.ndarray, n_y: np.ndarray, same: bool, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links of each to vectors of other classes, and pairs a, b that join the components of these links)."""
    gain_x, gain_y = np.zeros(len(ids_x) + 1, np.int64), np.zeros(len(ids_y) + 1, np.int64)
    own_x, own_y = np.zeros(len(ids_x), np.int64), np.zeros(len(ids_y), np.int64)
    sums_x, sums_y = np.concatenate([[0], np.cumsum(n_x)]), np.concatenate([[0], np.cumsum(n_y)])
    joined, shift = Joined(len(ids_x) + (0 if same else len(ids_y))), 0 if same else len(ids_x)
    for got in dual(x, y, cosine, same):
        if len(got) == 4:
            a, b, c, d = map(int, got)
            gain_x[a] += sums_y[d] - sums_y[c]
            gain_x[b] -= sums_y[d] - sums_y[c]
            if same and a == c:  # a node counted whole with itself counts each class once too often
                own_x[a:b] -= n_x[a:b]
            else:
                gain_y[c] += sums_x[b] - sums_x[a]
                gain_y[d] -= sums_x[b] - sums_x[a]
            joined.add(np.full(d - c, a), np.arange(c, d) + shift)
            joined.add(np.arange(a, b), np.full(b - a, c + shift))
        elif len(got[0]):
            i, j = got
            np.add.at(own_x, i, n_y[j])
            np.add.at(own_y, j, n_x[i])
            joined.add(i, j + shift)
    ids, n = np.concatenate([ids_x, ids_y]), np.concatenate([np.cumsum(gain_x)[:-1] + own_x, np.cumsum(gain_y)[:-1] + own_y])
    label = joined.labels()
    moved = np.flatnonzero(label != np.arange(len(label)))
    return ids[n > 0], n[n > 0], ids[moved], ids[label[moved]]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and its unit vector as bytes (null where it links with nothing)."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for known, v in zip(batch.column("vec_id").is_valid(), batch.column("embedding"), strict=True):
                x = None
                if known.as_py() and v.is_valid and v.values is not None and not v.values.null_count and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    if not np.isfinite(top) or not top:
                        x = None
                    else:
                        x = x / top  # keeps squares of extreme components finite
                        x /= np.sqrt(x @ x)
                        x += 0.0  # one zero
                out.append(None if x is None else x.tobytes())
            yield pa.record_batch([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "unit"])

    return vectors.select("vec_id", "embedding").mapInArrow(scale, "vec_id long, unit binary")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors."""
    spark = vectors.sparkSession
    bound_batches(spark, 5000)
    rows = staged(unit_vectors(vectors), "units")
    found = rows.filter("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    every = staged(found, "classes")
    widths = [r["w"] for r in every.select(F.length("unit").alias("w")).distinct().orderBy("w").collect()]  # lengths of vectors
    outs = [block_links(every.filter(F.length("unit") == w), w, cosine) for w in widths]
    out = reduce(DataFrame.unionByName, outs) if outs else spark.createDataFrame([], LINKS)
    joined = components(out.filter("b is not null").select("a", "b"))
    linked = out.groupBy("a").agg(F.sum("links").alias("links"))
    by_class = every.join(linked, F.col("rep") == F.col("a"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    by_class = by_class.select(F.col("unit").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    told = rows.join(by_class, F.col("unit") == F.col("of"), "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return told.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def gathered_pairs(heads: DataFrame, limit: float) -> DataFrame:
    """(block_x, block_y), block_x <= block_y, of the blocks that may hold links; heads (stored): block, middle, reach.

    Each block goes to the nearest of some blocks' middles, MOST_GATHERINGS at most; pairs of gatherings are told apart by covering radii
    first, so that pairs of blocks are only made of near gatherings.
    """
    spark, blocks = heads.sparkSession, heads.count()
    some = heads.orderBy(F.xxhash64("block"), "block").limit(min(MOST_GATHERINGS, math.isqrt(max(blocks, 1) - 1) + 1)).collect()
    centres = np.array([r["middle"] for r in some]).reshape(len(some), -1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("middle").flatten().to_numpy().reshape(batch.num_rows, -1)
            dots = x @ centres.T if batch.num_rows else np.empty((0, 1))
            best = dots.argmax(1)
            far = np.sqrt(np.maximum(2 - 2 * dots[np.arange(len(best)), best], 0)) + batch.column("reach").to_numpy()
            yield pa.record_batch([batch.column("block"), batch.column("middle"), batch.column("reach"), pa.array(best.astype(np.int32)), pa.array(far)], names=["block", "middle", "reach", "gathering", "far"])

    near = staged(heads.mapInArrow(nearest, "block int, middle array<double>, reach double, gathering int, far double"), "gathered")
    radius = np.zeros(len(some))
    for r in near.groupBy("gathering").agg(F.max("far").alias("far")).collect():  # MOST_GATHERINGS rows at most
        radius[r["gathering"]] = r["far"]
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    p, q = np.nonzero(np.triu(apart <= radius[:, None] + radius[None, :] + limit + SLACK))
    pairs = spark.createDataFrame(pa.table({"p": pa.array(p.astype(np.int32)), "q": pa.array(q.astype(np.int32))}))
    x, y = (near.select(F.col("gathering").alias(g), *[F.col(c).alias(f"{c}_{s}") for c in ("block", "middle", "reach")]) for s, g in (("x", "p"), ("y", "q")))
    between = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with("middle_x", "middle_y", lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)))
    both = pairs.join(x, "p").join(y, "q").filter("p != q or block_x <= block_y").filter(between <= F.col("reach_x") + F.col("reach_y") + limit + SLACK)
    return both.select(F.least("block_x", "block_y").alias("block_x"), F.greatest("block_x", "block_y").alias("block_y"))


def block_links(classes: DataFrame, width: int, cosine: float) -> DataFrame:
    """(a, b, links), stored: links of class a to vectors of other classes, or a pair a, b of one component. classes: of vectors of width bytes."""
    spark = classes.sparkSession
    total = classes.count()
    n_pivots = min(MOST_PIVOTS, max(1, 2 * total // BLOCK))
    pivots = np.array([np.frombuffer(r["unit"], np.float64) for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(n_pivots).collect()]).reshape(-1, width // 8)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(-1, width // 8)
            best = (x @ pivots.T).argmax(1).astype(np.int32) if len(x) else np.empty(0, np.int32)
            yield pa.record_batch([batch.column("rep"), batch.column("n"), batch.column("unit"), pa.array(best)], names=["rep", "n", "unit", "cell"])

    dealt = staged(classes.select("rep", "n", "unit").mapInArrow(nearest, "rep long, n long, unit binary, cell int"), "dealt")
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # MOST_PIVOTS rows at most
    # small cells share a block, large ones are split
    plan, block, held = [], 0, 0
    for cell, n in sorted(sizes.items()):
        if n > BLOCK // 2:
            parts = -(-n // BLOCK)
            plan.append((cell, block + 1, parts))
            block, held = block + parts + 1, 0
        else:
            if held + n > BLOCK:
                block, held = block + 1, 0
            plan.append((cell, block, 1))
            held += n
    blocks = dealt.join(F.broadcast(spark.createDataFrame(plan, "cell int, first int, parts int")), "cell").select("rep", "n", "unit", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int").alias("block"))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        x = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(-1, width // 8)
        tree = CoverTree.build(x)
        starts = np.concatenate([[len(s) for s in tree.starts], *tree.starts]).astype(np.int64)
        ids, n = (group.column(c).to_numpy()[tree.order].astype(np.int64) for c in ("rep", "n"))
        middle = x.mean(0)
        middle /= max(np.sqrt(middle @ middle), 1e-300)
        reach = float(np.sqrt(np.maximum(2 - 2 * (x @ middle), 0)).max())
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "points": pa.array([tree.points.tobytes()], pa.binary()), "starts": pa.array([starts.tobytes()], pa.binary()), "radii": pa.array([np.concatenate(tree.radius).tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()), "ns": pa.array([n.tobytes()], pa.binary()), "middle": [middle.tolist()], "reach": [reach]})

    trees = staged(blocks.groupBy("block").applyInArrow(build, "block int, points binary, starts binary, radii binary, ids binary, ns binary, middle array<double>, reach double"), "trees")
    pairs = staged(gathered_pairs(trees.select("block", "middle", "reach"), math.sqrt(2 - 2 * cosine)), "pairs").repartition("block_x", "block_y")
    parts = ("points", "starts", "radii", "ids", "ns")
    both = pairs.join(trees.select(F.col("block").alias("block_x"), *[F.col(c).alias(f"{c}_x") for c in parts]), "block_x").join(trees.select(F.col("block").alias("block_y"), *[F.col(c).alias(f"{c}_y") for c in parts]), "block_y")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = {c: batch.column(c)[k] for c in batch.schema.names}
                sides = []
                for s in "xy":
                    points = np.frombuffer(got[f"points_{s}"].as_buffer(), np.float64).reshape(-1, width // 8)
                    flat = np.frombuffer(got[f"starts_{s}"].as_buffer(), np.int64)
                    cut = np.cumsum(flat[: len(RADII) + 1])[:-1]
                    starts = np.split(flat[len(RADII) + 1 :], cut)
                    radii = np.split(np.frombuffer(got[f"radii_{s}"].as_buffer(), np.float64), np.cumsum([len(x) - 1 for x in starts])[:-1])
                    sides.append((CoverTree(np.arange(len(points)), starts, points, radii), np.frombuffer(got[f"ids_{s}"].as_buffer(), np.int64), np.frombuffer(got[f"ns_{s}"].as_buffer(), np.int64)))
                ids, n, a, b = links_between(*sides[0], *sides[1], got["block_x"].as_py() == got["block_y"].as_py(), cosine)
                told = np.arange(len(ids) + len(a)) < len(ids)
                yield pa.record_batch([pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([np.zeros(len(ids), np.int64), b]), mask=told), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))], names=["a", "b", "links"])

    bound_batches(spark, 1)  # a row holds two trees
    out = staged(both.mapInArrow(traverse, LINKS), "links")
    bound_batches(spark, 5000)
    discard(dealt, trees)
    return out


OP5_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id, vec_id AS least FROM embeddings UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(least) AS component_id, vec_id = min(least) AS kept FROM r GROUP BY vec_id
"""


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
