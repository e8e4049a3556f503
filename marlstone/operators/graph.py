"""Dependency graphs as DataFrames: edges, neighbours, closures, levels and cycles.

edges has src (what is depended on), dst (the dependent) and kind (hard or soft). Loops run on the driver over stored frames; what they collect is a
count a round. Nodes are plain keys: strings or numbers; in closures and levels a null is no node, and edges from or to it are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.idents import TARGETS
from .storage import stored


#: Rows up to which a graph that is known to be small, as the objects of a project, may be walked on the driver.
FEW = 50_000


class CycleError(ValueError):
    """Nodes that depend on each other in a circle."""


def edges_of(objects: DataFrame, deps: DataFrame, functions_are_soft: bool = True) -> DataFrame:
    """src, dst, kind of every dependency that an object meets: the first object, in seq order, of a fitting kind and the same spelling.

    objects: object_type, state_name, schema, name, trigger_table, seq; deps: object_type, state_name, dep_class, dep_schema, dep_name.
    A function that is called by a function or procedure is a soft edge, all others are hard. Equal edges stay apart.
    """
    allowed = F.create_map(*[x for c, kinds in TARGETS.items() for x in (F.lit(c), F.array(*map(F.lit, kinds)))])
    target = objects.select(F.col("object_type").alias("t_type"), F.col("state_name").alias("t_name"), F.col("schema").alias("t_schema"), F.col("name").alias("t_bare"), F.col("seq").alias("t_seq"))
    met = deps.withColumn("dep_id", F.monotonically_increasing_id()).join(target, F.col("dep_schema").eqNullSafe(F.col("t_schema")) & (F.col("dep_name") == F.col("t_bare")) & F.array_contains(allowed[F.col("dep_class")], F.col("t_type")))
    first = met.withColumn("rank", F.row_number().over(Window.partitionBy("dep_id").orderBy("t_seq"))).filter("rank = 1")
    soft = (F.col("dep_class") == "function") & F.col("object_type").isin("function", "procedure") & F.lit(functions_are_soft)
    node = lambda kind, name: F.concat_ws("::", kind, name)
    found = first.select(node("t_type", "t_name").alias("src"), node("object_type", "state_name").alias("dst"), F.when(soft, "soft").otherwise("hard").alias("kind"))
    comments = objects.filter("object_type = 'comment' and name like 'trigger:%'").select(F.col("state_name").alias("c_name"), F.split("name", ":", 3).alias("part"))
    triggers = objects.filter("object_type = 'trigger'").select(F.col("state_name").alias("t_name"), F.col("name").alias("t_bare"), F.col("trigger_table").alias("t_on"))
    on = comments.join(triggers, (F.col("part")[1] == F.col("t_bare")) & (F.col("part")[2] == F.col("t_on")))
    return found.union(on.select(node(F.lit("trigger"), "t_name"), node(F.lit("comment"), "c_name"), F.lit("hard")))


def neighbours(edges: DataFrame, node, direction: str = "dependents", kind: str | None = None) -> DataFrame:
    """The direct dependents or dependencies of a node."""
    a, b = ("src", "dst") if direction == "dependents" else ("dst", "src")
    rows = edges.filter(F.col(a) == F.lit(node))
    return (rows if kind is None else rows.filter(F.col("kind") == kind)).select(F.col(b).alias("node")).distinct()


def _few(df: DataFrame, most: int) -> list | None:
    """All rows of a frame of at most most rows, or None."""
    rows = df.limit(most + 1).collect() if most else []
    return rows if most and len(rows) <= most else None


def _jumped(chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of nodes with one source each, gone through by doubling: (what has come to its root, what goes round in a circle).

    chain: node, up, away, least; the level of a node is the greater one of least (or nothing) and that of up plus away. Afterwards up is the first
    node upwards that is not in chain, so that n nodes in a row take log n rounds.
    """
    n = chain.count()
    names = chain.select(F.col("node").alias("_n"))
    known = lambda df: df.join(names, F.col("up") == F.col("_n"), "left").withColumn("open", F.col("_n").isNotNull()).drop("_n")
    now = stored(known(chain))
    for _ in range(max(1, n).bit_length() + 1):
        if now.filter("open").isEmpty():
            break
        above = now.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("away").alias("_away"), F.col("least").alias("_least"), F.col("open").alias("_open"))
        met = now.filter("open").join(above, F.col("up") == F.col("_n"))
        moved = met.select("node", F.col("_up").alias("up"), (F.col("away") + F.col("_away")).alias("away"), F.greatest("least", F.col("_least") + F.col("away")).alias("least"), F.col("_open").alias("open"))
        now = stored(now.filter("not open").unionByName(moved))
    return now.filter("not open").drop("open"), now.filter("open").drop("open")


def _chain_of(todo: DataFrame, least: DataFrame) -> DataFrame:
    """node, up, away, least of the nodes with one source among todo (src, dst, away)."""
    one = todo.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("src").alias("up"), F.first("away").alias("away")).filter("n = 1").drop("n")
    return stored(one.join(least, "node", "left").select("node", "up", "away", "least"))


def closure(edges: DataFrame, seeds: DataFrame, with_seeds: bool = False, most_local: int = 0) -> DataFrame:
    """node: everything that hard edges reach from the seeds (a column node). Ends on cycles.

    Each round takes what the nodes of the last one reach, leaves out nodes that only unreached ones without sources lead to, and, from the third on,
    draws rows of nodes with one source together by doubling. For a graph that is known to be small, most_local (FEW) edges may be walked on the driver.
    """
    hard, first = edges.filter("kind = 'hard' and src is not null and dst is not null").select("src", "dst").distinct(), seeds.select("node").filter("node is not null").distinct()
    rows = _few(hard, most_local)
    starts = None if rows is None else _few(first, most_local)
    if starts is not None:
        below: dict = {}
        for r in rows:
            below.setdefault(r["src"], []).append(r["dst"])
        begun = [r["node"] for r in starts]
        seen, todo = set(begun), list(begun)
        while todo:
            for v in below.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return edges.sparkSession.createDataFrame([(v,) for v in seen if with_seeds or v not in set(begun)], f"node {first.schema['node'].dataType.simpleString()}")
    seen = stored(first)
    todo, front, hanging, rounds = stored(hard.join(seen, F.col("dst") == F.col("node"), "left_anti")), seen, [], 0
    while not front.isEmpty():
        reached = stored(todo.join(front, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct())
        seen = stored(seen.union(reached))
        open_ = todo.join(front, F.col("src") == F.col("node"), "left_anti").join(reached, F.col("dst") == F.col("node"), "left_anti")
        sources = open_.select(F.col("dst").alias("node")).union(reached).distinct()  # others lead nowhere that is reached
        todo, front, rounds = stored(open_.join(sources, F.col("src") == F.col("node"), "left_semi")), reached, rounds + 1
        if rounds > 2:
            chain = _chain_of(todo.withColumn("away", F.lit(1)), todo.select(F.col("dst").alias("node"), F.lit(None).cast("int").alias("least")).limit(0))
            if not chain.isEmpty():
                rooted, _ = _jumped(chain)  # nothing outside leads to a circle of nodes with one source
                hanging.append(rooted)
                up = rooted.select(F.col("node").alias("_n"), "up")
                rest = todo.join(chain.select(F.col("node").alias("_n")), F.col("dst") == F.col("_n"), "left_anti")
                todo = stored(rest.join(up, F.col("src") == F.col("_n"), "left").select(F.coalesce("up", "src").alias("src"), "dst").distinct())
    for rooted in reversed(hanging):
        seen = stored(seen.union(rooted.join(seen.withColumnRenamed("node", "up"), "up", "left_semi").select("node")))
    return seen if with_seeds else seen.join(first, "node", "left_anti")


def _named(found: list) -> CycleError:
    return CycleError("objects depend on each other in a circle: " + ", ".join(sorted(map(str, found))[:10]))


def cycles(edges: DataFrame, most_local: int = 0) -> DataFrame:
    """node, component: the nodes that stand on a cycle, with the greatest node of those that they reach and that reach them.

    Edges at either end of the graph are taken off for a few rounds; then every node takes the greatest name that reaches it, and those that lead back to the
    node of this name have its component. What is left is looked at again. A round follows one edge: meant for what `levels` could not place.
    """
    pairs = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    kind = f"node {edges.schema['src'].dataType.simpleString()}, component {edges.schema['src'].dataType.simpleString()}"
    rows = _few(pairs, most_local)
    if rows is not None:
        return edges.sparkSession.createDataFrame(_strong([(r["src"], r["dst"]) for r in rows]), kind)
    out = pairs.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left, found = stored(pairs.filter("src != dst")), []
    while not left.isEmpty():
        for _ in range(4):
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            left = stored(inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        colour = stored(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("c", F.col("node")))
        moved = True
        while moved:
            told = left.join(colour.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("d"))
            after = stored(colour.join(told, "node", "left").select("node", F.greatest("c", "d").alias("c"), (F.col("d") > F.col("c")).alias("up")))
            moved, colour = not after.filter("up").isEmpty(), after.drop("up")
        # backwards from the node that gave a colour, along edges of one colour
        same = left.join(colour.select(F.col("node").alias("src"), "c"), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("d")), "dst").filter("c = d").select("src", "dst", "c")
        same, back = stored(same), stored(colour.filter("node = c").select("node", "c"))
        front = back
        while not front.isEmpty():
            met = same.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "c").distinct()
            front = stored(met.join(back.select("node"), "node", "left_anti"))
            back = stored(back.union(front))
        found.append(back.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.collect_list("node").alias("nodes")).filter("n > 1").select(F.explode("nodes").alias("node"), F.col("c").alias("component")))
        gone = back.select("node")
        left = stored(left.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti"))
    for df in found:
        out = out.union(df)
    return out.groupBy("node").agg(F.max("component").alias("component"))


def _strong(pairs: list[tuple]) -> list[tuple]:
    """(node, greatest node of its component) of the nodes on cycles of a small graph."""
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index, low, path, out = {}, {}, [], []
    on = set()
    for start in after:
        if start in index:
            continue
        work = [(start, iter(after[start]))]
        index[start] = low[start] = len(index)
        path.append(start), on.add(start)
        while work:
            v, below = work[-1]
            for w in below:
                if w not in index:
                    index[w] = low[w] = len(index)
                    path.append(w), on.add(w)
                    work.append((w, iter(after[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(path.pop())
                        on.discard(part[-1])
                    if len(part) > 1 or v in after[v]:
                        out += [(w, max(part)) for w in part]
    return out


def levels(nodes: DataFrame, edges: DataFrame, most_local: int = 0) -> DataFrame:
    """node, level: the length of the longest way to a node from one without dependencies; CycleError, naming nodes that stand on a cycle, where there is none.

    Soft edges count. Each round draws rows of nodes with one open dependency together by doubling, and places the nodes without one: a chain of n
    nodes takes log n rounds, others as many as the graph has levels of nodes with several open dependencies. For a graph that is known to be small,
    most_local (FEW) nodes and edges may be walked on the driver.
    """
    every, pairs = nodes.select("node").filter("node is not null").distinct(), edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    rows = _few(pairs, most_local)
    names = None if rows is None else _few(every, most_local)
    if names is not None:
        waits = {r["node"]: 0 for r in names}
        after: dict = {}
        for r in rows:
            if r["src"] in waits and r["dst"] in waits:
                waits[r["dst"]] += 1
                after.setdefault(r["src"], []).append(r["dst"])
            elif r["dst"] in waits:
                waits[r["dst"]] += 1  # on a node that is never placed
        level = {v: 0 for v, n in waits.items() if not n}
        todo = list(level)
        for v in todo:
            for w in after.get(v, ()):
                waits[w] -= 1
                if not waits[w]:
                    level[w] = level[v] + 1  # nodes come by level: v is the last of w's dependencies, and the deepest
                    todo.append(w)
        if len(level) < len(waits):
            raise _named([v for v, _ in _strong([(r["src"], r["dst"]) for r in rows])] or [v for v in waits if v not in level])
        return nodes.sparkSession.createDataFrame(list(level.items()), f"node {every.schema['node'].dataType.simpleString()}, level int")

    def circle(open_edges: DataFrame) -> CycleError:
        # names of nodes on a cycle: of an error, ten at most
        on = [r["node"] for r in cycles(open_edges).orderBy("node").limit(10).collect()]
        return _named(on or [r["dst"] for r in open_edges.select("dst").distinct().orderBy("dst").limit(10).collect()])

    left, todo, out, hanging = stored(every), stored(pairs.withColumn("away", F.lit(1)).join(every.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "away")), [], []
    least = stored(every.withColumn("least", F.lit(0)))
    while not left.isEmpty():
        chain = _chain_of(todo, least)
        if not chain.isEmpty():
            rooted, round_ = _jumped(chain)
            if not round_.isEmpty():
                # after as many steps as there are nodes, up stands on the circle
                raise _named([r["up"] for r in round_.select("up").distinct().orderBy("up").limit(10).collect()])
            hanging.append(rooted)
            up = rooted.select(F.col("node").alias("_n"), "up", F.col("away").alias("_away"), F.col("least").alias("_least"))
            rest = todo.join(chain.select(F.col("node").alias("_n")), F.col("dst") == F.col("_n"), "left_anti").join(up, F.col("src") == F.col("_n"), "left")
            rest = stored(rest.select(F.coalesce("up", "src").alias("src"), "dst", (F.col("away") + F.coalesce("_away", F.lit(0))).alias("away"), (F.col("_least") + F.col("away")).alias("least")))
            todo = stored(rest.groupBy("src", "dst").agg(F.max("away").alias("away")))
            left = stored(left.join(chain.select("node"), "node", "left_anti"))
            told = rest.filter("least is not null").select(F.col("dst").alias("node"), "least")
            least = stored(least.join(left, "node", "left_semi").unionByName(told).groupBy("node").agg(F.max("least").alias("least")))
        ready = stored(left.join(todo.select(F.col("dst").alias("node")), "node", "left_anti").join(least, "node", "left").select("node", F.coalesce("least", F.lit(0)).alias("level")))
        if ready.isEmpty() and chain.isEmpty():
            raise circle(todo)
        out.append(ready)
        left = stored(left.join(ready, "node", "left_anti"))
        told = todo.join(ready.select(F.col("node").alias("src"), "level"), "src").select(F.col("dst").alias("node"), (F.col("level") + F.col("away")).alias("least"))
        least = stored(least.join(left, "node", "left_semi").unionByName(told).groupBy("node").agg(F.max("least").alias("least")))
        todo = stored(todo.join(ready.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", "away"))
    placed = every.withColumn("level", F.lit(0)).limit(0)
    for ready in out:
        placed = placed.union(ready)
    for rooted in reversed(hanging):
        placed = stored(placed)
        placed = placed.union(rooted.join(placed.select(F.col("node").alias("up"), "level"), "up").select("node", F.greatest(F.coalesce("least", F.lit(0)), F.col("level") + F.col("away")).alias("level")))
    return placed.select("node", F.col("level").cast("int").alias("level"))


def has_cycle(nodes: DataFrame, edges: DataFrame, most_local: int = 0) -> bool:
    try:
        levels(nodes, edges, most_local)
    except CycleError:
        return True
    return False


def unsafe_deletions(edges: DataFrame, deleted: DataFrame, present: DataFrame) -> DataFrame:
    """src, dst: a node to be deleted and one that is not, is still defined by files, and depends on it."""
    gone = deleted.select(F.col("node").alias("src")).distinct()
    hit = edges.select("src", "dst").distinct().join(gone, "src")
    return hit.join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").join(present.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def counts(nodes: DataFrame, edges: DataFrame) -> tuple[int, int]:
    """How many nodes, and how many edges with equal ones apart."""
    return nodes.select("node").distinct().count(), edges.count()


#: Colour and shape of each kind in a drawing: fixed values.
LOOKS = {
    "table": ("lightcyan", "rect"), "view": ("lightblue", "box"), "materialized_view": ("darkblue", "box3d"), "function": ("lightgreen", "ellipse"), "procedure": ("darkgreen", "ellipse"), "type": ("lightyellow", "diamond"), "domain": ("lightcoral", "hexagon"),
    "index": ("lightgray", "trapezium"), "trigger": ("lightpink", "invtriangle"), "comment": ("lavender", "note"), "cron_job": ("orange", "octagon"), "aggregate": ("lightsteelblue", "triangle"), "operator": ("lightsalmon", "invhouse"),
}


def dot(nodes: list[str], edges: list[tuple[str, str, str]]) -> str:
    """A Graphviz drawing of nodes (kind::name) and edges (src, dst, kind): soft ones dashed."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = ["digraph dependency_graph {", "  rankdir=LR;"]
    for node in nodes:
        kind, _, name = node.partition("::")
        colour, shape = LOOKS.get(kind, ("white", "box"))
        out.append(f"  {quote(node)} [label={quote(name)}, shape={shape}, style=filled, fillcolor={colour}];")
    out += [f"  {quote(a)} -> {quote(b)} [style={'dashed' if kind == 'soft' else 'solid'}];" for a, b, kind in edges]
    return "\n".join([*out, "}"]) + "\n"
