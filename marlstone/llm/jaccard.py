"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two texts link when 100 * intersection >= 75 * union of their shingle sets. The work, none of it growing with the square of a group:

1. Texts with one set become one class, known by a 64-bit key of the set (checked by a second one).
2. Shingles are counted over all texts, in blocks of the hash range. The most frequent ones, at most MOST_HEAVY, are sent to the
   workers: any order of shingles gives right results, and rare ones first gives few candidates.
3. Each class keeps the first n - ceil(3n/4) + 1 of its n shingles in that order: the columns in which linked texts must meet.
4. Columns with a single class are dropped. Of the others, each class meets one class of each of its columns, the first in an order, and is compared by
   its whole set with the one that it meets in most: a row for each class, however many share a column. This is done for TURNS turns with
   another hash, for columns that still hold several components; most links of groups of near copies are known then.
5. The product of what is left of the incidence matrix is taken in blocks of columns and chunks of rows, for rows of different components and
   compatible sizes; the largest component of a column meets the others only, never itself. Counts of a pair are summed over the
   blocks, and pairs below the bound that the two sizes set are discarded. The rest are compared by their whole sets.
6. Components of all links; links inside a component that steps 4 and 5 left out change nothing.

Defined cases: a null or empty text, or one without words, has no shingles and links with nothing; a null doc_id is carried, and such
a row links with equal texts only; rows of one doc_id are one node; repeated rows are equal texts; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, lean, left_out, marked, partitions_for, release, staged, table, text_buffers
from .components import components
from .shingles import Shingler, U, set_key

#: Frequent shingles sent to the workers (8 bytes each), and the least count of one.
MOST_HEAVY, LEAST_HEAVY = 1 << 20, 10
#: Rows of one column that one block of the product holds; longer columns are cut into chunks, and pairs of chunks are blocks.
CHUNK = 400
#: First classes of more than CHUNK rows whose sizes are sent to the workers; more are joined.
MOST_LARGE = 100_000
#: Turns, at most, in which classes are compared with one class of their columns; there is a further one if many classes may gain by it.
TURNS = 3
#: Shingles that a worker gathers before it passes them on, and keys that it remembers to pass a set on once.
FLUSH, REMEMBERED = 1 << 19, 200_000


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _sets(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    shingler = Shingler(seed)
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for row, own in shingler.sets(data, offsets):
            yield batch, row, own


def _fresh(seen: set[int], key: int) -> bool:
    """Whether a worker has not passed this set on yet, as far as it remembers."""
    if key in seen:
        return False
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(key)
    return True


def shingle_sets(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, n_shingles, key and check of every text's set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(seed)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            rows = [(len(own), *set_key(own)) for _, own in shingler.sets(data, offsets)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_shingles", "key", "check"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(read), f"doc_id {kind}, n_shingles long, key long, check long")


def _block(tokens: np.ndarray, blocks: int) -> np.ndarray:
    return ((tokens >> U(40)) % U(blocks)).astype(np.int32)


def _print(tokens: np.ndarray, blocks: int) -> np.ndarray:
    """A shingle's block and low half, the name under which it is counted."""
    return _block(tokens, blocks).astype(np.int64) << 32 | (tokens & U(0xFFFFFFFF)).astype(np.int64)


def _cut(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each block's entries."""
    order = np.argsort(by, kind="stable")
    at = np.flatnonzero(np.diff(by[order], prepend=-1))
    for a, b in zip(at, [*at[1:], len(order)], strict=True):
        if b > a:
            yield int(by[order[a]]), order[a:b]


def frequent_shingles(docs: DataFrame, blocks: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Names and counts of the most frequent shingles, by name; at most MOST_HEAVY."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            names, counts = np.unique(_print(np.concatenate(held), blocks), return_counts=True)
            rows = []
            for block, at in _cut((names >> 32).astype(np.int32)):
                low, many = (names[at] & 0xFFFFFFFF).astype(np.uint32), counts[at].astype(np.uint32)
                rows.append((block, low[many == 1].tobytes(), low[many > 1].tobytes(), many[many > 1].tobytes()))
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "once", "more", "counts"])

        held, n = [], 0
        for _, _, own in _sets(batches, seed):
            if len(own) and _fresh(seen, set_key(own)[0]):
                held.append(own)
                n += len(own)
                if n >= FLUSH:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    def count(block: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(block.column("once").to_pylist()), np.uint32)
        more = np.frombuffer(b"".join(block.column("more").to_pylist()), np.uint32)
        times = np.frombuffer(b"".join(block.column("counts").to_pylist()), np.uint32)
        every, where = np.unique(np.concatenate([once, more]), return_inverse=True)
        total = np.bincount(where, np.concatenate([np.ones(len(once)), times]), len(every)).astype(np.int64)
        often = total >= LEAST_HEAVY
        name = (np.int64(block.column("block")[0].as_py()) << 32) | every[often].astype(np.int64)
        release()
        return pa.table({"name": pa.array(name, pa.int64()), "total": pa.array(total[often], pa.int64())})

    found = staged(docs.select("doc_id", "text").mapInArrow(lean(gather), "block int, once binary, more binary, counts binary").groupBy("block").applyInArrow(count, "name long, total long"), "frequent")
    sizes = sorted(found.groupBy(F.floor(F.log2("total")).alias("power")).count().collect(), reverse=True)  # 64 rows at most
    least, n = 1 << 62, 0
    for power, count_ in sizes:
        if n + count_ > MOST_HEAVY:
            break
        least, n = 1 << power, n + count_
    rows = found.filter(F.col("total") >= least).toPandas()  # MOST_HEAVY rows at most
    discard(found)
    order = np.argsort(rows["name"].to_numpy())
    return rows["name"].to_numpy()[order], rows["total"].to_numpy()[order]


def columns_in_common(docs: DataFrame, blocks: int, names: np.ndarray, totals: np.ndarray, seed: int = 0) -> DataFrame:
    """The incidence matrix that can hold links: token, key, n of each class and prefix column, less columns of one class."""
    sent = docs.sparkSession.sparkContext.broadcast((names, totals))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, counts = sent.value
        hint = np.zeros(1 << 22, bool)
        hint[heavy & ((1 << 22) - 1)] = True
        seen: set[int] = set()

        def rarest(own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            """The first n shingles, rare ones first, and whether each is a frequent one."""
            total = np.zeros(len(own), np.int64)
            maybe = np.flatnonzero(hint[(own & U((1 << 22) - 1)).astype(np.int64)])
            if len(maybe) and len(heavy):
                name = _print(own[maybe], blocks)
                at = np.minimum(np.searchsorted(heavy, name), len(heavy) - 1)
                total[maybe] = np.where(heavy[at] == name, counts[at], 0)
            if len(maybe):
                order = np.argsort(total, kind="stable")[:n]
                return own[order], total[order] > 0
            return own[:n], np.zeros(n, bool)

        def out(tokens: list, frequent: list, keys: list[int], sizes: list[int]) -> pa.RecordBatch:
            each = np.array([len(t) for t in tokens])
            token, key, size = np.concatenate(tokens), np.repeat(np.array(keys, np.int64), each), np.repeat(np.array(sizes, np.int32), each)
            # a frequent column is dealt by rows: any block may hold part of it
            by = np.where(np.concatenate(frequent), blocks + key % blocks, _block(token, blocks)).astype(np.int32)
            rows = [(block, token[at].tobytes(), key[at].tobytes(), size[at].tobytes()) for block, at in _cut(by)]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "tokens", "keys", "sizes"])

        held, n = ([], [], [], []), 0
        for _, _, own in _sets(batches, seed):
            if not len(own) or not _fresh(seen, key := set_key(own)[0]):
                continue
            for column, x in zip(held, (*rarest(own, prefix_size(len(own))), key, len(own)), strict=True):
                column.append(x)
            n += len(held[0][-1])
            if n >= FLUSH // 2:
                yield out(*held)
                held, n = ([], [], [], []), 0
        if n:
            yield out(*held)

    def meet(group: pa.Table) -> pa.Table:
        token, key, size = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("tokens", np.uint64), ("keys", np.int64), ("sizes", np.int32)))
        order = np.lexsort((key, token))
        token, key, size = token[order], key[order], size[order]
        new_token = np.diff(token, prepend=~token[:1]) != 0
        fresh = new_token | (np.diff(key, prepend=~key[:1]) != 0)
        token, key, size = token[fresh], key[fresh], size[fresh]
        if group.column("block")[0].as_py() < blocks:
            same = token[1:] == token[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            token, key, size = token[shared], key[shared], size[shared]
        release()
        return pa.table({"token": pa.array(token.view(np.int64)), "key": pa.array(key), "n": pa.array(size)})

    return docs.select("doc_id", "text").mapInArrow(lean(gather), "block int, tokens binary, keys binary, sizes binary").groupBy("block").applyInArrow(meet, "token long, key long, n int")


def mixed_columns(columns: DataFrame, owners: DataFrame) -> DataFrame:
    """The columns (token, key, n, kept, own) that hold classes of several components; owners: key, own of classes that are in one."""
    named = columns.drop("own").join(owners, "key", "left").withColumn("own", F.coalesce("own", "key"))
    several = named.groupBy("token").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo != hi").select("token")
    return named.join(several, "token").select("token", "key", "n", "kept", "own")


def first_in_column(columns: DataFrame, turn: int) -> DataFrame:
    """(token, first): the class that comes first in each column, by a hash or, in even turns, with the least share of shingles of its own.

    Copies of one text have shingles of their own where they were changed, and the text that they come from has few.
    """
    own = F.lit(0.0) if turn % 2 else -F.col("kept") / (F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1)
    return columns.groupBy("token").agg(F.min(F.struct(own.alias("o"), F.xxhash64("key", F.lit(turn)).alias("h"), "key", "n", "own")).alias("first"))


def meetings(columns: DataFrame, turn: int) -> DataFrame:
    """A pair (a, b) at most for each class a: b is the class that it meets in most columns among those that come first in a column.

    Classes of one component or of incompatible sizes do not meet, nor do long ones in a single column.
    """
    met = columns.join(first_in_column(columns, turn), "token").filter("own != first.own and 100 * least(n, first.n) >= 75 * greatest(n, first.n)")
    counted = met.groupBy("key", F.col("first.key").alias("b"), "n").agg(F.count(F.lit(1)).alias("met")).filter("met > 1 or n < 12")
    return counted.groupBy(F.col("key").alias("a")).agg(F.max_by("b", F.struct("met", "b")).alias("b"))


def block_product(group: pa.Table) -> pa.Table:
    """Pairs (a, b), a < b, of one block's cells that may link by what they meet in here and could meet in elsewhere."""
    cell, chunk, key, n, own, total = (group.column(c).to_numpy() for c in ("cell", "chunk", "key", "n", "own", "total"))
    cross, tokens = group.column("cross").to_numpy(zero_copy_only=False), group.column("tokens").combine_chunks()
    here, rows = pc.list_value_length(tokens).to_numpy(), len(key)
    row, token = np.repeat(np.arange(rows), here), tokens.flatten().to_numpy()
    order = np.lexsort((n[row], token, cell[row]))
    row, token = row[order], token[order]
    column = np.cumsum(np.concatenate([[0], (np.diff(token) != 0) | (np.diff(cell[row]) != 0)]))
    found: list[np.ndarray] = []
    codes, met = np.empty(0, np.int64), np.empty(0, np.int64)
    held = d = 0
    at = np.arange(len(row))

    def add_up() -> None:
        nonlocal codes, met
        more, times = np.unique(np.concatenate(found), return_counts=True)
        found.clear()
        codes, where = np.unique(np.concatenate([codes, more]), return_inverse=True)
        met = np.bincount(where, np.concatenate([met, times]), len(codes)).astype(np.int64)

    while len(at):
        d += 1
        at = at[at + d < len(row)]
        at = at[column[at] == column[at + d]]
        x, y = row[at], row[at + d]
        near = 100 * n[x].astype(np.int64) >= 75 * n[y].astype(np.int64)
        at, x, y = at[near], x[near], y[near]
        take = (own[x] != own[y]) & (~cross[x] | (chunk[x] != chunk[y]))
        x, y = x[take], y[take]
        if len(x):
            found.append(np.minimum(x, y).astype(np.int64) * rows + np.maximum(x, y))
            held += len(x)
            if held > 1 << 19:
                add_up()
                held = 0
    if found:
        add_up()
    x, y = codes // max(rows, 1), codes % max(rows, 1)
    # shared shingles that may be counted elsewhere, and those after the end of the earlier prefix
    away, rest = np.minimum(total[x] - here[x], total[y] - here[y]), -(-3 * np.maximum(n[x], n[y]).astype(np.int64) // 4) - 1
    ok = 7 * (met + away + rest) >= 3 * (n[x].astype(np.int64) + n[y])
    a, b = key[x[ok]], key[y[ok]]
    release()
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def blocked_pairs(columns: DataFrame, blocks: int) -> DataFrame:
    """Pairs (a, b) of classes of different components whose counts can reach the bound of their sizes; columns: those of mixed_columns().

    Columns with one first class are taken together: there, pairs that share much meet all at once. Of the shingles that two sets share, all but those
    after the end of the earlier prefix are counted; so a pair with an overlap of 3 (n_a + n_b) / 7 has counts of at least that less the
    longer rest, of which a block may miss what the two could meet in elsewhere.
    """
    hubs = columns.join(first_in_column(columns, 0), "token").groupBy(F.col("first.key").alias("hub"), "key", "n", "own").agg(F.collect_list("token").alias("tokens"))
    hubs = hubs.join(columns.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("total")), "key")
    hubs = staged(hubs, "hubs")
    sizes = hubs.groupBy("hub", "own").agg(F.count(F.lit(1)).alias("many"))
    large = staged(sizes.groupBy("hub").agg(F.max_by("own", F.struct("many", "own")).alias("major"), F.max("many").alias("most"), F.sum("many").alias("rows")).filter(F.col("rows") > CHUNK), "large")
    told = large.count()  # one for CHUNK rows of hubs at most
    dealt = hubs.join(F.broadcast(large) if told <= MOST_LARGE else large, "hub", "left").withColumn("own_chunks", F.coalesce(F.ceil(F.col("most") / CHUNK), F.lit(0)).cast("int"))
    dealt = dealt.withColumn("chunks", F.coalesce(F.col("own_chunks") + F.ceil((F.col("rows") - F.col("most")) / CHUNK), F.lit(1)).cast("int"))
    # chunks of the largest component come first and meet the chunks of the others; those meet all
    in_major = F.coalesce(F.col("own") == F.col("major"), F.lit(False))
    hashed = F.xxhash64("key")
    dealt = dealt.withColumn("chunk", F.when(in_major, F.pmod(hashed, F.col("own_chunks"))).otherwise(F.col("own_chunks") + F.pmod(hashed, F.greatest(F.col("chunks") - F.col("own_chunks"), F.lit(1)))).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.when(in_major, F.col("own_chunks")).otherwise(0), F.col("chunks") - 1)))
    cells = cells.withColumn("cell", F.xxhash64("hub", F.least("chunk", "other"), F.greatest("chunk", "other"))).withColumn("cross", F.col("chunk") != F.col("other"))
    # a cell of two chunks holds both; the cell of a chunk with itself holds that chunk
    cells = cells.select("cell", "cross", "chunk", "key", "n", "own", "total", "tokens", F.pmod(F.hash("cell"), F.lit(blocks)).alias("block"))
    return cells.groupBy("block").applyInArrow(block_product, "a long, b long").distinct()


def sets_of(keys: DataFrame, docs: DataFrame, classes: DataFrame, seed: int = 0) -> DataFrame:
    """(key, own): the whole sets of some classes, as bytes, stored. keys and classes must be stored tables.

    Texts are picked by a map of their doc_ids before they leave the JVM, and by key after.
    """
    need = keys.distinct().join(classes, "key").select("key", "doc_id")
    known = marked(docs.select("doc_id", "text"), need.select("doc_id"), "doc_id", "_hit").filter(F.col("_hit") | F.col("doc_id").isNull()).select("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(seed), set()
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            rows = [(key, own.tobytes()) for _, own in shingler.sets(data, offsets) if len(own) and _fresh(seen, key := set_key(own)[0])]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "own"])

    return staged(known.mapInArrow(lean(read), "key long, own binary").join(need, "key", "left_semi").groupBy("key").agg(F.first("own").alias("own")), "sets")


def compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, seed: int = 0) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose whole sets link. pairs and classes must be stored tables."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(175 * both >= 75 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    sets = sets_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")), docs, classes, seed)
    joined = pairs.join(sets.select(F.col("key").alias("b"), F.col("own").alias("y")), "b").join(sets.select(F.col("key").alias("a"), F.col("own").alias("x")), "a")
    out = staged(joined.select("a", "b", "x", "y").mapInArrow(lean(link), "a long, b long"), "links")
    discard(sets)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text")
    for seed in range(8):
        rows = staged(shingle_sets(docs, seed), "rows")
        classes = staged(rows.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.max("n_shingles").alias("n")), "classes")
        told = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bool_or(F.col("lo") != F.col("hi")), F.lit(False)).alias("clash")).first()
        if not told["clash"]:
            break
        discard(rows, classes)
    blocks = max(64, partitions_for(spark), told["n"] >> 19)
    names, totals = frequent_shingles(docs, blocks, seed)
    lists = staged(columns_in_common(docs, blocks, names, totals, seed), "lists")
    columns = staged(lists.join(lists.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("kept")), "key").withColumn("own", F.col("key")), "columns")
    discard(lists)
    by_key = classes.select("key", F.col("doc_id").alias("node"))

    def as_edges(links: DataFrame) -> DataFrame:
        x, y = (by_key.select(F.col("key").alias(k), F.col("node").alias(v)) for k, v in (("a", "u"), ("b", "v")))
        return links.join(x, "a").join(y, "b").select(F.col("u").alias("a"), F.col("v").alias("b"))

    def owners(star: DataFrame) -> DataFrame:
        """key and component of classes, named by hashes as the rest of this step's keys are."""
        return by_key.join(star, "node").select("key", F.xxhash64("component").alias("own"))

    links = star = None
    for turn in range(TURNS):
        pairs = staged(meetings(columns, turn), "pairs")
        fresh = compared(pairs, docs, classes, seed)
        linked, left = fresh.count(), pairs.count() - fresh.count()
        discard(pairs)
        if not linked:
            break
        links = fresh if links is None else links.union(fresh)
        star = components(as_edges(links))
        before, columns = columns, staged(mixed_columns(columns, owners(star)), "columns")
        discard(before)
        if 4 * linked < left or 8 * left < classes.count():
            break  # what is left is few, or copies of no text that is here
    pairs = staged(blocked_pairs(columns, 4 * blocks), "pairs")
    last = compared(pairs, docs, classes, seed)
    discard(pairs, columns)
    if last.count():
        star = components(as_edges(last if links is None else links.union(last)))
    of_class = by_key.withColumnRenamed("node", "component") if star is None else by_key.join(star, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    return rows.join(of_class, "key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents that share three quarters of their five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS least FROM documents UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, any_value(len(s.g))::BIGINT AS n_shingles, min(least) AS component_id FROM r JOIN s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the least doc_id of their component; rows of a null doc_id stay, and so do all rows of a kept doc_id."""
    return left_out(docs, staged(jaccard_components(docs).filter("doc_id != component_id").select("doc_id").distinct(), "dropped"))
