"""Substring dedup by level-wise doubling: every stretch of `length` words that also starts in a document with a smaller id is removed.

Only windows that repeat at one length are extended to twice that length. For 50 words the levels are 25 and 50 words; for more there are more:

1. Texts of one word sequence are one class, known by its fingerprint; the smallest id stands for it, and all of the others is removed. What
   follows sees one row of a class.
2. The first level, about half of the second's length, takes one window of every stretch that a window of the second can cover: the one with the
   least fingerprint. Equal windows of the second level hold equal ones of the first, so about one window in 13 is enough.
3. Windows are counted by fingerprint: the smallest and the largest id that has each. Windows whose two ids are equal stand in one document
   alone; they are sent to that document, which goes on with its other windows. So no group of copies is gathered or joined: a fingerprint that a
   third of all documents hold is one row of a sum, and what a document receives is bounded by its own text.
4. The next level takes the windows all of whose parts at the level before repeat, and so on until the asked length, or until no candidates survive.
5. At the last level each fingerprint is sent to its smallest id. A document's candidates that it does not receive start in a document with a
   smaller id: their words are removed.

Texts are shuffled only for documents that hold candidates or are copies. Fingerprints of the last level have 128 bits, those of others 64 (they
only propose).

Defined cases: a null or empty text has no words, loses nothing and comes out as an empty text; a row of a null doc_id is carried whole and takes nothing from
others; rows that share a doc_id are one document, so that they take nothing from each other, and each is cut by its own text; repeated
rows come out as often as they stand; an empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, lean, marked, slices, staged, table, text_buffers
from .periodic import _covered, digest
from .shingles import U, set_key
from .words import Words, grams, least_in_windows

#: Words of a window, and the least words of the first level's.
LENGTH, FIRST = 50, 20
LONGS, INTS = "array<bigint>", "array<int>"


def levels(length: int) -> list[int]:
    found = [length]
    while len(found) < 2 or found[0] >= 2 * FIRST:
        found.insert(0, -(-found[0] // 2))
    return found


def lists(parts: list[np.ndarray], kind: np.dtype) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*parts, np.empty(0, kind)]).astype(kind)))


def unlisted(column: pa.Array) -> list[np.ndarray]:
    """The values of each row of a list column; none for null."""
    return [np.asarray(v.values) if v.is_valid else np.empty(0, np.int64) for v in column]


def selected(values: np.ndarray, width: int) -> np.ndarray:
    """Places of the least of every width neighbouring values; the first of equal ones."""
    if len(values) < width:
        return np.empty(0, np.int64)
    bits = U(len(values).bit_length())
    least = least_in_windows((values >> bits << bits) | np.arange(len(values), dtype=U), width)
    return np.unique(least & ((U(1) << bits) - U(1))).astype(np.int64)


def first_level(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Of every text of enough words: doc_id, tkey, n_words, f1 and f2 (of the word sequence), places and prints of the first level's windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in slices(offsets):
                words = Words(data, offsets[lo : hi + 1])
                counts, prints = np.diff(words.firsts), words.prints(1)
                windows = grams(prints, sizes[0])
                rows = np.flatnonzero(counts >= sizes[-1])
                places, found, whole = [], [], []
                for r in rows:
                    begin, end = int(words.firsts[r]), int(words.firsts[r + 1])
                    own = windows[begin : end - sizes[0] + 1]
                    places.append(selected(own, sizes[1] - sizes[0] + 1))
                    found.append(own[places[-1]].view(np.int64))
                    whole.append(set_key(prints[begin:end]))
                take = pa.array(rows + lo)
                yield pa.record_batch(
                    [batch.column("doc_id").take(take), batch.column("tkey").take(take), pa.array(counts[rows]), *[pa.array([w[k] for w in whole], pa.int64()) for k in (0, 1)], lists(places, np.int32), lists(found, np.int64)],
                    names=["doc_id", "tkey", "n_words", "f1", "f2", "places", "prints"],
                )

    return docs.filter("doc_id is not null").mapInArrow(lean(read), f"doc_id {kind}, tkey bigint, n_words bigint, f1 bigint, f2 bigint, places {INTS}, prints {LONGS}")


def starts(places: np.ndarray, n: int, sizes: list[int], level: int) -> np.ndarray:
    """Where the windows of a level start whose parts at the level before repeat, in a text of n words; places are those of the parts."""
    now, before = sizes[level], sizes[level - 1]
    fit = np.zeros(max(0, n - now + 1), bool)
    if level == 1:  # windows that hold a selected one
        begins, ends = np.maximum(places - (now - before), 0), np.minimum(places + 1, len(fit))
        some = begins < ends
        return np.flatnonzero(_covered(len(fit), begins[some], ends[some])) if some.any() else np.empty(0, np.int64)
    known = np.zeros(n + 1, bool)
    known[places] = True
    return np.flatnonzero(known[: len(fit)] & known[now - before : now - before + len(fit)])


def _candidates(batch: pa.RecordBatch, sizes: list[int], level: int, seeds: int = 1) -> Iterator[tuple[int, int, Words, list[np.ndarray], list[np.ndarray]]]:
    """Slices of rows: first and last row, words, starts of each row's candidates among the words of all, and fingerprints of all windows, if there is a candidate."""
    data, offsets = text_buffers(batch.column("text"))
    held = unlisted(batch.column("places"))
    for lo, hi in slices(offsets):
        words = Words(data, offsets[lo : hi + 1])
        own = [starts(held[lo + r], int(n), sizes, level) + int(words.firsts[r]) for r, n in enumerate(np.diff(words.firsts))]
        some = any(len(x) for x in own)
        yield lo, hi, words, own, [grams(words.prints(seed), sizes[level]).view(np.int64) if some else np.empty(0, np.int64) for seed in range(1, seeds + 1)]


def repeated(rows: DataFrame) -> DataFrame:
    """(doc_id, tkey, places) of the first level's windows that repeat; rows has prints and held."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, prints, held = (unlisted(batch.column(c)) for c in ("places", "prints", "held"))
            left = [a[~np.isin(p, h)] for a, p, h in zip(places, prints, held, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("tkey"), lists(left, np.int32)], names=["doc_id", "tkey", "places"])

    return rows.select("doc_id", "tkey", "places", "prints", "held").mapInArrow(lean(read), f"doc_id {kind}, tkey bigint, places {INTS}").filter("size(places) > 0")


def emitted(texts: DataFrame, sizes: list[int], level: int) -> DataFrame:
    """(doc_id, h, c) of every candidate of a level; texts has doc_id, text and places."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, _, own, prints in _candidates(batch, sizes, level, 2):
                at = np.concatenate(own)
                row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]) + lo)
                yield pa.record_batch([batch.column("doc_id").take(row), *[pa.array(p[at]) for p in prints]], names=["doc_id", "h", "c"])

    return texts.select("doc_id", "text", "places").mapInArrow(lean(read), f"doc_id {kind}, h bigint, c bigint")


def settled_by(windows: DataFrame, last: bool) -> DataFrame:
    """(doc_id, held): for each document the fingerprints that it keeps: at the last level those it has first, before that those it has alone."""
    told = windows.groupBy(*[c for c in windows.columns if c != "doc_id"]).agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("hi"))
    return (told if last else told.filter("doc_id = hi")).groupBy("doc_id").agg(F.collect_list("h").alias("held"))


def advanced(texts: DataFrame, sizes: list[int], level: int) -> DataFrame:
    """(doc_id, tkey, places) of the candidates of a level that repeat; texts has held too."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = unlisted(batch.column("held"))
            for lo, hi, words, own, (prints,) in _candidates(batch, sizes, level):
                left = [x[~np.isin(prints[x], held[lo + r])] - words.firsts[r] for r, x in enumerate(own)]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), batch.column("tkey").slice(lo, hi - lo), lists(left, np.int32)], names=["doc_id", "tkey", "places"])

    return texts.select("doc_id", "tkey", "text", "places", "held").mapInArrow(lean(read), f"doc_id {kind}, tkey bigint, places {INTS}").filter("size(places) > 0")


def cut(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row; texts has whole (is all removed?), places and held (null: nothing is removed) too."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    level = len(sizes) - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, whole = unlisted(batch.column("held")), batch.column("whole").fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, words, own, (prints,) in _candidates(batch, sizes, level):
                gone = np.concatenate([x[~np.isin(prints[x], held[lo + r])] for r, x in enumerate(own)])
                drop = whole[lo:hi][words.row_of()] | _covered(len(words), gone, gone + sizes[-1])
                removed = np.bincount(words.row_of()[drop], minlength=hi - lo)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(words.firsts)), pa.array(removed.astype(np.int64)), words.joined(~drop).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return texts.select("doc_id", "text", "whole", "places", "held").mapInArrow(lean(read), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row of docs."""
    bound_batches(docs.sparkSession)
    sizes = levels(length)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    rows = staged(first_level(keyed, sizes), "windows")
    # the smallest id of each word sequence, told to that document
    mine = rows.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("f1").alias("mine"))
    once = rows.groupBy("doc_id", "tkey").agg(F.first(F.struct("f1", "places", "prints")).alias("_r")).select("doc_id", "tkey", "_r.*")
    told = staged(once.join(mine, "doc_id", "left").withColumn("stands", F.coalesce(F.array_contains("mine", F.col("f1")), F.lit(False))).drop("mine", "f1"), "classes")
    copies, now = told.filter("not stands").select("doc_id", "tkey"), told.filter("stands")
    alone = settled_by(now.select("doc_id", F.explode("prints").alias("h")), False)
    state = staged(repeated(now.join(alone, "doc_id", "left")), "repeats")
    for level in range(1, len(sizes)):
        texts = marked(keyed, state.select("doc_id").distinct(), "doc_id", "_hit").filter("_hit").drop("_hit").join(state, ["doc_id", "tkey"])
        held = staged(settled_by(emitted(texts, sizes, level), level == len(sizes) - 1), "held")
        if level < len(sizes) - 1:
            after = staged(advanced(texts.join(held, "doc_id", "left").dropDuplicates(["doc_id", "tkey"]), sizes, level), "repeats")
            discard(state, held)
            state = after
    verdicts = state.join(held, "doc_id", "left").withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    verdicts = staged(verdicts, "verdicts")
    discard(rows, told, state, held)
    flagged = marked(keyed, verdicts.select("doc_id").distinct(), "doc_id", "_hit")
    touched = flagged.filter("_hit").drop("_hit").join(verdicts, ["doc_id", "tkey"], "left")
    nothing = {"whole": "boolean", "places": INTS, "held": LONGS}
    rest = flagged.filter("not _hit").select("doc_id", "text", *[F.lit(None).cast(k).alias(n) for n, k in nothing.items()])
    return cut(rest, sizes).unionByName(cut(touched, sizes))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many stand in a repeated window of 50, and a digest of the rest."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", digest(F.col("kept")).alias("kept_sha256"))


OP12_SQL = r"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM split)),
firsts AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
later AS (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE d < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(range(50)) AS t(k)),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM split) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split LEFT JOIN left_over USING (doc_id)
"""
