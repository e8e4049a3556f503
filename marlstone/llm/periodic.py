"""Periodic run detection: all maximal runs of repeated word sequences, by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q that is at least LEAST and 2 q words long and that no neighbouring word
extends. The words of many texts are numbered and laid end to end, with a number of its own between two texts, and worked on at once:

1. Periods below SHORT come from direct scans: the words are compared with those q places on.
2. Scale P, for P = SHORT, 2 SHORT, ..., finds periods from P to 2 P - 1. m-grams (m = P / 2) have fingerprints, made by doubling those of
   the scale before. Of every P / 2 + 1 neighbouring m-grams the least is a minimizer: what they cover, P words, stands again q words on
   inside a run of period q, and its minimizer with it. So two equal minimizers at a distance from P to 2 P - 1 seed every run.
   An m-gram that itself has a period of m / 2 or less stands in a run that is known from an earlier scale, and is never a minimizer. Other
   m-grams that are equal are more than m / 2 apart, so a minimizer has five partners at most, whatever the text.
   A run whose every such window is periodic lies across two neighbouring runs of one smaller period; these pairs give the rest of the seeds.
3. A seed is extended in both directions by comparing words. Stretches found at several distances keep the smallest.

Fingerprints only propose; words are compared by number, so results are exact. The seeds of one distance that lie in one stretch are extended once.

Defined cases: a null or empty text has no runs and an empty collapsed text; null doc_ids are carried; rows that share a doc_id and repeated rows are
treated one by one; an empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, lean, slices, table, text_buffers
from .shingles import U, mixed
from .words import Words, joint, least_in_windows

#: Words that a run has at least, and the least period that minimizers look for (a power of two; shorter ones are scanned for directly).
LEAST, SHORT = 12, 32
#: Bytes of texts that are worked on at once.
SLICE = 1 << 18
NONE = U(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _reach(w: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many words from i on (step 1) or back (step -1) equal those from j on; w begins and ends with numbers that stand nowhere else."""
    out, active, width, last = np.zeros(len(i), np.int64), np.arange(len(i)), 32, len(w) - 1
    while len(active):
        ahead = step * (np.arange(width) + out[active, None])
        same = w[np.clip(i[active, None] + ahead, 0, last)] == w[np.clip(j[active, None] + ahead, 0, last)]
        whole = same.all(axis=1)
        out[active] += np.where(whole, width, same.argmin(axis=1))
        active = active[whole]
        width = int(np.clip((1 << 18) // max(1, len(active)), 32, width * 2))
    return out


def _extend(w: np.ndarray, at: np.ndarray, lag: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and lag of the stretches w[i] = w[i + lag] around some seeds; the end is that of the words covered."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    found = []
    while len(at):
        # one seed of every cluster of near seeds of one lag is extended, then those in its stretch are done
        head = np.ones(len(at), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (at[1:] - at[:-1] > gap)
        i, d = at[head], lag[head]
        ahead, back = _reach(w, i, i + d, 1), _reach(w, i - 1, i - 1 + d, -1)
        good = ahead > 0
        found.append((i[good] - back[good], i[good] + ahead[good] + d[good], d[good]))
        cluster = np.cumsum(head) - 1
        left = ~head & (at >= (i + np.maximum(ahead, 1))[cluster])
        at, lag = at[left], lag[left]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _scan(w: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and lag of the stretches of at least least words that equal those lag places on."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], w[:-lag] == w[lag:], [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return begin[long], end[long] + lag, np.full(int(long.sum()), lag)


def _across(w: np.ndarray, runs: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds (place, lag) for runs that lie across two neighbouring runs of one period, scale / 4 at most."""
    few = runs[(runs[:, 2] <= scale // 4) & (runs[:, 1] - runs[:, 0] >= scale)]
    few = few[np.lexsort((few[:, 0], few[:, 2]))]
    at, lags = [], []
    near = np.flatnonzero((few[1:, 2] == few[:-1, 2]) & (few[1:, 0] <= few[:-1, 1]))
    for k in near:
        (a, a_end, q), (b, b_end, _) = few[k].tolist(), few[k + 1].tolist()
        cycle = np.tile(w[a : a + q], 2).astype("<i8").tobytes()
        turn = cycle.find(w[b : b + q].astype("<i8").tobytes())
        while turn % 8 and turn >= 0:
            turn = cycle.find(w[b : b + q].astype("<i8").tobytes(), turn + 1)
        if turn >= 0:
            most = min(2 * scale, a_end - a + 1, b_end - b + 1)
            of = np.arange(scale + (b - a - turn // 8 - scale) % q, most, q)
            lags.append(of)
            at.append(np.full(len(of), b - 1))
    return (np.concatenate(at), np.concatenate(lags)) if at else (np.empty(0, np.int64),) * 2


def _seeds(h: np.ndarray, periodic: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal minimizers, scale to 2 scale - 1 apart, as (place, lag)."""
    n, bits = len(h), U(int(len(h)).bit_length())
    if n < scale // 2 + 1:
        return (np.empty(0, np.int64),) * 2
    keys = (h >> bits << bits) | np.arange(n, dtype=U)  # the leftmost of equal ones
    keys[periodic] = NONE
    least = least_in_windows(keys, scale // 2 + 1)
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    least = np.sort(least[least != NONE])  # by fingerprint, then place
    prints, places = least >> bits, (least & ((U(1) << bits) - U(1))).astype(np.int64)
    at, lags, k = [], [], 1
    while k < len(prints):
        near = (prints[k:] == prints[:-k]) & (places[k:] - places[:-k] < 2 * scale)
        if not near.any():
            break
        pick = near & (places[k:] - places[:-k] >= scale)
        at.append(places[:-k][pick])
        lags.append((places[k:] - places[:-k])[pick])
        k += 1
    return (np.concatenate(at), np.concatenate(lags)) if at else (np.empty(0, np.int64),) * 2


def _covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in some interval."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row, of the smallest lag, for each stretch."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[fresh]


def find_runs(numbers: np.ndarray, firsts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs, by start, of some texts; firsts are where each text's words begin, and the number of all words."""
    sizes = np.diff(firsts)
    texts = np.flatnonzero(sizes >= least)
    if not len(texts):
        return np.empty((0, 3), np.int64)

    def laid(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of values end to end, each behind a number of its own, and one at the end; and where each begins."""
        begins = np.cumsum(lengths + 1) - lengths
        out = np.empty(int(begins[-1] + lengths[-1]) + 1, np.int64)
        inside = np.ones(len(out), bool)
        inside[[*(begins - 1), -1]] = False
        out[~inside] = -1 - np.arange(len(begins) + 1)
        out[inside] = values[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
        return out, begins

    lengths = sizes[texts]
    origin = firsts[texts]
    w, begins = laid(numbers, origin, lengths)
    found = _smallest(np.concatenate([np.stack(_scan(w, q, max(least - q, q)), axis=1) for q in range(1, min(SHORT, len(w)))]))
    done, scale = [], SHORT
    h = mixed(w.view(U) * U(0x9E3779B97F4A7C15) + U(1))
    width = 1
    while True:
        long = lengths >= 2 * scale
        if not long.all():  # texts that can hold no run of this scale are done
            home = np.searchsorted(begins, found[:, 0], side="right") - 1
            shift = origin - begins
            stay = long[home] if len(found) else np.empty(0, bool)
            done.append(found[~stay] + np.stack([shift[home[~stay]], shift[home[~stay]], np.zeros(int((~stay).sum()), np.int64)], axis=1))
            if not long.any():
                break
            kept = found[stay]
            home = home[stay]
            old = begins
            w, begins = laid(numbers, origin[long], lengths[long])
            place = np.cumsum(long) - 1
            move = begins[place[home]] - old[home]
            found = kept + np.stack([move, move, np.zeros(len(move), np.int64)], axis=1)
            origin, lengths = origin[long], lengths[long]
            h, width = mixed(w.view(U) * U(0x9E3779B97F4A7C15) + U(1)), 1
        m = scale // 2
        while width < m:
            h = joint(h[: len(h) - width], h[width:])
            width *= 2
        inner = found[(found[:, 2] <= m // 2) & (found[:, 1] - found[:, 0] >= m)]
        periodic = _covered(len(h), inner[:, 0], inner[:, 1] - m + 1)
        seeds, across = _seeds(h, periodic, scale), _across(w, found, scale)
        at, lag = (np.concatenate(c) for c in zip(seeds, across, strict=True))
        begin, end, lag = _extend(w, at, lag, m)
        good = end - begin >= np.maximum(least, 2 * lag)
        if good.any():
            found = _smallest(np.concatenate([found, np.stack([begin, end, lag], axis=1)[good]]))
        scale *= 2
    runs = np.concatenate(done)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, the runs of every text by start, then period, and its words without the repetitions, joined by one space.

    A word is left out of `collapsed` if it stands in a run behind the run's first period. One pass; texts are not shuffled.
    """
    bound_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                words = Words(data, offsets[lo : hi + 1])
                runs = find_runs(words.numbers(), words.firsts)
                kept = ~_covered(len(words), runs[:, 0] + runs[:, 2], runs[:, 1])
                cuts = np.searchsorted(runs[:, 0], words.firsts)
                row = np.repeat(np.arange(hi - lo), np.diff(cuts))
                fields = [pa.array(c) for c in (runs[:, 0] - words.firsts[row], runs[:, 1] - runs[:, 0], runs[:, 2])]
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), lists, words.joined(kept).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(read), f"doc_id {kind}, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs, where every tenth text by the crc32 of its doc_id has a tail that repeats itself."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    tail = F.expr("""array_join(transform(_w, (x, i) -> if(i < _a, x, _w[cast(_a + (i - _a) % (1 + (size(_w) - _a) div (3 + _g % 8)) as int)])), ' ')""")
    changed = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_w"), F.expr("crc32(cast(doc_id as string)) div 10").alias("_g")).withColumn("_a", F.when(F.size("_w") > 0, F.expr("_g % size(_w)")))
    return changed.select("doc_id", F.when(F.col("_a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, every tenth of them with a planted one: their number, the longest, and digests of all and of the collapsed text."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as s, -r.period as p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.s")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.p")).alias("period"),
        F.expr("1000 * _b.length div -_b.p").alias("exponent_milli"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: Six words stand again at distance q everywhere inside a run, but for its end; crc32 is taken bit by bit.
OP11_SQL = r"""WITH base AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w,
    xor(list_reduce(
      list_transform(range(8 * length(doc_id::VARCHAR)), lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1))::BIGINT ELSE 0::BIGINT END),
      lambda crc, byte: xor(xor(crc, byte) >> 1, (xor(crc, byte) & 1) * 3988292384), 4294967295), 4294967295) AS h
  FROM documents),
placed AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM base),
planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w
  FROM placed),
grams AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 6), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM planted WHERE n >= 12)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.h = y.h AND x.i < y.i),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, length, min(q) AS q FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, s, length),
told AS (
  SELECT doc_id, count(*) AS n_runs, max(struct_pack(length := length, s := -s, q := -q)) AS best,
    string_agg(concat(s, ',', length, ',', q, chr(10)), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id),
gone AS (SELECT doc_id, list(DISTINCT i) AS places FROM (SELECT doc_id, unnest(range(s + q, s + length)) AS i FROM runs) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM planted) ANTI JOIN (SELECT doc_id, unnest(places) AS i FROM gone) USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.length AS length, -best.q AS period, 1000 * best.length // -best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM planted LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
