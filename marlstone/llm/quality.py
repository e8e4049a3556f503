"""Quality rules whose cutoffs are chosen under a limit on false rejections; DataFrame functions only.

A rule rejects a text when one of its ratios is above a cutoff. Cutoffs are picked per stratum (the language as given) from labelled rows
that pass the base rules, a third of which (by hash of doc_id) choose and the rest of which, the holdout, judge:

* The choosing third picks for every stratum and rule the cutoff of a fixed grid that rejects most bad texts less PENALTY times the good ones, the
  loosest of equal ones. A rule that gains less than LEAST_GAIN of the bad texts so is off and spends nothing of what follows.
* On the holdout, "at least ALPHA / rules of good texts are rejected", rules being those chosen in the stratum, is tested for every choice by the exact
  binomial tail, at the level DELTA / choices over all strata (Bonferroni): the chance that any certified cutoff breaks its limit is at most
  DELTA, and the rules of a stratum together reject at most ALPHA of good texts. Choices that are not significant are off: a stratum with
  too few labels certifies nothing and keeps what the base rules keep.

Defined cases: a null or empty text has no words and fails the base rules; a null language is a stratum of its own; null labels are left
out; several labels of a document count one by one; null doc_ids are carried and have no labels; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, marked, settled, staged, table

GAPS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
ALPHA, DELTA, PENALTY, LEAST_GAIN = 0.05, 0.05, 20, 0.02
#: Cutoffs of every ratio, in thousandths.
GRID = (10, 20, 50, 100, 150, 200, 250, 300, 350, 400, 450, 500, 600, 700, 800, 900, 1000, 1500, 2000, 3000)
RULES = ("symbols", "shouts", "capitals", "repeats", "lines")
#: Terms of a binomial tail that are added one by one; the rest is bounded by a geometric series.
TERMS = 4000
#: Rows of cutoffs, one for each stratum that certifies some, that are sent to the workers; more are joined as Spark likes.
MOST_STRATA = 10_000


def without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def text_counts(docs: DataFrame) -> DataFrame:
    """docs without its text, with the counts that rules are made of."""
    text = F.coalesce("text", F.lit(""))
    kept = docs.withColumn("_t", text).withColumn("_w", F.filter(F.split("_t", r"[ \t-\r]+"), lambda w: w != "")).withColumn("_n", F.size("_w"))
    # hashes of three-word windows with their places, sorted: equal ones stand together
    hashed = F.expr("case when _n < 3 then array() else sort_array(transform(sequence(0, _n - 3), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) as h, i as i))) end")
    again = F.expr("filter(_s, (x, k) -> (k > 0 and _s[k - 1].h = x.h) or (k < _n - 3 and _s[k + 1].h = x.h))")
    lines = F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^ \t-\r]')")
    counted = kept.withColumn("_s", hashed).withColumn("_a", again).withColumn("_l", lines)
    n = F.length("_t")
    told = settled(
        counted.drop("text"),
        n_words=F.col("_n").cast("long"),
        word_chars=F.length(without(F.col("_t"), GAPS)).cast("long"),
        n_symbols=(n - F.length(without(F.col("_t"), SYMBOLS))).cast("long"),
        n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        n_repeat_words=F.expr("size(array_distinct(flatten(transform(_a, x -> array(x.i, x.i + 1, x.i + 2)))))").cast("long"),
        n_shouts=(n - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long"),
        n_capitals=(n - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        n_lines=F.size("_l").cast("long"),
    )
    return told.drop("_t", "_w", "_n", "_s", "_a", "_l")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """What each rule compares with its cutoff: thousandths, rounded down."""
    share = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return dict(zip(RULES, (share("n_symbols", "n_words"), share("n_shouts", "n_words"), share("n_capitals", "word_chars"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")), strict=True))


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 16 on and term by term below: right to 12 digits."""
    x = n + F.lit(1.0)
    series = (x - 0.5) * F.log(x) - x + 0.5 * F.log(F.lit(6.283185307179586)) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(16)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, k: acc + F.log(k.cast("double")))
    return F.when(n < 16, exact).otherwise(series)


def binomial_tail(k: Column, n: Column, p: Column | float) -> Column:
    """P(X <= k) for X of n trials at p: exact, or bounded from above where TERMS terms do not reach 0; 1 where k >= n p."""
    p = p if isinstance(p, Column) else F.lit(p)
    log_top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log(1 - p)
    odds = (1 - p) / p
    step = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    down = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.least(k, F.lit(TERMS)), F.lit(1)).cast("int") - 1),
        step,
        lambda acc, j: F.struct((acc["term"] * F.greatest(k - j, F.lit(0)) / (n - k + j + 1) * odds).alias("term"), (acc["sum"] + acc["term"] * F.greatest(k - j, F.lit(0)) / (n - k + j + 1) * odds).alias("sum")),
    )
    last = (k - TERMS) / (n - k + TERMS + 1) * odds
    rest = F.when((k > TERMS) & (last < 1), down["term"] * last / (1 - last)).otherwise(0.0)
    return F.when((n == 0) | (k >= n * p), F.lit(1.0)).otherwise(F.exp(log_top) * (down["sum"] + rest))


def certified_cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, penalty: float = PENALTY) -> DataFrame:
    """stratum and a cutoff column for each rule (null: off), from labelled rows; strata that certify nothing have no row."""
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("_id"), "quality")
    chooses = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    seen = counts.filter(~base_failed()).join(known, F.col("doc_id") == F.col("_id")).select(F.col("lang").alias("stratum"), "quality", chooses.alias("chooses"), *[r.alias(name) for name, r in ratios().items()])
    # one pass: for every rule, how many grid cutoffs a text is above; then counts by that level
    level = lambda name: sum(((F.col(name) > c).cast("int") for c in GRID[1:]), (F.col(name) > GRID[0]).cast("int"))
    long = seen.select("stratum", "quality", "chooses", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), level(name).alias("level")) for name in RULES])).alias("r")).select("stratum", "quality", "chooses", "r.*")
    kinds = {"good": "quality = 1 and not chooses", "first_good": "quality = 1 and chooses", "first_bad": "quality = 0 and chooses"}
    summed = long.groupBy("stratum", "rule", "level").agg(*[F.count_if(F.expr(when)).alias(name) for name, when in kinds.items()])
    # every cutoff of the grid: a text of level v is above the cutoffs 1 to v
    every = summed.select("stratum", "rule").distinct().withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(len(GRID)))))
    at = every.join(summed.withColumnsRenamed({"stratum": "s", "rule": "r"}), F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r")))
    above = lambda name: F.sum(F.when(F.col("level") >= F.col("cut"), F.col(name)).otherwise(0))
    tested = at.groupBy("stratum", "rule", "cut").agg(F.sum("good").alias("n"), above("good").alias("k"), (above("first_bad") - penalty * above("first_good")).alias("gain"), F.sum("first_bad").alias("bad"))
    best = tested.filter(F.col("gain") > LEAST_GAIN * F.col("bad")).groupBy("stratum", "rule").agg(F.max_by(F.struct("cut", "n", "k"), F.struct("gain", "cut")).alias("best"))
    chosen = staged(best.select("stratum", "rule", "best.*"), "chosen")  # a row a stratum and rule at most
    rules = chosen.groupBy(F.col("stratum").alias("s")).agg(F.count(F.lit(1)).alias("rules"))
    limit = F.lit(delta / max(1, chosen.count()))
    certified = chosen.join(rules, F.col("stratum").eqNullSafe(F.col("s"))).filter(binomial_tail(F.col("k"), F.col("n"), alpha / F.col("rules")) <= limit)
    cutoff = F.element_at(F.array(*[F.lit(c) for c in GRID]), F.col("cut"))
    return certified.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == name, cutoff)).alias(f"cut_{name}") for name in RULES])


def verdicts(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """counts with base_failed and kept; cutoffs must be a stored table."""
    small = F.broadcast(cutoffs) if cutoffs.count() <= MOST_STRATA else cutoffs
    above = reduce(lambda a, b: a | b, [F.coalesce(r > F.col(f"cut_{name}"), F.lit(False)) for name, r in ratios().items()])
    return counts.join(small, F.col("lang").eqNullSafe(F.col("stratum")), "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~above)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, counts, base_failed and kept of every row of docs. Texts are counted once."""
    counts = staged(text_counts(docs.select("doc_id", "text", "lang")), "counts")
    return verdicts(counts, staged(certified_cutoffs(counts, labels), "cutoffs"))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*COLUMNS)


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, each by its own text; rows that share a doc_id are judged apart.

    Cutoffs are learned from the counts of labelled rows; then one pass over docs counts, judges and filters, and no text is shuffled or stored.
    """
    known = labels.filter("quality in (0, 1)").select("doc_id")
    likely = marked(docs.select("doc_id", "text", "lang"), known, "doc_id", "_known").filter("_known").drop("_known")
    counts = staged(text_counts(likely), "counts")
    cutoffs = staged(certified_cutoffs(counts, labels), "cutoffs")
    discard(counts)
    return verdicts(text_counts(docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("_doc"))), cutoffs).filter("kept").select("_doc.*")
