"""Mixing documents to target weights of domains, with soft membership; DataFrame functions only.

1. A multinomial classifier over letter counts is summed up from labelled rows of known domain, and gives every document a posterior for each
   domain: the softmax of its mean log-likelihood a letter, sharpened by the root of its length up to SHARPEST.
2. Rates r >= 0 minimize sum_d (S_d - T_d)^2 / v_d + e * sum_i n_i (r_i - 1)^2, with S_d = sum_i r_i n_i p_id the expected tokens of domain d, T_d its
   target, and v_d the larger of T_d and S_d at r = 1. A document's rate is max(0, 1 + sum_d p_id m_d) with one multiplier m_d for each domain,
   found by Newton steps on the dual: every round is one sum over the stored posteriors, and rates are written once. e falls from the first of
   PULLS to the next until each target is met within CLOSE of v_d; where even the last leaves a gap, rates are those nearest to the targets,
   and a warning names the domains and their gaps.
3. A document is emitted floor(r + u) times, u being a uniform hash of its doc_id: expected counts are the rates, and equal runs give equal rows.

Defined cases: a null or empty text has no tokens, the domains' shares as its posterior, and a rate like others; a domain of null is left out of
learning; without any labelled domain all rates are 1; an empty table gives no rows; a null doc_id has a hash like any other value; repeated rows have
equal rates and counts.
"""

from __future__ import annotations

import warnings
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settled, staged, table

#: Letters whose shares tell languages apart.
LETTERS = "aeinoshtwkzyqulcdéèçñóíüöäß"
SHARPEST, MOST_DOMAINS = 12.0, 64
#: Targets are the posteriors' token shares to this power, where none are given: rare domains gain.
POWER = 0.7
CLOSE, PULLS = 1e-3, (1e-4, 1e-6, 1e-8, 1e-10, 1e-12)


def letter_counts(docs: DataFrame) -> DataFrame:
    """docs without its text, with n_tokens (words) and the count of each letter of every row."""
    text = F.lower(F.coalesce("text", F.lit("")))
    read = docs.withColumn("_t", text).drop("text")
    n = F.octet_length("_t")
    counts = {f"c{k}": ((n - F.octet_length(F.replace("_t", F.lit(c), F.lit("")))) / F.lit(len(c.encode()))).cast("long") for k, c in enumerate(LETTERS)}
    return settled(read, n_tokens=F.size(F.filter(F.split("_t", r"[ \t-\r]+"), lambda w: w != "")).cast("long"), **counts).drop("_t")


def domain_model(counts: DataFrame, domain: str) -> dict[str, tuple[float, list[float]]]:
    """For each domain the logarithms of its share of rows and of its letter shares; MOST_DOMAINS at most, or an error."""
    sums = counts.filter(F.col(domain).isNotNull()).groupBy(domain).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(LETTERS))]).orderBy(domain).limit(MOST_DOMAINS + 1).collect()
    if len(sums) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    rows = sum(r["rows"] for r in sums)
    out = {}
    for r in sums:
        letters = [r[f"c{k}"] + 1.0 for k in range(len(LETTERS))]
        out[r[domain]] = (log(r["rows"] / rows), [log(c / sum(letters)) for c in letters])
    return out


def posteriors(counts: DataFrame, model: dict[str, tuple[float, list[float]]]) -> DataFrame:
    """counts without the letters, with a column p0, p1, ... for each domain of the model, in its order."""
    n = reduce(lambda a, b: a + b, [F.col(f"c{k}") for k in range(len(LETTERS))])
    sharp = F.least(F.sqrt(F.col("_n").cast("double")), F.lit(SHARPEST)) * F.lit(4.0)
    fit = counts.withColumn("_n", n)
    logs = []
    for prior, letters in model.values():
        ll = reduce(lambda a, b: a + b, [F.col(f"c{k}") * F.lit(w) for k, w in enumerate(letters)])
        logs.append(F.lit(prior) + F.when(F.col("_n") > 0, sharp * ll / F.col("_n")).otherwise(0.0))
    letters = {f"c{k}" for k in range(len(LETTERS))}
    fit = settled(fit, **{f"_l{k}": x for k, x in enumerate(logs)}).drop("_n", *letters)
    top = F.greatest(*[F.col(f"_l{k}") for k in range(len(logs))]) if len(logs) > 1 else F.col("_l0")
    powers = [F.exp(F.col(f"_l{k}") - top) for k in range(len(logs))]
    whole = reduce(lambda a, b: a + b, powers)
    return settled(fit, **{f"p{k}": p / whole for k, p in enumerate(powers)}).drop(*[f"_l{k}" for k in range(len(logs))])


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small positive definite system, by Gaussian elimination."""
    rows, n = [[*row, x] for row, x in zip(matrix, right, strict=True)], len(right)
    for k in range(n):
        top = max(range(k, n), key=lambda i: abs(rows[i][k]))
        rows[k], rows[top] = rows[top], rows[k]
        for i in range(k + 1, n):
            f = rows[i][k] / rows[k][k]
            rows[i] = [a - f * b for a, b in zip(rows[i], rows[k], strict=True)]
    out = [0.0] * n
    for k in reversed(range(n)):
        out[k] = (rows[k][n] - sum(rows[k][j] * out[j] for j in range(k + 1, n))) / rows[k][k]
    return out


def rate_of(multipliers: list[float]) -> Column:
    """The rate of a row with posteriors p0, p1, ..."""
    return F.greatest(F.lit(0.0), F.lit(1.0) + reduce(lambda a, b: a + b, [F.col(f"p{k}") * F.lit(m) for k, m in enumerate(multipliers)]))


def multipliers(rows: DataFrame, domains: int, weights: list[float] | None = None, names: list[str] | None = None) -> list[float]:
    """The multiplier of each domain, from stored rows with n_tokens and p0, p1, ...; weights: target shares, by default those of POWER."""
    p = [F.col(f"p{k}") for k in range(domains)]
    n = F.col("n_tokens").cast("double")
    pairs = [(a, b) for a in range(domains) for b in range(a, domains)]

    def told(by: list[float]) -> tuple[list[float], dict[tuple[int, int], float], float]:
        """Tokens by domain, their growth with the multipliers, and half the sum of n * rate^2."""
        zero, r = F.lit(0.0), F.col("_r")
        moving = F.when(r > 0, n).otherwise(zero)
        sums = {f"s{k}": r * n * x for k, x in enumerate(p)} | {f"g{a}_{b}": moving * p[a] * p[b] for a, b in pairs} | {"half": n * r * r / 2}
        got = rows.withColumn("_r", rate_of(by)).agg(*[F.coalesce(F.sum(x), zero).alias(c) for c, x in sums.items()]).first()
        return [got[f"s{k}"] for k in range(domains)], {(a, b): got[f"g{a}_{b}"] for a, b in pairs}, got["half"]

    by = [0.0] * domains
    at, grown, half = told(by)
    total = sum(at)
    if not total:
        return by
    shares = weights or [max(h, 1e-9 * total) ** POWER for h in at]
    want = [total * w / sum(shares) for w in shares]
    size = [max(h, t, 1e-9 * total) for h, t in zip(at, want, strict=True)]

    def gaps() -> list[float]:
        return [(s - t) / v for s, t, v in zip(at, want, size, strict=True)]

    def met() -> bool:
        return max(map(abs, gaps())) < CLOSE

    for pull in PULLS:
        while not met():
            slope = [g + pull * m for g, m in zip(gaps(), by, strict=True)]  # of the dual, over size
            if max(map(abs, slope)) < CLOSE / 10:
                break
            scaled = [[grown[min(a, b), max(a, b)] / (size[a] * size[b]) ** 0.5 + pull * (a == b) for b in range(domains)] for a in range(domains)]
            step = [-x / v**0.5 for x, v in zip(solved(scaled, [g * v**0.5 for g, v in zip(slope, size, strict=True)]), size, strict=True)]
            fall = sum(g * v * x for g, v, x in zip(slope, size, step, strict=True))
            dual = lambda half, by: half - sum(t * m for t, m in zip(want, by, strict=True)) + pull / 2 * sum(v * m * m for v, m in zip(size, by, strict=True))
            now, part = dual(half, by), 1.0
            while part > 1e-9:
                there = [m + part * x for m, x in zip(by, step, strict=True)]
                found = told(there)
                if dual(found[2], there) <= now + 1e-4 * part * fall:
                    break
                part /= 2
            else:
                break  # no step falls within the precision of sums
            by, (at, grown, half) = there, found
        if met():
            break
    else:
        left = {names[k] if names else k: round(g, 4) for k, g in enumerate(gaps()) if abs(g) >= CLOSE}
        warnings.warn(f"targets that no rates meet, with their gaps over the larger of tokens and target: {left}", stacklevel=2)
    return by


def fitted_rates(rows: DataFrame, domains: int, weights: list[float] | None = None, names: list[str] | None = None) -> DataFrame:
    """rows (stored, with n_tokens and p0, p1, ...) with a rate."""
    return rows.withColumn("rate", rate_of(multipliers(rows, domains, weights, names)))


def copies(rate: Column, doc_id: Column) -> Column:
    """How many times a document is emitted: the rate, rounded by a uniform hash of doc_id."""
    uniform = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + uniform).cast("int")


def learned(docs: DataFrame, labels: DataFrame, domain: str, weights: dict[str, float] | None) -> tuple[DataFrame, dict[str, tuple[float, list[float]]], list[float]]:
    """The stored rows (doc_id, n_tokens, posteriors), the classifier and the multipliers; without a labelled domain, no model.

    Rows of docs with a label are those whose domain is taken as known.
    """
    known = labels.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct()
    base = letter_counts(docs.select("doc_id", F.col(domain).alias("_domain"), "text"))
    counts = staged(base.join(known, F.col("doc_id") == F.col("_id"), "left").withColumn("_domain", F.when(F.col("_id").isNotNull(), F.col("_domain"))).drop("_id"), "letters")
    model = domain_model(counts, "_domain")
    if not model:
        return counts, {}, []
    rows = staged(posteriors(counts.drop("_domain"), model), "posteriors")
    discard(counts)
    return rows, model, multipliers(rows, len(model), None if weights is None else [weights.get(d, 0.0) for d in model], list(model))


def mixture(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior (its), rate and copies of every row of docs."""
    rows, model, by = learned(docs, labels, domain, weights)
    if not model:
        return rows.select("doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    best = F.greatest(*[F.col(f"p{k}") for k in range(len(model))]) if len(model) > 1 else F.col("p0")
    name = F.coalesce(*[F.when(F.col(f"p{k}") == best, F.lit(d)) for k, d in enumerate(model)])
    return rows.withColumn("rate", rate_of(by)).select("doc_id", "n_tokens", name.alias("domain"), best.alias("posterior"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, each as many times as its own rate says.

    The classifier and the multipliers are a few numbers, so that a second pass over docs takes each row's rate from its text and no text is shuffled.
    """
    rows, model, by = learned(docs, labels, domain, weights)
    discard(rows)
    if not model:
        return docs
    rated = posteriors(letter_counts(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))), model)
    times = settled(rated.withColumn("rate", rate_of(by)), _copies=copies(F.col("rate"), F.col("doc_id"))).filter("_copies > 0")
    return times.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents, domains being the languages of labelled ones."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
