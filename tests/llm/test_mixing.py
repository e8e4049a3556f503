"""Posteriors, targets that can be met and that cannot, and rounding."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.llm.mixing import LETTERS, fitted_rates, mixed, mixture

SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string"


def data(spark):
    rng = random.Random(3)
    words = {"en": "the what which show with how", "es": "ñora qué ella señora niño año", "de": "für größe schön übung straße"}
    rows = []
    for k in range(600):
        lang = "en" if k % 10 < 7 else "es" if k % 10 < 9 else "de"
        rows.append((k, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(20, 80))), lang, "s", "x"))
    rows += [(600, None, "en", None, None), (601, "", None, None, None), (None, "the what", "xx", "s", "x")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, 1) for k in range(0, 600, 3)] + [(None, 1)], "doc_id long, quality int")


def test_targets_are_met(spark):
    docs, labels = data(spark)
    weights = {"en": 0.4, "es": 0.3, "de": 0.3}
    rows = mixture(docs, labels, weights=weights).collect()
    assert len(rows) == 603 and all(r.rate >= 0 for r in rows)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(r.domain == truth[r.doc_id] for r in rows if r.doc_id is not None and r.doc_id < 600) > 590
    total = sum(r.n_tokens for r in rows)
    for d, w in weights.items():
        got = sum(r.rate * r.n_tokens for r in rows if r.domain == d)
        assert abs(got / total - w) < 0.02
    kept = mixed(docs, labels, weights=weights)
    assert kept.columns == docs.columns
    by = {r.lang: r.n for r in kept.groupBy("lang").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert abs(by["es"] / sum(v for v in by.values() if v and v > 0) - 0.3) < 0.08


def test_copies_follow_the_rates_of_rows(spark):
    docs, labels = data(spark)
    docs = docs.withColumnsRenamed({"source": "rate", "n_tokens": "copies"}).union(spark.createDataFrame([(7, "größe schön " * 30_000, "de", "s", "x"), (3, "the what", "en", None, None), (3, "the what", "en", None, None)], SCHEMA))
    weights = {"en": 0.3, "es": 0.3, "de": 0.4}
    told = sorted((r.doc_id or -1, r.n_tokens, r.copies) for r in mixture(docs, labels, weights=weights).collect())
    kept = mixed(docs, labels, weights=weights)
    assert kept.columns == docs.columns
    out = Counter((r.doc_id or -1, len((r.text or "").split())) for r in kept.collect())
    want = Counter()
    for doc, n, times in told:
        want[doc, n] += times
    assert +out == +want and max(out.values()) > 1


def test_posteriors_are_those_of_loops(spark):
    docs, labels = data(spark)
    rows, known = [(r.doc_id, (r.text or "").lower(), r.lang) for r in docs.collect()], {r.doc_id for r in labels.collect()} - {None}
    sums, n_rows = {}, Counter()
    for doc, text, lang in rows:
        if doc in known:
            n_rows[lang] += 1
            sums.setdefault(lang, Counter()).update(c for c in text if c in LETTERS)
    model = {d: (math.log(n_rows[d] / sum(n_rows.values())), {c: math.log((sums[d][c] + 1) / (sum(sums[d].values()) + len(LETTERS))) for c in LETTERS}) for d in sorted(sums)}
    got = {r.doc_id: r for r in mixture(docs, labels).collect()}
    for doc, text, _ in rows:
        letters = [c for c in text if c in LETTERS]
        sharp = 4 * min(math.sqrt(len(letters)), 12.0)
        logs = {d: prior + (sharp * sum(w[c] for c in letters) / len(letters) if letters else 0) for d, (prior, w) in model.items()}
        best = max(logs, key=logs.get)
        assert got[doc].domain == best and abs(got[doc].posterior - 1 / sum(math.exp(x - logs[best]) for x in logs.values())) < 1e-9


def test_rates_stay_nonnegative(spark):
    rows = spark.createDataFrame([(k, 10, float(k % 2), 1 - float(k % 2)) for k in range(20)], "doc_id long, n_tokens long, p0 double, p1 double")
    out = fitted_rates(rows, 2, [1.0, 0.0]).collect()
    assert all((r.rate > 1.9) if r.p0 else (r.rate < 0.02) for r in out)


def test_empty_and_unlabelled(spark):
    docs, labels = data(spark)
    assert mixture(docs.filter(F.lit(False)), labels).collect() == []
    assert {r.rate for r in mixture(docs, labels.filter(F.lit(False))).collect()} == {1.0}


def test_rare_domain_reaches_its_target(spark):
    rows = [(k, 10, 0.02, 0.98) for k in range(3000)] + [(3000 + k, 10, 0.97, 0.03) for k in range(2)]
    rows = spark.createDataFrame(rows, "doc_id long, n_tokens long, p0 double, p1 double")
    for share in (0.25, 0.85):
        out = fitted_rates(rows, 2, [share, 1 - share]).collect()
        got = [sum(r.rate * r.n_tokens * r[f"p{k}"] for r in out) / 30_020 for k in range(2)]
        assert abs(got[0] - share) < 0.002 and abs(got[1] - 1 + share) < 0.002 and min(r.rate for r in out) >= 0


def test_targets_out_of_reach_are_told(spark):
    rows = spark.createDataFrame([(k, 10, 0.6, 0.4) for k in range(20)], "doc_id long, n_tokens long, p0 double, p1 double")
    with pytest.warns(UserWarning, match="no rates meet"):
        out = fitted_rates(rows, 2, [0.9, 0.1]).collect()
    # the least of (6x - 9)^2 / 9 + (4x - 1)^2 / 4 stands where (36 / 9 + 16 / 4) x = 54 / 9 + 4 / 4
    assert all(abs(r.rate - 7 / 8) < 0.01 for r in out)
