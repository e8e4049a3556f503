"""Counts against plain Python, tails against exact fractions, and the limit on false rejections."""

import math
import re
import struct
from collections import Counter
from fractions import Fraction

import xxhash
from pyspark.sql import functions as F

from marlstone.llm.quality import GRID, RULES, binomial_tail, certified_cutoffs, judged, passing, text_counts

DOCS = "doc_id long, text string, lang string, source string, n_words string"


def plain(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(grams)
    again = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_counts(spark):
    texts = [None, "", " ", "a", "a b", "a b c a b c", "x y z " * 30, "l1 é\nl1 é\n\n \n\nl1 é\n l1 é", "##* <b>|&%$\x0b\x0ctab\tend\r\n", "ß ü 日本 語\xa0x", "a a a a"]
    df = spark.createDataFrame([(k, t, "en", "s", "x") for k, t in enumerate(texts)], DOCS).select("doc_id", "text", "lang")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in text_counts(df).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}


def test_tail_is_exact(spark):
    cases = [(0, 10), (1, 10), (3, 200), (0, 1), (15, 900), (40, 1700), (0, 0), (300, 9000)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", binomial_tail(F.col("k"), F.col("n"), 0.05))
    for r in df.collect():
        p = Fraction(1, 20)
        exact = float(sum(math.comb(r.n, j) * p**j * (1 - p) ** (r.n - j) for j in range(r.k + 1)))
        if r.n and r.k < r.n * 0.05:
            assert abs(r.p / exact - 1) < 1e-9
        else:
            assert r.p == 1


def test_cutoffs_keep_their_promise_and_catch_junk(spark):
    rows, labels = [], []
    for k in range(4000):
        junk = k % 5 == 0
        words = [f"w{k}x{j}" + ("***" if junk and k % 10 == 0 else "") for j in range(60)]
        rows.append((k, " ".join(words).upper() if junk and k % 10 else " ".join(words), "en" if k < 3900 else None, "s", "x"))
        if k % 2 or junk:
            labels.append((k, 0 if junk else 1, None))
    rows += [(4000, None, None, None, None), (None, "short", "xx", None, None)]
    df, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in judged(df, known).collect()}
    assert all(out[k].kept == (k % 5 != 0) for k in range(3900))
    assert all(out[k].kept for k in range(3900, 4000)), "too few labels certify nothing"
    assert not out[4000].kept and out[4000].base_failed and not out[None].kept
    kept = passing(df, known)
    assert {r.doc_id for r in kept.collect()} == {k for k, r in out.items() if r.kept} and kept.columns == df.columns
    cuts = certified_cutoffs(text_counts(df.select("doc_id", "text", "lang")), known).collect()
    assert len(cuts) == 1 and cuts[0].cut_symbols and cuts[0].cut_capitals and len(RULES) == 5


def in_plain(rows, labels):
    """Verdicts by loops over rows: (doc_id, text, lang) and doc_id -> quality."""
    measured = []
    for doc, text, lang in rows:
        text = text or ""
        n_words, letters, symbols, lines, again = plain(text)
        all_lines = sum(bool(re.search("[^\x20\x09-\x0d]", x)) for x in text.split("\n"))
        parts = [(symbols, n_words), (text.count("!"), n_words), (sum("A" <= c <= "Z" for c in text), letters), (again, n_words), (lines, all_lines)]
        measured.append((doc, lang, n_words < 50 or 100 * again > 50 * n_words, [1000 * a // max(b, 1) for a, b in parts]))
    chosen = {}
    for stratum in {m[1] for m in measured}:
        own = [(xxhash.xxh64(struct.pack("<q", d), seed=42).intdigest(), labels[d], r) for d, lang, failed, r in measured if d in labels and lang == stratum and not failed]
        signed = [(h - (1 << 64) if h >> 63 else h, q, r) for h, q, r in own]
        first, held = [x for x in signed if x[0] % 3 == 0], [x for x in signed if x[0] % 3]
        for rule in range(len(RULES)):
            gains = [(sum(q == 0 for _, q, r in first if r[rule] > c) - 20 * sum(q == 1 for _, q, r in first if r[rule] > c), c) for c in GRID]
            gain, cut = max(gains)
            if gain > 0.02 * sum(q == 0 for _, q, _ in first):
                chosen[stratum, rule] = cut, sum(q == 1 for _, q, _ in held), sum(q == 1 for _, q, r in held if r[rule] > cut)
    cuts = {}
    for (stratum, rule), (cut, n, k) in chosen.items():
        p = Fraction(1, 20 * sum(s == stratum for s, _ in chosen))
        if sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) <= Fraction(1, 20 * len(chosen)):
            cuts[stratum, rule] = cut
    return {d: not failed and not any(r[k] > cuts.get((lang, k), 1 << 60) for k in range(len(RULES))) for d, lang, failed, r in measured}, cuts


def test_verdicts_are_those_of_loops(spark):
    rows, labels = [], {}
    for k in range(1500):
        bad = k % 4 == 0
        words = [f"w{k}x{j}" + ("##" if bad and j % 2 else "!" if k % 7 == 0 and j % 9 == 0 else "") for j in range(40 + k % 41)]
        if k % 11 == 0:
            words[::3] = ["LOUD"] * len(words[::3])
        rows.append((k, " ".join(words) + "\n" + " ".join(words[:3]) + "\nsame line\nsame line" * (k % 5 == 0), "en" if k % 3 else "de"))
        if k % 10 != 1:
            labels[k] = 0 if bad else 1
    rows += [(5000, "long " * 20 + " ".join(f"v{j}" for j in range(60_000)), "de"), (5001, None, "de"), (5001, "a b", "de"), (5002, "", "fr")]
    want, cuts = in_plain(rows, labels)
    assert {s for s, _ in cuts} == {"en", "de"}
    df = spark.createDataFrame([(*r, "s", "x") for r in rows], DOCS)
    got = judged(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and {r.doc_id: r.kept for r in got} == want


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert judged(none, spark.createDataFrame([], "doc_id long, quality int")).collect() == []
