"""Divergences against plain sums over all terms, and the walk of two trees against whole matrices."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import divergence
from marlstone.llm.divergence import apart, divergences, pair_sums, shares


def brute(rows):
    seen, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        seen[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in seen}:
        kept = {t for t, d in docs[lang].items() if d >= 3}
        of = {s: {t: c[t] for t in kept if c[t]} for (x, s), c in seen.items() if x == lang}
        total = Counter()
        for c in of.values():
            total.update(c)
        share = lambda c: {t: 1 + 10**9 * (c.get(t, 0) + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in of.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in of:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in of if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in of[s] if p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= 200]
    return sorted(out)


def corpus(seed, sources):
    rng = random.Random(seed)
    words = [rng.choice(["Na", "ko", "é", "ÉÉ", "日本", "ra", "Zu"]) + "".join(rng.choice("abcXYZßñ") for _ in range(rng.randrange(0, 3))) for _ in range(150)]
    rows = []
    for k in range(300):
        source = f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        bias = words[int(source[1:]) % 7 * 10 :][:60] if rng.random() < 0.7 else words
        text = "".join(rng.choice(bias) + rng.choice([" ", ",", "1", "\n", "_", "\x00", "'"]) for _ in range(rng.randrange(0, 50)))
        rows.append((rng.choice(["en", "de"]), source, text))
    rows += [("fr", "a", "one two"), ("fr", "b", "three"), ("it", "x", "solo solo"), (None, None, "lost"), (None, "y", None), ("en", None, None), ("de", "silent", "123 !?")]
    return rows


@pytest.mark.parametrize(("sources", "cells", "pairs"), [(12, 1 << 17, 1 << 18), (30, 40, 100)])
def test_all_terms(spark, monkeypatch, sources, cells, pairs):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "PAIRS", pairs)  # several blocks, and stripes of 8 rows
    rows = corpus(sources, sources)
    df = spark.createDataFrame([(None, *r, 5, "t") for r in rows], "doc_id long, lang string, source string, text string, n int, term string")
    assert sorted(tuple(r) for r in divergences(df).collect()) == brute(rows)


def test_walk_prices_zero_quadrants():
    rng = np.random.default_rng(4)
    for groups, width in ((1, 1), (3, 200), (20, 1000), (70, 300), (9, 64)):
        counts = rng.integers(1, 50, (groups, width)) * (rng.random((groups, width)) < 0.03)
        counts[: groups // 2, width // 2 :] = 0
        r, c = np.nonzero(counts)
        totals = counts.sum(axis=1) + width
        p = shares(counts, totals[:, None])
        want = apart(p[:, None, :], p[None, :, :]).sum(axis=2)
        for first in range(0, groups, 16):
            last = min(groups, first + 16)
            assert (pair_sums(r, c, counts[r, c], totals, width, first, last) == want[first:last]).all()


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(2000):
        total = rng.randrange(1, 9 * 10**15)
        n = rng.randrange(0, total)
        assert shares(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total


def test_edges(spark):
    kind = "doc_id int, lang string, source string, text string"
    assert divergences(spark.createDataFrame([], kind)).collect() == []
    long = "Word " * 200_000 + "x" * 100_000
    rows = [("en", "a", long), ("en", "b", long), ("en", "a", "word"), ("en", "a", "word")]
    assert sorted(tuple(r) for r in divergences(spark.createDataFrame([(1, *r) for r in rows], kind)).collect()) == brute(rows)


def test_many_terms_are_ranked(spark):
    rows = [("en", s, " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(a, b))) for s, a, b in (("a", 0, 400), ("b", 0, 400), ("a", 0, 300), ("c", 0, 400), ("c", 100, 400))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id int, lang string, source string, text string")
    found = divergences(df)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
