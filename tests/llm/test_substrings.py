"""Removed words against a look at every window of every document."""

import hashlib
import random

import numpy as np

from marlstone.llm import substrings
from marlstone.llm.substrings import levels, op12_substring_dedup, without_repeats
from marlstone.llm.words import Words, grams


def brute(rows, length=50):
    """Sorted (doc, n_words, n_removed, kept) of rows (doc, text)."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(w) - len(left), b" ".join(left).decode()))
    return sorted(out, key=str)


def corpus(seed, length=50):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Na", "na", "ko", "é", "日本", "x\xa0y"]) + str(rng.randrange(40))
    some = lambda n: [word() for _ in range(n)]
    passages = [some(n) for n in (length - 1, length, length + 1, 2 * length, 4 * length + 3)]
    rows = []
    for _ in range(60):
        text = some(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 8)
            text += p[a if rng.random() < 0.5 else 0 : len(p) - rng.choice([0, 0, 1, 5])] + some(rng.randrange(0, 30))
        rows.append(text)
    base = some(3 * length)
    for _ in range(25):  # near copies
        copy = list(base)
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(copy)
    rows += [rows[3], rows[3], rows[70], ["a"] * (length + 20), ["a"] * (length + 9), ["a", "b"] * length, some(length - 1)]
    texts = [rng.choice([" ", "  ", "\n", "\t \x0b"]).join(r) for r in rows] + ["", None, " \n"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts, strict=True), (7, texts[0]), (7, texts[61]), (7, texts[61]), (None, texts[61]), (None, None)]


def found(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, kept string, places int")
    return sorted((tuple(r) for r in without_repeats(df, **kw).collect()), key=str)


def test_every_window(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(spark, rows) == brute(rows)


def test_more_levels(spark):
    assert levels(50) == [25, 50] and levels(200) == [25, 50, 100, 200] and levels(90) == [23, 45, 90] and levels(7) == [4, 7]
    for length in (7, 130):
        rows = corpus(3, length)
        assert found(spark, rows, length=length) == brute(rows, length)


def test_edges(spark):
    kind = "doc_id int, text string"
    assert without_repeats(spark.createDataFrame([], kind)).collect() == []
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(5, long), (9, long + " end"), (1, "few words")]
    got = sorted((r.doc_id, r.n_words, r.n_removed, len(r.kept)) for r in without_repeats(spark.createDataFrame(rows, kind)).collect())
    assert got == [(1, 2, 0, 9), (5, 30_000, 0, len(long)), (9, 30_001, 30_000, 3)]


def test_query(spark, tmp_path):
    rows = [r for r in corpus(4) if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op12_substring_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows))


def test_grams_and_selection():
    data = np.frombuffer(b"a b c a b c a d", np.uint8)
    p = Words(data, np.array([0, len(data)])).prints(1)
    for width in range(1, 9):
        g = grams(p, width)
        assert len(g) == 9 - width and len(set(g.tolist())) == len({"abcabcad"[k : k + width] for k in range(9 - width)})
    values = np.random.default_rng(0).integers(0, 1 << 62, 500).astype(np.uint64)
    at = substrings.selected(values, 26)
    assert np.diff(at).max() <= 26 and len(at) < 80
