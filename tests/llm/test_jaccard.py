"""The Jaccard join against a comparison of all pairs."""

import random
import re

from marlstone.llm import common, jaccard
from marlstone.llm.components import components
from marlstone.llm.jaccard import jaccard_components, one_of_each

SCHEMA = "doc_id long, text string, key string, n int"


def brute(rows):
    sets, least = {}, {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        sets[doc] = grams
        least[doc] = doc

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = top(a), top(b)
                least[max(p, q)] = min(p, q)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def found(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}


def test_families_passages_and_edges(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["Über", "na", "ko", "ra", "mi", "to", "LA", "ße"]) + str(rng.randrange(300))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(60):
        rows.append([word() for _ in range(rng.randrange(3, 60))])
    for _ in range(40):
        rows.append([word() for _ in range(10)] + passage + [word() for _ in range(rng.randrange(0, 30))])
    base = [word() for _ in range(80)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(copy[: rng.randrange(55, 81)])
    rows += [rows[3], rows[3], rows[100], ["one"], ["one"], ["one", "two"]]
    texts = [" ".join(r) for r in rows] + ["", None, " \n\t", "a b c\x0bd e f"]
    texts = [t.replace(" ", rng.choice([" ", "  ", "\n"])) if t and k % 7 == 0 else t for k, t in enumerate(texts)]
    rng.shuffle(texts)
    data = list(enumerate(texts))
    assert found(spark, data) == brute(data)


def test_large_groups_and_chunks(spark, monkeypatch):
    """Groups and columns of many chunks: near copies of near copies, and a passage that unlike texts share."""
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    rng = random.Random(8)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(4000)}"
    passage, rows = [word() for _ in range(30)], []
    for _ in range(3):
        chain = [word() for _ in range(70)]
        for _ in range(90):
            chain = list(chain)
            chain[rng.randrange(len(chain))] = word()
            rows.append(chain)
    rows += [[word() for _ in range(rng.randrange(4, 16))] + passage for _ in range(120)]
    rows += [[word() for _ in range(30_000)]] * 2
    rng.shuffle(rows)
    data = [(k, " ".join(r)) for k, r in enumerate(rows)]
    want = brute(data)
    assert len({c for _, c in want.values()}) < len(rows) - 200
    assert found(spark, data) == want
    monkeypatch.setattr(jaccard, "TURNS", 0)
    assert found(spark, data) == want, "the product alone gives the same"


def test_empty_null_and_repeated(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c d e f", "x", 1), (4, "a b c d e f", "x", 1), (4, "a b c d e f", "x", 1), (5, None, None, None)], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(-1, 2, 4), (4, 2, 4), (4, 2, 4), (5, 0, 5)]
    assert one_of_each(df).count() == 4


def test_rows_left_out_by_chance_are_settled(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"t{k}", "x", 1) for k in range(600)] + [(None, "t", "x", 1), (5, "again", None, None)], SCHEMA)
    dropped = spark.createDataFrame([(k,) for k in range(0, 600, 3)], "doc_id long")
    want = sorted(r.text for r in docs.collect() if r.doc_id is None or r.doc_id % 3)
    for bits, most in ((1 << 24, 1 << 18), (64, 1 << 18), (256, 3)):
        monkeypatch.setattr(common, "ID_BITS", bits)
        monkeypatch.setattr(common, "MOST_CHANCES", most)
        kept = common.left_out(docs, dropped)
        assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == want


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
