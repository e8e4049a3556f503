"""Runs against a comparison of all words at all distances."""

import hashlib
import random
import zlib

import numpy as np

from marlstone.llm.periodic import find_runs, op11_periodic_runs, periodic_runs, planted
from marlstone.llm.words import Words


def brute(words, least=12):
    """(start, length, period) of all runs."""
    best, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def found(texts):
    data = " ".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) + 1 for t in texts]])
    offsets[-1] = len(data)
    words = Words(np.frombuffer(data, np.uint8), offsets)
    runs = find_runs(words.numbers(), words.firsts)
    out = [[] for _ in texts]
    for s, e, q in runs.tolist():
        k = int(np.searchsorted(words.firsts, s, side="right")) - 1
        out[k].append((s - int(words.firsts[k]), e - s, q))
    return [sorted(r) for r in out]


def fibonacci(n):
    a, b = "b", "a"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue(n):
    return "".join(str(bin(k).count("1") % 2) for k in range(n))


def test_structured_texts():
    texts = [fibonacci(900), thue(700), "a" * 500, "ab" * 200 + "a" + "ab" * 200 + "a", "a" * 150 + "b" + "a" * 150 + "b" + "a" * 30, ("a" * 40 + "b") * 9, (fibonacci(60) + "c") * 7 + thue(64) * 3]
    texts += [("ab" * 40 + "a") * 3 + ("abc" * 30 + "ab") * 4, ("aab" * 50 + "aa") * 3 + "baab" * 60, ""]
    texts = [" ".join(t) for t in texts]
    assert found(texts) == [brute(t.split()) for t in texts]


def test_random_texts():
    rng = random.Random(3)
    texts = []
    for _ in range(250):
        letters = rng.choice(["ab", "abc", "abcdefghij"])
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):  # powers of powers, cut and disturbed
            p = rng.choice([1, 2, 3, 7, 31, 32, 33, 40, 63, 64, 65, 90, 130])
            cycle = [rng.choice(letters) for _ in range(p)]
            if rng.random() < 0.4:
                cycle = (cycle[: max(1, p // 5)] * 6)[:p]
            words += (cycle * 6)[: rng.randrange(p, 5 * p + 1)]
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = "x"
            words += [rng.choice(letters) for _ in range(rng.randrange(0, 9))]
        texts.append(" ".join(words))
    want = [brute(t.split()) for t in texts]
    assert max(max((q for _, _, q in w), default=0) for w in want) >= 130
    assert found(texts) == want
    assert [found([t])[0] for t in texts[:20]] == want[:20]


def reference(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return len(runs), s, length, q, 1000 * length // q if q else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["na", "Na", "é", "日本", "x"]) for _ in range(rng.randrange(0, 120))), "x") for k in range(150)]
    rows += [(200, None, "x"), (201, "", "y"), (202, " \t\n\x0b\f\r", "y"), (203, "one", "y"), (204, ("a b\xa0c　d  " * 300).strip(), "z"), (205, ("a b\n" * 40), "z"), (206, " ".join(["w"] * 30), "x")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {k: reference(k, t) for k, t, _ in rows}


def test_edges(spark):
    kind = "doc_id long, text string, collapsed string"
    assert periodic_runs(spark.createDataFrame([], kind)).collect() == []
    rows = [(None, "a " * 20, "c"), (1, "a " * 20, "c"), (1, "a " * 20, "c"), (1, "b", "c"), (2, None, "c")]
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(spark.createDataFrame(rows, kind)).collect()]
    assert sorted(got, key=str) == sorted([(None, [(0, 20, 1)], "a"), (1, [(0, 20, 1)], "a"), (1, [(0, 20, 1)], "a"), (1, [], "b"), (2, [], "")], key=str)
    assert planted(spark.createDataFrame(rows, kind)).count() == 5


def test_long_text(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(9)}" for _ in range(30_000)]
    text = " ".join([*base, *base, *base[:500]])
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (0, 60_500, 30_000) in [tuple(r) for r in row.runs] and len(row.collapsed.split()) <= 30_000
