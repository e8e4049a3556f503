"""Base spans against the patterns as they stand; added spans on planted data; and what trees learn."""

import hashlib
import random
import re
import time

import numpy as np

from marlstone.llm.boosting import BoostedTrees
from marlstone.llm.pii import BASE, base_spans, candidates, find_personal_data, luhn, redacted, replaced, templates, written

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_on_noise():
    rng = random.Random(2)
    parts = ["a.b@c.d", "@", "x@y", "a@b.c@d.e.", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (437) 555-0689", "+12", " ", "-", "é@b.co", "0001.2.3.255", "+", "4111-1111-1111-1112", ".", "a", "9", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert sorted(base_spans(text)) == sorted(plain(text)), text


def test_long_runs_take_no_time():
    n = 1_000_000
    for text, want in (("7" * n, 0), ("7" * n + ".1.2.3", 0), ("1." * n, n // 4), ("1.2.3.4 " + "9" * n + " 5.6.7.8", 2), ("+" + "1" * n, 0), ("a" * n + "@", 0), ("1.1.1." + "0" * n + "1", 1)):
        began = time.perf_counter()
        assert sum(k == "ip" for k, _, _ in base_spans(text)) == want
        assert time.perf_counter() - began < 5


def test_query_columns(spark):
    texts = [None, "", "write to jo@site.org or 10.0.0.1; token = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\" ok", "nothing here 12 or 2024", "é" * 50 + " ssn: 123-45-6789", "x" * 200_000 + " a@b.co"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in find_personal_data(df).collect()}
    for k, t in enumerate(texts):
        base = base_spans(t or "")
        assert got[k].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert [got[k][f"n_{b}"] for b in BASE] == [sum(s[0] == b for s in base) for b in BASE]
        assert got[k].spans.startswith(written(base))
    assert got[2].spans == "email:9:20,ip:24:32,secret:43:83" and got[3].spans == "" and got[4].spans == "national:56:67"
    clean = {r.doc_id: r.text for r in redacted(df).collect()}
    assert clean[0] is None and clean[1] == "" and clean[3] == texts[3]
    assert clean[2] == 'write to [EMAIL] or [IP]; token = "[SECRET]" ok' == replaced(texts[2])


def test_held_out_templates():
    from marlstone.llm.pii import added_spans

    hits, false = [], 0
    for kind, text, a, b, label in templates(800, 99):
        found = added_spans(text, [])
        if label:
            hits.append(any(x < b and y > a for _, x, y in found))
        else:
            false += any(k == kind and (x, y) == (a, b) for k, x, y in found)
    assert np.mean(hits) > 0.85 and false < 40


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees(60).fit(x[:1000], y[:1000]).calibrate(x[1000:1500], y[1000:1500])
    assert ((m.probability(x[1500:]) > 0.5) == (y[1500:] == 1)).mean() > 0.95


def test_long_secrets_go_whole():
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for n in (199, 201, 600, 5000):
        secret = "sk-" + "".join(rng.choice(alphabet) for _ in range(n))
        assert replaced(f'token = "{secret}" ok') == 'token = "[SECRET]" ok'
    part = "".join(rng.choice(alphabet[:52]) for _ in range(400))
    for secret in (f"7{part}", f"{part}7", f"{part}7{part}"):
        assert ("secret", 9, 9 + len(secret)) in candidates(f'token = "{secret}" ok')


def test_secrets_without_digits_and_long_ones():
    for text, secret in (('password = "correcthorsebatterystaple" is set', "correcthorsebatterystaple"), ("api_key: purple-monkey-dishwasher-lamp", "purple-monkey-dishwasher-lamp"), ("token=" + "aB3x" * 80 + " end", "aB3x" * 80)):
        assert secret not in replaced(text) and "[SECRET]" in replaced(text), text
    for text in ("the password was changed: nobody knew", "a secret is a secret", "key points: many words follow here", None, ""):
        assert replaced(text) == text
