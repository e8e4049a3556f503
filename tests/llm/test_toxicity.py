"""The fuzzy automaton against edit distances, contexts, and accuracy on held-out rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm.common import table
from marlstone.llm.toxicity import DISCOUNT, FEATURES, WORD, FuzzyLexicon, Reader, edits_for, fitted, quotation, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    word = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randrange(lo, hi)))
    terms = {word(3, 12): 1.0 for _ in range(40)}
    lexicon = FuzzyLexicon(terms)
    for _ in range(3000):
        w = word(1, 13)
        near = min(((distance(w, t), t) for t in terms if distance(w, t) <= edits_for(len(t))), default=None)
        assert lexicon.meet(w) == ((near[1], near[0], False) if near else None)


def test_stems_and_context():
    reader = Reader(FuzzyLexicon({"idiot": 3.0}, {"grum": 2.0}))
    row = dict(zip(FEATURES, reader.features("You idi0t, grumblers!"), strict=True))
    assert row["fuzzy"] > 0 and row["stems"] > 0 and row["addressed"] > 0 and row["exact"] == np.log1p(DISCOUNT)
    quoted = dict(zip(FEATURES, reader.features('The word "idiot" was in the text'), strict=True))
    assert quoted["quoted"] > 0 and quoted["exact"] == 0
    assert reader.features(None) == reader.features("") == reader.features("a grum of") == [0.0] * len(FEATURES)


def data(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        words = ["w" + str(rng.randrange(500)) for _ in range(40)]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["zorbler", "moron", "flinkish", "zorbIer"])
        rows.append((k, " ".join(words), "en", 0.5))
        labels.append((k, 1, int(toxic)))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "moron moron zorbler", "en", 0.1), (1002, "zorbler " * 50_000, "en", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")


def test_held_out_rows(spark):
    docs, labels = data(spark)
    out = {r.doc_id: r for r in toxicity(docs, fitted(docs, labels)).collect()}
    assert len(out) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = [r for k, r in out.items() if k is not None and k < 600 and r.held_out]
    assert len(held) > 60 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.98
    assert out[1000].score == out[1001].score < 0.5 and out[None].predicted == 1 and out[1002].predicted == 1 and out[None].held_out is None


def test_without_labels(spark):
    docs, labels = data(spark)
    scorer = fitted(docs, labels.filter(F.lit(False)))
    out = {r.doc_id: r.predicted for r in toxicity(docs, scorer).collect()}
    assert out[None] == 1 and out[1000] == 0
    assert toxicity(docs.filter(F.lit(False)), scorer).collect() == []


def test_rare_learned_terms_keep_their_edits(spark):
    rows = [(k, "one two three " + ("grimblatz" if k < 32 and k % 4 == 0 else "moron" if k % 4 == 0 else "four"), int(k % 4 == 0)) for k in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon = fitted(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")).lexicon
    assert "grimblatz" in lexicon.term and lexicon.meet("grimblotz") == ("grimblatz", 1, False) and lexicon.meet("grmblotz") == ("grimblatz", 2, False)


def test_words_left_unread_meet_nothing():
    rng = random.Random(7)
    word = lambda lo, hi: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(lo, hi)))
    terms = [word(3, 13) for _ in range(60)]
    lexicon = FuzzyLexicon(dict.fromkeys(terms, 1.0), {"abcd": 1.0})
    for _ in range(4000):
        t = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "a", "z"])
        w = "".join(t)
        if any(distance(w, x) <= edits_for(len(x)) for x in terms):
            assert lexicon.may_meet(w) and lexicon.meet(w) is not None
    assert lexicon.may_meet("abcdzzzzzzzzzzzzzzzzzzzzz") and not lexicon.may_meet("zzzzzzzzz")


def test_misspelled_terms_are_met_and_contexts_weigh(spark):
    rng, vowels = random.Random(4), "aeiou"
    terms = ["".join(rng.choice("bdfglmnprst") + rng.choice(vowels) for _ in range(rng.randrange(3, 6))) for _ in range(12)]
    filler = lambda: " ".join("".join(rng.choice("chjkqvwxyz") + rng.choice(vowels) for _ in range(3)) for _ in range(30))
    rows = [(k, f"{filler()} {terms[k // 3 % 12]} {filler()}" if k % 3 == 0 else filler(), int(k % 3 == 0)) for k in range(900)]
    rows += [rows[0], rows[0], (901, None, 0), (902, "", 0)]
    docs = spark.createDataFrame([(d, t, "x", 1.5) for d, t, _ in rows], "doc_id long, text string, predicted string, score double")
    scorer = fitted(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    assert set(terms) <= set(scorer.lexicon.term)
    wrong = {t: t[:2] + "q" + t[3:] for t in terms if len(t) >= 5}
    assert sum(scorer.lexicon.meet(w) is not None for w in wrong.values()) >= 0.9 * len(wrong)
    signs = dict(zip(FEATURES, scorer.weights, strict=False))
    assert signs["quoted"] < 0 < signs["fuzzy"] and min(v for k, v in signs.items() if k != "quoted") >= 0
    reader = Reader(scorer.lexicon)
    score = lambda text: float(scorer.score(np.array([reader.features(text)]))[0])
    t = terms[0]
    assert score(f"you {t} and {wrong[t]}") > 0.5 > score(f'he said the word "{t}" once')
    out = toxicity(docs, scorer)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)
    assert len({r.score for r in out.filter("doc_id = 0").collect()}) == 1


def test_misspelled_documents(spark):
    """Every term of held-out toxic texts with one letter replaced by another, any of them; quotations put into clean ones."""
    folder, rng = "/root/testdata/sf0.1", random.Random(5)
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scorer = fitted(docs, labels)
    weights = dict(zip(FEATURES, scorer.weights, strict=False))
    assert weights["fuzzy"] > 0 > weights["quoted"]
    held = docs.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").select("text", "toxic").collect()
    reader = Reader(scorer.lexicon)
    score = lambda texts: scorer.score(np.array([reader.features(t) for t in texts]))
    toxic, clean = ([r.text for r in held if r.toxic == y] for y in (1, 0))
    assert (score(toxic) >= 0.5).mean() >= 0.9 and (score(clean) >= 0.5).mean() < 0.01
    assert (score([quotation(t, "moron") for t in clean]) >= 0.5).mean() < 0.01

    def spoiled(text):
        def put(found):
            w = found[0]
            m = reader.met.get(w.lower())
            at = rng.randrange(len(m[0])) if m else 0
            return w if m is None else w[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz01") + w[at + 1 :]

        reader.features(text)
        return WORD.sub(put, text)

    assert (score([spoiled(t) for t in toxic]) >= 0.5).mean() >= 0.8


def test_words_of_their_own_are_no_misspellings():
    lexicon = FuzzyLexicon({"idiots": 1.0, "worthless": 1.0}, {"grumbl": 1.0}, {("worthless", False): 1}, ["idioms", "grumple"])
    assert lexicon.meet("idiots") == ("idiots", 0, False) and lexicon.meet("idiocs") == ("idiots", 1, False) and lexicon.meet("idioms") is None
    assert lexicon.meet("worthles") == ("worthless", 1, False) and lexicon.meet("worthes") is None  # two edits were not certified
    assert lexicon.meet("grumbler") == ("grumbl", 0, True) and lexicon.meet("grumpler") == ("grumbl", 1, True) and lexicon.meet("grumple") is None and lexicon.meet("xgrumbler") == ("grumbl", 1, True)
    reader = Reader(lexicon)
    assert reader.misspelled("you IDIOTS and more") not in (None, "you IDIOTS and more") and reader.misspelled("nothing") is None
