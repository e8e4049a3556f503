"""The pipeline on a small table: which documents stay, what becomes of them, and how they are packed."""

import random

import pytest

import corpus_pipeline
from marlstone.llm.common import staged
from marlstone.llm.pii import replaced
from tests.llm.test_jaccard import brute
from tests.llm.test_quality import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5)))
    rows = []
    for k in range(60):
        rows.append(" ".join(word() for _ in range(rng.randrange(55, 120))) + f" mail{k}@site.org")
    rows += [rows[4], rows[5] + " one", rows[6].replace(" ", "  "), "short text", None, "", "again and " * 60, "x " * 20_000]
    docs = [(k, t, "en" if k % 3 else "de", "s", None if t is None else len(t)) for k, t in enumerate(rows)] + [(None, rows[9] + " no id at all", "en", "s", 1)]
    folder = tmp_path_factory.mktemp("data")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", docs


def test_every_stage(spark, corpus):
    folder, rows = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
    kept = [r for r in rows if plain(r[1])[0] >= 50 and 100 * plain(r[1])[4] <= 50 * plain(r[1])[0]]
    assert sorted(r.doc_id or -1 for r in seen["quality_rules"]) == sorted(r[0] or -1 if r[0] is not None else -1 for r in kept)
    known = [(r[0], r[1]) for r in kept if r[0] is not None]
    firsts = {d for d, (_, c) in brute(known).items() if d == c}
    assert {r.doc_id for r in seen["ngram_jaccard_join"]} == firsts | {None}
    by = {r.doc_id: r.text for r in seen["ngram_jaccard_join"]}
    assert all(r.text == replaced(by[r.doc_id]) and "[EMAIL]" in r.text and r.n_chars == len(r.text) for r in seen["personal_data"])
    assert {r.doc_id for r in seen["mixing"]} <= set(by) and len(seen["mixing"]) > 0.8 * len(by)
    bins = {}
    for r in seen["best_fit_packing"]:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 2048 for b in bins.values())
    assert {r.doc_id for r in seen["best_fit_packing"]} == {r.doc_id for r in seen["mixing"]}


def test_stages_are_those_of_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "personal_data", "mixing", "best_fit_packing"] and corpus_pipeline.ORACLE_SQL is None
