"""A corpus pipeline over documents: quality rules, n-gram Jaccard join, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it wrote, and returns a DataFrame; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import staged, table
from marlstone.llm.jaccard import one_of_each
from marlstone.llm.mixing import mixed
from marlstone.llm.packing import pack_documents
from marlstone.llm.pii import redacted
from marlstone.llm.quality import passing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    return passing(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each component of near copies."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their rates say, for the default target weights of languages."""
    return mixed(docs, table(spark, sf_dir, "labels"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", ngram_jaccard_join), ("personal_data", personal_data), ("mixing", mixing), ("best_fit_packing", best_fit_packing)]

#: SQL can express neither the certified cutoffs nor the tokenizer; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
