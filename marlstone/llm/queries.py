"""The queries of this subpackage, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .covertree import OP5_SQL, op5_embedding_near_dedup
from .divergence import OP13_SQL, op13_source_divergence
from .html import op1_html_extraction
from .jaccard import OP8_SQL, op8_ngram_jaccard_join
from .mixing import op7_mixing
from .packing import op10_best_fit_packing
from .periodic import OP11_SQL, op11_periodic_runs
from .pii import op9_pii
from .quality import op6_quality_rules
from .token_files import op4_token_files
from .substrings import OP12_SQL, op12_substring_dedup
from .toxicity import op3_toxicity
from .warc import OP2_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_extraction, op2_warc, op3_toxicity, op4_token_files, op5_embedding_near_dedup, op6_quality_rules, op7_mixing, op8_ngram_jaccard_join, op9_pii, op10_best_fit_packing, op11_periodic_runs, op12_substring_dedup, op13_source_divergence]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op5_embedding_near_dedup": OP5_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op11_periodic_runs": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
