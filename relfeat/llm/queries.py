"""The corpus queries by name: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relfeat.llm import sql
from relfeat.llm.common import table
from relfeat.llm.decontaminate import op10_decontaminate
from relfeat.llm.jaccard import op4_ngram_jaccard
from relfeat.llm.line_dedup import op1_line_dedup
from relfeat.llm.lm_score import op5_lm_score
from relfeat.llm.mixing import op2_mixing
from relfeat.llm.substring_dedup import op8_substring_dedup
from relfeat.llm.token_files import op7_token_files
from relfeat.llm.topk import op6_topk_search
from relfeat.llm.toxicity import op3_toxicity
from relfeat.llm.url_filter import op9_url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _on(run: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: run(spark, *(table(spark, sf_dir, name) for name in names))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": _on(op1_line_dedup, "documents"),
        "op2_mixing": _on(op2_mixing, "documents"),
        "op3_toxicity": _on(op3_toxicity, "documents", "labels"),
        "op4_ngram_jaccard": _on(op4_ngram_jaccard, "documents"),
        "op5_lm_score": _on(op5_lm_score, "documents"),
        "op6_topk_search": _on(op6_topk_search, "embeddings"),
        "op7_token_files": _on(op7_token_files, "documents"),
        "op8_substring_dedup": _on(op8_substring_dedup, "documents"),
        "op9_url_filter": _on(op9_url_filter, "pages"),
        "op10_decontaminate": _on(op10_decontaminate, "documents", "benchmark"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": sql.LINE_DEDUP,
        "op6_topk_search": sql.TOPK_SEARCH,
        "op8_substring_dedup": sql.SUBSTRING_DEDUP,
        "op9_url_filter": sql.URL_FILTER,
        "op10_decontaminate": sql.DECONTAMINATE,
    }
