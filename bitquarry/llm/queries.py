"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitquarry.llm.op10_line_dedup import OP10_SQL, op10_line_dedup
from bitquarry.llm.op1_toxicity import op1_toxicity
from bitquarry.llm.op2_token_files import op2_token_files
from bitquarry.llm.op3_jaccard import op3_jaccard
from bitquarry.llm.op4_warc import op4_warc
from bitquarry.llm.op5_secrets import op5_secrets
from bitquarry.llm.op6_decontaminate import op6_decontaminate
from bitquarry.llm.op7_url_filter import op7_url_filter
from bitquarry.llm.op9_top_k import OP9_SQL, op9_top_k
from bitquarry.llm.op8_bpe import op8_bpe


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_files, op3_jaccard, op4_warc, op5_secrets, op6_decontaminate, op7_url_filter, op8_bpe, op9_top_k, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op9_top_k": OP9_SQL, "op10_line_dedup": OP10_SQL}
