"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import oracles
from signalloom.llm.bpe import op3_bpe
from signalloom.llm.decontaminate import op5_decontaminate
from signalloom.llm.language import op1_language
from signalloom.llm.line_dedup import SQL as LINE_SQL
from signalloom.llm.line_dedup import op9_line_dedup
from signalloom.llm.media import op4_media
from signalloom.llm.minhash import op8_minhash
from signalloom.llm.substring_dedup import op6_substring_dedup
from signalloom.llm.suffix_dedup import op10_suffix_dedup
from signalloom.llm.token_counts import op7_token_counts
from signalloom.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language, op2_toxicity, op3_bpe, op4_media, op5_decontaminate, op6_substring_dedup, op7_token_counts, op8_minhash, op9_line_dedup, op10_suffix_dedup)
}

ORACLE_SQL: dict[str, str] = {"op9_line_dedup": LINE_SQL} | oracles.SQL
