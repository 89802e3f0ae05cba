"""Queries of the operators in this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldlens.llm import grid_join, minhash, nearest, resampling, substrings
from fieldlens.llm.alignment import op11_alignment
from fieldlens.llm.byte_bpe import op1_byte_bpe
from fieldlens.llm.grid_join import op5_embedding_dedup
from fieldlens.llm.language_model import op7_language_model
from fieldlens.llm.lines import op9_line_dedup
from fieldlens.llm.minhash import op2_minhash
from fieldlens.llm.nearest import op3_nearest
from fieldlens.llm.packing import op4_packing
from fieldlens.llm.quality import op6_quality
from fieldlens.llm.resampling import op13_resampling
from fieldlens.llm.substrings import op12_substring_dedup
from fieldlens.llm.token_files import op8_token_files
from fieldlens.llm.toxicity import op10_toxicity
from fieldlens.session import ship_package

_ALL = (
    op1_byte_bpe, op2_minhash, op3_nearest, op4_packing, op5_embedding_dedup, op6_quality, op7_language_model, op8_token_files,
    op9_line_dedup, op10_toxicity, op11_alignment, op12_substring_dedup, op13_resampling,
)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {q.__name__: _shipped(q) for q in _ALL}
SQL: dict[str, str] = {"op2_minhash": minhash.SQL, "op3_nearest": nearest.SQL, "op5_embedding_dedup": grid_join.SQL,
                       "op12_substring_dedup": substrings.SQL, "op13_resampling": resampling.SQL}
