"""Queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.llm.line_dedup import OP4_SQL, op4_line_dedup
from terrane.llm.minhash import OP6_SQL, op6_minhash
from terrane.llm.mixing import op2_mixing
from terrane.llm.packing import op9_packing
from terrane.llm.paragraphs import op8_paragraphs
from terrane.llm.projections import OP7_SQL, op7_projections
from terrane.llm.quality import op5_quality
from terrane.llm.sharding import op10_sharding
from terrane.llm.substrings import op3_substrings
from terrane.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_substrings": op3_substrings,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_projections": op7_projections,
    "op8_paragraphs": op8_paragraphs,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op6_minhash": OP6_SQL, "op7_projections": OP7_SQL}
