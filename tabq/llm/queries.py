"""The queries of this subpackage and their SQL, by name. A query without SQL is tested against a brute-force version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact, lm, mixing, neardup, packing, quality, substrings, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_suffix_array": suffixes.op2_suffix_array,
    "op3_packing": packing.op3_packing,
    "op4_mixing": mixing.op4_mixing,
    "op5_substrings": substrings.op5_substrings,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat": chat.op7_chat,
    "op8_quality": quality.op8_quality,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_minhash": neardup.op10_minhash,
}
ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact.ORACLE,
    "op2_suffix_array": suffixes.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_substrings": substrings.ORACLE,
    "op7_chat": chat.ORACLE,
    "op8_quality": quality.ORACLE,
    "op10_minhash": neardup.ORACLE,
}
