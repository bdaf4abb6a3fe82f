"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterlab.llm import op11_decontaminate as decontaminate
from rosterlab.llm import op13_centroids as centroids
from rosterlab.llm.op1_winnowing import op1_winnowing
from rosterlab.llm.op2_projections import op2_projections
from rosterlab.llm.op3_bpe import op3_bpe_round_trip
from rosterlab.llm.op4_toxicity import op4_toxicity
from rosterlab.llm.op5_language import op5_language
from rosterlab.llm.op6_token_counts import op6_token_counts
from rosterlab.llm.op7_substrings import op7_substrings
from rosterlab.llm.op8_shuffle import op8_shuffle
from rosterlab.llm.op9_partenum import op9_partenum
from rosterlab.llm.op10_packing import op10_packing
from rosterlab.llm.op12_alignment import op12_alignment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": op1_winnowing,
    "op2_projections": op2_projections,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_token_counts": op6_token_counts,
    "op7_substrings": op7_substrings,
    "op8_shuffle": op8_shuffle,
    "op9_partenum": op9_partenum,
    "op10_packing": op10_packing,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_alignment": op12_alignment,
    "op13_centroids": centroids.op13_centroids,
}

ORACLES: dict[str, str] = {"op11_decontaminate": decontaminate.ORACLE, "op13_centroids": centroids.ORACLE}
