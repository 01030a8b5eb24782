"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.fingerprints import op1_fingerprints
from barloom.llm import alignment, jpeg, licences, outliers
from barloom.llm.jaccard import op5_jaccard
from barloom.llm import merkle
from barloom.llm.mixing import OP3_SQL, op3_mixing
from barloom.llm.packing import op2_packing
from barloom.llm.pii import op9_pii
from barloom.llm.secrets import op7_secrets
from barloom.llm.sharding import op6_sharding
from barloom.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard": op5_jaccard,
    "op6_sharding": op6_sharding,
    "op7_secrets": op7_secrets,
    "op8_licences": licences.op8_licences,
    "op9_pii": op9_pii,
    "op10_media": jpeg.op10_media,
    "op11_outliers": outliers.op11_outliers,
    "op12_alignment": alignment.op12_alignment,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": OP3_SQL,
    "op8_licences": licences.oracle(),
    "op13_merkle": merkle.oracle(),
}
