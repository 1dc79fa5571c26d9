"""The subpackage's queries and their SQL, by the names that the driver asks for."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name: module of this subpackage.
MODULES = {
    "op1_substrings": "substrings",
    "op2_quality": "quality",
    "op3_packing": "packing",
    "op4_bpe": "bpe",
    "op5_rules": "rules",
    "op6_pii": "pii",
    "op7_html": "html",
    "op8_jaccard": "jaccard",
    "op9_vectors": "vectors",
    "op10_licenses": "licenses",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"canopy.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"canopy.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
