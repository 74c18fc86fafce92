"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import functools
import importlib

from tidemark.session import ship

#: Query name and the module of its operator.
MODULES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op2_token_file": "token_file",
    "op3_pieces": "pieces",
    "op4_topk": "topk",
    "op5_pseudonyms": "pseudonyms",
    "op6_language": "language",
    "op7_quality": "quality",
    "op8_html_text": "html_text",
    "op9_decontaminate": "decontaminate",
    "op10_ngram_join": "ngram_join",
}


def _query(module: str):
    operator = importlib.import_module(f"tidemark.llm.{module}")

    @functools.wraps(operator.query)
    def run(spark, sf_dir):
        ship(spark)
        return operator.query(spark, sf_dir)

    return run


QUERIES = {name: _query(module) for name, module in MODULES.items()}
ORACLE_SQL = {name: sql for name, module in MODULES.items() if (sql := getattr(importlib.import_module(f"tidemark.llm.{module}"), "SQL", None))}
