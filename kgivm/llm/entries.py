"""Queries of the subpackage and their SQL twins."""

from __future__ import annotations

from kgivm.llm import oracles
from kgivm.llm.op1_curve_packing import op1_curve_packing
from kgivm.llm.op2_ngram_jaccard_join import op2_ngram_jaccard_join
from kgivm.llm.op3_pii import op3_pii
from kgivm.llm.op4_secret_scan import op4_secret_scan
from kgivm.llm.op5_html_extraction import op5_html_extraction
from kgivm.llm.op6_token_counts import op6_token_counts
from kgivm.llm.op7_repeated_bytes import op7_repeated_bytes
from kgivm.llm.op8_token_files import op8_token_files
from kgivm.llm.op9_quality_rules import op9_quality_rules
from kgivm.llm.op10_decontamination import op10_decontamination

FUNCTIONS = (
    op1_curve_packing, op2_ngram_jaccard_join, op3_pii, op4_secret_scan, op5_html_extraction, op6_token_counts, op7_repeated_bytes, op8_token_files, op9_quality_rules, op10_decontamination,
)


def queries() -> dict:
    import corpus_pipeline

    found = {f.__name__: f for f in FUNCTIONS}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return oracles.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
