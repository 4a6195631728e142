"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, factorization, html_text, importance, mixing, periodic, quality_rules, simhash, suffix_dedup, surrogates, token_counts, token_store, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_warc": warc.op3_warc,
    "op4_pii_surrogates": surrogates.op4_pii_surrogates,
    "op5_simhash": simhash.op5_simhash,
    "op6_token_store": token_store.op6_token_store,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_html_text": html_text.op10_html_text,
    "op11_quality_classifier": factorization.op11_quality_classifier,
    "op12_importance": importance.op12_importance,
    "op13_periodic_runs": periodic.op13_periodic_runs,
    "quality_rules_lenient": quality_rules.quality_rules_lenient,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = quality_rules.ORACLE_SQL | warc.ORACLE_SQL | decontamination.ORACLE_SQL | importance.ORACLE_SQL
