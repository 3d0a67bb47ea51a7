"""The registered queries of this subpackage, and the SQL of those that have it."""

from __future__ import annotations

from ledgerline.llm import (
    compact_windows,
    decontamination,
    jaccard_join,
    line_dedup,
    lm_scoring,
    packing,
    period_runs,
    pii,
    quality_rules,
    source_divergence,
    suffix_dedup,
    toxicity,
    url_filters,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_compact_windows": compact_windows.op5_compact_windows,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_pii": pii.op7_pii,
    "op8_packing": packing.op8_packing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_period_runs": period_runs.op11_period_runs,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}

ORACLE_SQL = {
    "op9_quality_rules": quality_rules.SQL,
    "op11_period_runs": period_runs.SQL,
    "op12_line_dedup": line_dedup.SQL,
    "op13_source_divergence": source_divergence.SQL,
}
