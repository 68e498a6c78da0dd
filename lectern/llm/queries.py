"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from lectern.llm import decontamination, html_text, line_dedup, mixing, near_dedup, neighbours, periodic_runs, personal_data, prefix_tree, quality, substring_dedup, token_counts, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality": quality.op3_quality,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_personal_data": personal_data.op8_personal_data,
    "personal_data_base": personal_data.personal_data_base,
    "op9_html_text": html_text.op9_html_text,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_prefix_tree": prefix_tree.op11_prefix_tree,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLE = {
    "op1_mixing": mixing.OP1_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "personal_data_base": personal_data.BASE_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_prefix_tree": prefix_tree.OP11_SQL,
    "op12_periodic_runs": periodic_runs.OP12_SQL,
}
