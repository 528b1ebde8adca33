"""The driver's queries over this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, filter_audit, jaccard_join, language_id, licenses, line_dedup, lm_scores, packing, periodic_runs, quality, secrets, token_counts, warc

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_warc": warc.op8_warc,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_lm_scoring": lm_scores.op12_lm_scoring,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL = {
    "op1_ngram_jaccard_join": jaccard_join.OP1_SQL,
    "op2_secret_scan": secrets.OP2_SQL,
    "op3_quality_rules": quality.OP3_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
}
