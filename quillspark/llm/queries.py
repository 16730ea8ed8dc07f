"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, exact_topk, filter_audit, language, licenses, lloyd, mixing, near_dedup, packing, pii, secret_scan, token_counts, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_language_id": language.op4_language_id,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_exact_topk": exact_topk.op10_exact_topk,
    "op11_centroid_clustering": lloyd.op11_centroid_clustering,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL = {**mixing.SQL, **near_dedup.SQL, **exact_dedup.SQL, **exact_topk.SQL, **lloyd.SQL, **filter_audit.SQL}
