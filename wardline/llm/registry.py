"""The queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from wardline.llm import bpe, dedup, edits, licenses, lm, manifest, packing, quality, rans, repair, shards, simhash, toxicity

QUERIES = {
    "op1_hilbert_shards": shards.op1_hilbert_shards,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_bpe_speculate_verify": bpe.op3_bpe_speculate_verify,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_exact_dedup": dedup.op5_exact_dedup,
    "op6_simhash_byte_index": simhash.op6_simhash_byte_index,
    "op7_rans_token_files": rans.op7_rans_token_files,
    "op8_quality_cascade": quality.op8_quality_cascade,
    "op9_toxic_segments": toxicity.op9_toxic_segments,
    "op10_edit_aware_counts": edits.op10_edit_aware_counts,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_backoff_scores": lm.op13_backoff_scores,
}

ORACLE_SQL = {
    "op4_license_scan": licenses.op4_sql(),
    "op5_exact_dedup": dedup.OP5_SQL,
    "op8_quality_cascade": quality.OP8_SQL,
}
