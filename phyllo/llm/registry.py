"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from phyllo.llm import bpe, imatch, line_dedup, merkle, mixing, pii, quality, quality_rules, repeats, simhash, token_tree, vector_codes, warc

QUERIES = {
    "op1_imatch_fingerprints": imatch.op1_imatch_fingerprints,
    "op2_edit_token_counts": token_tree.op2_edit_token_counts,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_pareto_mixing": mixing.op8_pareto_mixing,
    "op9_warc_salvage": warc.op9_warc_salvage,
    "op10_feistel_pii": pii.op10_feistel_pii,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_repeated_passages": repeats.op13_repeated_passages,
    "warc_damaged": warc.warc_damaged,
}
ORACLE_SQL = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op8_pareto_mixing": mixing.OP8_SQL,
    "op9_warc_salvage": warc.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_repeated_passages": repeats.OP13_SQL,
    "warc_damaged": warc.DAMAGED_SQL,
}
