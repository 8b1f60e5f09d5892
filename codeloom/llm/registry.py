"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_warc, op2_search, op3_sharding, op4_records, op5_packing, op6_lengths, op7_secrets, op8_quality, op9_minhash, op10_bpe, op11_divergence, op12_runs, op13_winnowing, oracles

QUERIES = {
    "op1_warc_derivatives": op1_warc.op1_warc_derivatives,
    "op2_block_max_wand": op2_search.op2_block_max_wand,
    "op3_minimax_shards": op3_sharding.op3_minimax_shards,
    "op4_token_records": op4_records.op4_token_records,
    "op5_pack_sequences": op5_packing.op5_pack_sequences,
    "op6_length_histogram": op6_lengths.op6_length_histogram,
    "op7_randomness_secrets": op7_secrets.op7_randomness_secrets,
    "op8_line_field_quality": op8_quality.op8_line_field_quality,
    "op9_circulant_minhash": op9_minhash.op9_circulant_minhash,
    "op10_forced_boundary_bpe": op10_bpe.op10_forced_boundary_bpe,
    "op11_source_divergence": op11_divergence.op11_source_divergence,
    "op12_periodic_runs": op12_runs.op12_periodic_runs,
    "op13_winnowing": op13_winnowing.op13_winnowing,
    "quality_base_counts": oracles.quality_base_counts,
    "secret_base_counts": oracles.secret_base_counts,
}
ORACLES: dict[str, str] = oracles.ORACLES
