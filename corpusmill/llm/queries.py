"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from corpusmill.llm import (
    duplicate_spans,
    host_reputation,
    pfair_mix,
    piece_merging,
    simhash_dedup,
    snapshot_collapse,
    spelling_variants,
    string_tiling,
    subspace_join,
    template_extraction,
    token_blocks,
    toxic_neighbours,
    vector_whitening,
)

QUERIES = {
    "op1_host_reputation": host_reputation.op1_host_reputation,
    "op2_pfair_mix": pfair_mix.op2_pfair_mix,
    "op3_token_blocks": token_blocks.op3_token_blocks,
    "op4_string_tiling": string_tiling.op4_string_tiling,
    "op5_snapshot_collapse": snapshot_collapse.op5_snapshot_collapse,
    "op6_duplicate_spans": duplicate_spans.op6_duplicate_spans,
    "op7_subspace_join": subspace_join.op7_subspace_join,
    "op8_template_extraction": template_extraction.op8_template_extraction,
    "op9_toxic_neighbours": toxic_neighbours.op9_toxic_neighbours,
    "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
    "op11_vector_whitening": vector_whitening.op11_vector_whitening,
    "op12_piece_merging": piece_merging.op12_piece_merging,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}

ORACLE = {
    "op1_host_reputation": host_reputation.SQL,
    "op2_pfair_mix": pfair_mix.SQL,
    "op5_snapshot_collapse": snapshot_collapse.SQL,
}
