"""The queries of this subpackage and their SQL."""

from . import bpe, compression, exact_dedup, language, minhash, packing, quality, secrets, sharding, substring, suffixes, topk, trie

QUERIES = {
    "op1_kd_sharding": sharding.op1_kd_sharding,
    "op2_chunk_reuse": bpe.op2_chunk_reuse,
    "op3_adaptive_quality": quality.op3_adaptive_quality,
    "op4_difference_cover": substring.op4_difference_cover,
    "op5_suffix_family": suffixes.op5_suffix_family,
    "op6_linear_grouping": packing.op6_linear_grouping,
    "op7_coordinate_join": minhash.op7_coordinate_join,
    "op8_credential_linking": secrets.op8_credential_linking,
    "op9_unigram_language": language.op9_unigram_language,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_segment_means": compression.op11_segment_means,
    "op12_owned_chains": trie.op12_owned_chains,
    "op13_uniform_threshold": topk.op13_uniform_threshold,
}
ORACLES = {
    "op3_adaptive_quality": quality.OP3_SQL, "op4_difference_cover": substring.OP4_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_segment_means": compression.OP11_SQL, "op12_owned_chains": trie.OP12_SQL, "op13_uniform_threshold": topk.OP13_SQL,
}
