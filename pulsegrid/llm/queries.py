"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import ann, bpe, html_text, jaccard, mixing, order, packing, quality, secrets, substrings, topk, trie

QUERIES = {
    "op1_additive_quantisation": ann.op1_additive_quantisation,
    "op2_best_two_fit": packing.op2_best_two_fit,
    "op3_training_order": order.op3_training_order,
    "op4_subword_quality": quality.op4_subword_quality,
    "op5_recurrent_block_labeller": html_text.op5_recurrent_block_labeller,
    "op6_parity_sketch_join": jaccard.op6_parity_sketch_join,
    "op7_kd_tree_top_k": topk.op7_kd_tree_top_k,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_fm_index_dedup": substrings.op9_fm_index_dedup,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_systematic_mixing": mixing.op12_systematic_mixing,
}
ORACLE_SQL = {
    "op9_fm_index_dedup": substrings.OP9_SQL,
    "op6_parity_sketch_join": jaccard.OP6_SQL,
    "op7_kd_tree_top_k": topk.OP7_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op12_systematic_mixing": mixing.OP12_SQL,
}
