"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from quiver.llm import decontam, html_tree, imatch, lbl, near_vectors, ngram_join, packing, phrases, pii, quality, repair, reply_trees, shards

QUERIES = {"op1_ngram_join": ngram_join.op1_ngram_join,
           "op2_html_tree": html_tree.op2_html_tree,
           "op3_token_shards": shards.op3_token_shards,
           "op4_reply_trees": reply_trees.op4_reply_trees,
           "op5_packing": packing.op5_packing,
           "op6_pii": pii.op6_pii,
           "op7_quality": quality.op7_quality,
           "op8_lbl": lbl.op8_lbl,
           "op9_decontam": decontam.op9_decontam,
           "op10_imatch": imatch.op10_imatch,
           "op11_pstable_vectors": near_vectors.op11_pstable_vectors,
           "op12_itemset_phrases": phrases.op12_itemset_phrases,
           "op13_hirschberg_repair": repair.op13_hirschberg_repair}
ORACLE: dict[str, str] = {"op1_ngram_join": ngram_join.SQL, "op4_reply_trees": reply_trees.SQL, "op11_pstable_vectors": near_vectors.SQL, "op12_itemset_phrases": phrases.SQL}
