"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import html_text, lines, media, merkle, mixing, packing, sharding, simhash, sketches, token_files, toxicity, trie, windows


def queries() -> dict:
    return {
        "op1_invertible_sketch": sketches.op1_invertible_sketch,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_sampled_splitters": sharding.op3_sampled_splitters,
        "op4_simhash_pivots": simhash.op4_simhash_pivots,
        "op5_pareto_mixing": mixing.op5_pareto_mixing,
        "op6_token_files": token_files.op6_token_files,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_html_crf": html_text.op8_html_crf,
        "op9_toxicity_segments": toxicity.op9_toxicity_segments,
        "op10_media_columns": media.op10_media_columns,
        "op11_merkle_butterfly": merkle.op11_merkle_butterfly,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_repeated_windows": windows.op13_repeated_windows,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_pareto_mixing": mixing.OP5_SQL, "op11_merkle_butterfly": merkle.OP11_SQL, "op12_prefix_trie": trie.OP12_SQL}
