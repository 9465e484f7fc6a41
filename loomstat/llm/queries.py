"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, byte_bpe, chat, collocations, lexical, media, mixing, near_dup, packing, sharding, token_files, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_token_output": token_files.op4_token_output,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_chat_format": chat.op6_chat_format,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_media": media.op8_media,
    "op9_best_fit": packing.op9_best_fit,
    "op10_sharding": sharding.op10_sharding,
    "op11_collocations": collocations.op11_collocations,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_ranked_search": lexical.op13_ranked_search,
}

ORACLES = {
    "op3_near_dup": near_dup.OP3_SQL,
    "op5_url_filters": url_filter.OP5_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_ranked_search": lexical.OP13_SQL,
}
