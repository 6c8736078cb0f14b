"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from . import chat, forced_bpe, html_text, near_dup, packing, phrases, pii, pivot_dup, quality, token_store, topk, turn_repair, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_chat": chat.op2_chat,
    "op3_near_duplicates": near_dup.op3_near_duplicates,
    "op4_top_k": topk.op4_top_k,
    "op5_token_store": token_store.op5_token_store,
    "op6_html_text": html_text.op6_html_text,
    "op7_forced_bpe": forced_bpe.op7_forced_bpe,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op10_pii": pii.op10_pii,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_pivot_duplicates": pivot_dup.op12_pivot_duplicates,
    "op13_phrases": phrases.op13_phrases,
}

SQL = {
    "op1_warc": warc.OP1_SQL,
    "op2_chat": chat.OP2_SQL,
    "op4_top_k": topk.OP4_SQL,
    "op9_quality": quality.OP9_SQL,
    "op11_turn_repair": turn_repair.OP11_SQL,
    "op12_pivot_duplicates": pivot_dup.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
