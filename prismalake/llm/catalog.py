"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, chat, embeddings, langid, media, minhash, neighbours, packing, pieces_sa, ppm, rans, spelling, suffix


def queries() -> dict:
    return {
        "op1_media_copies": media.op1_media_copies,
        "op2_suffix_dedup": suffix.op2_suffix_dedup,
        "op3_rans_tokens": rans.op3_rans_tokens,
        "op4_sentencepiece": pieces_sa.op4_sentencepiece,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_ppm_scoring": ppm.op6_ppm_scoring,
        "op7_embedding_near_dedup": embeddings.op7_embedding_near_dedup,
        "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
        "op9_language_id": langid.op9_language_id,
        "op10_chat_tool_calls": chat.op10_chat_tool_calls,
        "op11_nearest_neighbours": neighbours.op11_nearest_neighbours,
        "op12_cross_tokenizer_alignment": alignment.op12_cross_tokenizer_alignment,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_tool_calls": chat.OP10_SQL}
