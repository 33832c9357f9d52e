"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import alignment, chat, decontaminate, embeddings, html, lexical, licenses, line_dedup, ngram_join, packing, quality, secrets, toxicity


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_quality": quality.op6_quality,
        "op7_packing": packing.op7_packing,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_embedding_near_dedup": embeddings.op9_embedding_near_dedup,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_html_extraction": html.op11_html_extraction,
        "op12_ranked_lexical_search": lexical.op12_ranked_lexical_search,
        "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.OP1_SQL, "op10_line_dedup": line_dedup.OP10_SQL, "op12_ranked_lexical_search": lexical.OP12_SQL}
