"""The queries of this subpackage and the SQL that gives their rows."""

from __future__ import annotations

from lodemine.llm import ann, bpe, chat, codes, html, langid, lexical, mixing, neardup, pii, secrets, topk, toxicity

QUERIES = {
    "op1_html": html.op1_html,
    "op2_topk": topk.op2_topk,
    "op3_secrets": secrets.op3_secrets,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ann": ann.op6_ann,
    "op7_langid": langid.op7_langid,
    "op8_neardup": neardup.op8_neardup,
    "op9_bpe": bpe.op9_bpe,
    "op10_chat": chat.op10_chat,
    "op11_lexical": lexical.op11_lexical,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_pii": pii.op13_pii,
}
ORACLES = {
    "op1_html": html.OP1_SQL,
    "op2_topk": topk.OP2_SQL,
    "op3_secrets": secrets.OP3_SQL,
    "op10_chat": chat.OP10_SQL,
    "op11_lexical": lexical.OP11_SQL,
    "op12_vector_codes": codes.OP12_SQL,
    "op13_pii": pii.OP13_SQL,
}
