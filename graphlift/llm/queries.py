"""Registered queries of this subpackage: name to function of (spark, sf_dir); SQL where SQL can express one."""

from __future__ import annotations

from . import bpe, chat, langid, licenses, lm, merkle, mixing, mpegts, pathjoin, toxicity

QUERIES = {
    "op1_mpegts": mpegts.op1_mpegts,
    "op2_chat_format": chat.op2_chat_format,
    "op3_merkle": merkle.op3_merkle,
    "op4_bpe": bpe.op4_bpe,
    "op5_language_id": langid.op5_language_id,
    "op6_jaccard_join": pathjoin.op6_jaccard_join,
    "op7_lm_score": lm.op7_lm_score,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES: dict[str, str] = {"op2_chat_format": chat.OP2_SQL, "op6_jaccard_join": pathjoin.OP6_SQL, "op7_lm_score": lm.OP7_SQL}
