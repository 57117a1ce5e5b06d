"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import audit, bpe, chat, jaccard, langid, lloyd, mixing, neighbours, pii, quality, runindex, secrets, warc

OPERATORS = [chat.op1_chat_format, secrets.op2_secret_scan, pii.op3_pii, warc.op4_warc, jaccard.op5_jaccard_join, mixing.op6_mix_sources, bpe.op7_bpe_codec, quality.op8_quality_rules, langid.op9_language_id, neighbours.op10_nearest, audit.op11_filter_audit, runindex.op12_suffix_dedup, lloyd.op13_centroid_clusters]
ORACLES: dict[str, str] = {**mixing.ORACLE, **quality.ORACLE, **audit.ORACLE, **lloyd.ORACLE}


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict:
    return dict(ORACLES)
