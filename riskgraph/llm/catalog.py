"""Queries of this folder, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from . import alignment, anchors, decontaminate, divergence, jaccard, mixing, quality, scoring, secrets, sharding, suffix, tokens, warc

QUERIES = {
    "op1_suffix": suffix.op1_suffix,
    "op2_sharding": sharding.op2_sharding,
    "op3_secrets": secrets.op3_secrets,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_scoring": scoring.op7_scoring,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_tokens": tokens.op9_tokens,
    "op10_warc": warc.op10_warc,
    "op11_anchors": anchors.op11_anchors,
    "op12_alignment": alignment.op12_alignment,
    "op13_divergence": divergence.op13_divergence,
}

ORACLE = {
    "op3_secrets": secrets.ORACLE_SECRETS,
    "op4_mixing": mixing.ORACLE_MIX.format(documents="documents"),
    "op10_warc": warc.ORACLE_WARC,
    "op13_divergence": divergence.ORACLE_DIVERGENCE,
}
