"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from . import bpe, chat, ctw, mixing, neardup, packing, quality, sharding, topk, toxicity, whitening, winnow


def queries() -> dict:
    return {
        "op1_ctw": ctw.query,
        "op2_sharding": sharding.query,
        "op3_packing": packing.query,
        "op4_neardup": neardup.query,
        "op5_quality": quality.query,
        "op7_toxicity": toxicity.query,
        "op6_chat": chat.query,
        "op8_winnow": winnow.query,
        "op9_bpe": bpe.query,
        "op10_topk": topk.query,
        "op11_whitening": whitening.query,
        "op12_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_neardup": neardup.SQL, "op6_chat": chat.SQL, "op10_topk": topk.SQL, "op12_mixing": mixing.SQL}
