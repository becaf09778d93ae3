"""Queries and oracles of the training-data operators."""

from __future__ import annotations

from tideline.llm import op01_ann, op02_secrets, op03_fingerprints, op04_html, op05_mixing, op06_sharding, op07_quality, op08_pii, op09_jaccard, op10_packing


def queries():
    return {
        "op1_ann": op01_ann.query,
        "op2_secrets": op02_secrets.query,
        "op3_fingerprints": op03_fingerprints.query,
        "op4_html": op04_html.query,
        "op5_mixing": op05_mixing.query,
        "op6_sharding": op06_sharding.query,
        "op7_quality": op07_quality.query,
        "op8_pii": op08_pii.query,
        "op9_jaccard": op09_jaccard.query,
        "op9_near_copies": op09_jaccard.near_query,
        "op10_packing": op10_packing.query,
    }


def oracle_sql():
    return {"op2_secrets": op02_secrets.ORACLE, "op5_mixing": op05_mixing.ORACLE, "op9_jaccard": op09_jaccard.ORACLE, "op9_near_copies": op09_jaccard.NEAR_ORACLE}
