"""The registered queries of the llm operators and their DuckDB SQL."""

from __future__ import annotations

from . import ann, chat, decontamination, html, licenses, mixing, near, quality, substrings, toxicity


def queries() -> dict:
    return {
        "op1_chat": chat.op1_chat,
        "op2_html": html.op2_html,
        "op3_mixing": mixing.op3_mixing,
        "op4_substrings": substrings.op4_substrings,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_licenses": licenses.op6_licenses,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_quality": quality.op8_quality,
        "op9_ann": ann.op9_ann,
        "op10_near": near.op10_near,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": chat.OP1_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op4_substrings": substrings.OP4_SQL.format(docs="documents"),
        "op6_licenses": licenses.OP6_SQL,
        "op7_decontamination": decontamination.OP7_SQL,
        "op10_near": near.OP10_SQL,
    }
