"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from policyframe.llm import decontaminate, html, lines, neighbours, pack, quality, simhash, substrings, toxicity, urls


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_quality": quality.op3_quality,
        "op4_neighbours": neighbours.op4_neighbours,
        "op5_substrings": substrings.op5_substrings,
        "op6_lines": lines.op6_lines,
        "op7_urls": urls.op7_urls,
        "op8_html": html.op8_html,
        "op9_simhash": simhash.op9_simhash,
        "op10_pack": pack.op10_pack,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.OP1_SQL, "op5_substrings": substrings.OP5_SQL, "op6_lines": lines.OP6_SQL, "op7_urls": urls.OP7_SQL}
