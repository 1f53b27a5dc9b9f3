"""Registry of this folder's queries and the SQL for those that SQL can express."""

from __future__ import annotations

from . import binpack, leakage, mixing, oracle, pii, quality, splitting, token_budget


def queries() -> dict:
    return {
        "p1_document_tokens": token_budget.p1_document_tokens,
        "p1_token_budget": token_budget.p1_token_budget,
        "p2_found": quality.p2_found,
        "p2_statistics": quality.p2_statistics,
        "p3_found": leakage.p3_found,
        "p3_leaks": leakage.p3_leaks,
        "p3_item_report": leakage.p3_item_report,
        "p4_found": splitting.p4_found,
        "p4_pieces": splitting.p4_pieces,
        "p5_sequences": binpack.p5_sequences,
        "p5_fill": binpack.p5_fill,
        "p6_mixture": mixing.p6_mixture,
        "p6_shares": mixing.p6_shares,
        "p7_found": pii.p7_found,
        "p7_redacted": pii.p7_redacted,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
