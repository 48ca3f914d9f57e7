"""Queries of the training-data operators and, where SQL can say them, the SQL."""

from __future__ import annotations

from undula.llm import boosting, chat, decontam, lattice, packing, pii, rules, simhash, store, wrappers


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_chat": chat.op2_chat,
        "op3_html": wrappers.op3_html,
        "op4_pii": pii.op4_pii,
        "op5_lattice": lattice.op5_lattice,
        "op6_decontamination": decontam.op6_decontamination,
        "op7_simhash": simhash.op7_simhash,
        "op8_quality_rules": rules.op8_quality_rules,
        "op9_quality": boosting.op9_quality,
        "op10_store": store.op10_store,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.ORACLE, "op6_decontamination": decontam.ORACLE}
