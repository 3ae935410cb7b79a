"""Queries of the subpackage: name -> builder, and DuckDB SQL where it can express them."""

from __future__ import annotations

from votepanel.llm import audit, bpe, chat, grading, licences, mixing, near_dup, outliers, packing, repeats, revisits, topk, whitening

QUERIES = {"op2_revisits": revisits.op2_revisits, "op7_quality_rules": outliers.op7_quality_rules, "op8_grades": grading.op8_grades, "op4_chat": chat.op4_chat, "op6_top_k": topk.op6_top_k, "op1_licences": licences.op1_licences, "op5_mix": mixing.op5_mix, "op3_near_dup": near_dup.op3_near_dup, "op9_byte_bpe": bpe.op9_byte_bpe, "op10_repeats": repeats.op10_repeats, "op11_filter_audit": audit.op11_filter_audit, "op12_packing": packing.op12_packing, "op13_whitening": whitening.op13_whitening}
ORACLES: dict[str, str] = {"op1_licences": licences.ORACLE, "op2_revisits": revisits.ORACLE, "op5_mix": mixing.ORACLE, "op4_chat": chat.ORACLE, "op6_top_k": topk.ORACLE, "op11_filter_audit": audit.ORACLE}
