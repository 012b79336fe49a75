"""The queries of this subpackage and their SQL."""

from . import bpe, chat_format, conversation_repair, decontaminate, line_dedup, mixing, near_dup, period_runs, pii, quality_rules, resample, toxicity, warc

_MODULES = {
    "op1_chat_format": chat_format,
    "op2_minhash_near_dup": near_dup,
    "op3_toxicity": toxicity,
    "op4_source_mix": mixing,
    "op5_warc": warc,
    "op6_line_dedup": line_dedup,
    "op7_pii": pii,
    "op8_decontaminate": decontaminate,
    "op9_importance_resampling": resample,
    "op10_quality_rules": quality_rules,
    "op11_period_runs": period_runs,
    "op12_conversation_repair": conversation_repair,
    "op13_bpe": bpe,
}
QUERIES = {name: m.query for name, m in _MODULES.items()}
SQL = {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
