"""The registered queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from razao.llm.chat import OP10_SQL, op10_chat
from razao.llm.decontaminate import op9_decontamination
from razao.llm.importance import OP13_SQL, op13_importance
from razao.llm.mixing import OP8_SQL, op8_mixing
from razao.llm.near_dup import op2_near_duplicates
from razao.llm.pii import op7_pii
from razao.llm.ppm import op5_ppm
from razao.llm.quality import op3_quality
from razao.llm.quality_rules import op6_quality_rules
from razao.llm.sharding import op1_sharding
from razao.llm.spelling import OP11_SQL, op11_spelling
from razao.llm.substring_dedup import op4_substring_dedup
from razao.llm.token_counts import op12_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_near_duplicates, op3_quality, op4_substring_dedup, op5_ppm,
        op6_quality_rules, op7_pii, op8_mixing, op9_decontamination, op10_chat,
        op11_spelling, op12_token_counts, op13_importance,
    )
}
ORACLES = {"op8_mixing": OP8_SQL, "op10_chat": OP10_SQL, "op11_spelling": OP11_SQL, "op13_importance": OP13_SQL}
