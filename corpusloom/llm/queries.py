"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpusloom.llm import sql
from corpusloom.llm.jaccard_join import op10_jaccard_join
from corpusloom.llm.lp_packing import op9_lp_packing
from corpusloom.llm.mixing import op6_mixing
from corpusloom.llm.packed_ids import op8_packed_ids
from corpusloom.llm.pitman_yor import op4_pitman_yor
from corpusloom.llm.quality_rules import op1_quality_rules
from corpusloom.llm.quote_links import op2_quote_links
from corpusloom.llm.rule_classifier import op5_quality_classifier
from corpusloom.llm.topk_search import op3_topk_search
from corpusloom.llm.toxic_segments import op7_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quote_links": op2_quote_links,
    "op3_topk_search": op3_topk_search,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_packed_ids": op8_packed_ids,
    "op9_lp_packing": op9_lp_packing,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLES = {
    "op1_quality_rules": sql.OP1,
    "op2_quote_links": sql.OP2,
    "op3_topk_search": sql.OP3,
}
