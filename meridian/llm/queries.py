"""The registered queries of the training-data operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from meridian.llm.ann import op3_ann
from meridian.llm.importance import op10_quality_classifier
from meridian.llm.language_id import op1_language_id
from meridian.llm.licenses import op7_licenses
from meridian.llm.mixing import OP8_SQL, op8_mixing
from meridian.llm.pieces import op2_pieces
from meridian.llm.pii import op9_pii
from meridian.llm.quality_rules import OP5_SQL, op5_quality_rules
from meridian.llm.simhash import op4_simhash
from meridian.llm.substring_dedup import OP6_SQL, op6_substring_dedup

QUERIES = {
    "op7_licenses": op7_licenses,
    "op9_pii": op9_pii,
    "op2_pieces": op2_pieces,
    "op1_language_id": op1_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op3_ann": op3_ann,
    "op6_substring_dedup": op6_substring_dedup,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op8_mixing": op8_mixing,
}
ORACLES = {
    "op5_quality_rules": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_mixing": OP8_SQL,
}
