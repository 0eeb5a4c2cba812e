"""The queries of this subpackage, by name."""

from __future__ import annotations

from facematch.llm.additive import op8_additive
from facematch.llm.byte_pairs import op7_byte_pairs
from facematch.llm.language_id import op10_language_id
from facematch.llm.line_dedup import op1_line_dedup
from facematch.llm.packing import op3_best_fit_packing
from facematch.llm.quality_classifier import op2_quality_classifier
from facematch.llm.quality_rules import op4_quality_rules
from facematch.llm.repeats import op5_repeats
from facematch.llm.sharding import op6_sharding
from facematch.llm.simhash import op9_simhash

QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_quality_classifier, op3_best_fit_packing, op4_quality_rules, op5_repeats, op6_sharding, op7_byte_pairs, op8_additive, op9_simhash, op10_language_id)
}

#: SQL for DuckDB, where it can express a query.
ORACLES: dict[str, str] = {}
