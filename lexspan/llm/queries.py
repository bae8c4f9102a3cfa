"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from lexspan.llm.best_fit import op12_best_fit
from lexspan.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from lexspan.llm.merkle import OP13_SQL, op13_merkle_manifest
from lexspan.llm.ngram_join import op9_ngram_join
from lexspan.llm.packing import op10_packing
from lexspan.llm.pii import op8_pii
from lexspan.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from lexspan.llm.quality_grades import op6_quality_grades
from lexspan.llm.quality_rules import op1_quality_rules
from lexspan.llm.repeats import op2_repeats
from lexspan.llm.segmentation import OP3_DECODED_SQL, op3_decoded, op3_segmentation
from lexspan.llm.toxicity import op4_toxicity
from lexspan.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_repeats": op2_repeats,
    "op3_segmentation": op3_segmentation,
    "op3_decoded": op3_decoded,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_grades": op6_quality_grades,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_ngram_join": op9_ngram_join,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_best_fit": op12_best_fit,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL = {
    "op3_decoded": OP3_DECODED_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
