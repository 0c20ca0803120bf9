"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from .classifier import op8_quality_classifier
from .collocations import OP12_SQL, op12_phrase_collocations
from .counts import op10_token_counts
from .decontamination import OP7_SQL, op7_decontamination
from .divergence import OP11_SQL, op11_source_divergence
from .mixing import OP5_SQL, op5_mixing
from .neardup import OP6_SQL, op6_near_duplicates
from .quality_rules import OP3_SQL, op3_quality_rules
from .secrets import op2_secret_scan
from .setjoin import OP13_SQL, op13_jaccard_join
from .sharding import OP1_SQL, op1_sharding
from .substrings import op4_substring_dedup
from .training_order import op9_training_order

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontamination": op7_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_training_order": op9_training_order,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_jaccard_join": op13_jaccard_join,
}
SQL: dict[str, str] = {
    "op1_sharding": OP1_SQL,
    "op3_quality_rules": OP3_SQL,
    "op5_mixing": OP5_SQL,
    "op6_near_duplicates": OP6_SQL,
    "op7_decontamination": OP7_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_jaccard_join": OP13_SQL,
}
