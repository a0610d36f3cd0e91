"""The registered query of each corpus operator, and the SQL it is checked against where SQL can express it."""

from __future__ import annotations

from .decontaminate import op3_decontamination
from .katz import op1_katz_scores
from .packing import op9_best_fit_packing
from .pii import op10_pii_bootstrap
from .quality import ORACLE as QUALITY_SQL
from .quality import op8_quality_rules
from .secrets import op2_secret_scan
from .simhash import op6_simhash_near_dedup
from .substrings import op7_suffix_dedup
from .tokenfile import op4_token_files
from .wordpiece import op5_token_counts


def queries():
    return {f.__name__: f for f in (op1_katz_scores, op2_secret_scan, op3_decontamination, op4_token_files, op5_token_counts, op6_simhash_near_dedup, op7_suffix_dedup, op8_quality_rules, op9_best_fit_packing, op10_pii_bootstrap)}


def oracle_sql():
    return {"op8_quality_rules": QUALITY_SQL}
