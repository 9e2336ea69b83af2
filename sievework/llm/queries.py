"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import pipeline
from .chat_format import OP8_SQL, op8_chat_format
from .fingerprints import op3_fingerprints
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .importance import OP11_SQL, op11_importance_resampling
from .language_id import op6_language_id
from .language_model import op12_language_model
from .mixing import op4_mix_sources
from .oracle import OP1_SQL, OP5_SQL, OP9_SQL
from .packing import op2_best_fit_packing
from .quality_rules import op5_quality_rules
from .secret_scan import op10_secret_scan
from .simhash import op7_simhash
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op9_suffix_dedup

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_simhash": op7_simhash,
    "op8_chat_format": op8_chat_format,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_language_model": op12_language_model,
    "op13_hard_negatives": op13_hard_negatives,
}
QUERIES["pipeline"] = pipeline.run

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op5_quality_rules": OP5_SQL,
    "op8_chat_format": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
