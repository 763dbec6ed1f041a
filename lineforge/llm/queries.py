"""All queries of this package, registered on import."""

from __future__ import annotations

from . import (q_collocations, q_conversation_repair, q_decontamination, q_exact_dedup, q_html_extract, q_jaccard_join, q_licenses, q_packing, q_pii, q_quality_classifier, q_quality_rules, q_suffix_dedup,  # noqa: F401
               q_token_counts)
from .registry import ORACLE, QUERIES  # noqa: F401
