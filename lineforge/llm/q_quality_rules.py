"""op5_quality_rules: statistics of every document, the base rule and the learned verdict."""

from __future__ import annotations

from . import quality_rules as Q
from .common import read, written
from .registry import register


@register("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    # statistics are a few numbers a row: written once, then used to learn and to judge
    stats = written(Q.document_stats(read(spark, sf_dir, "documents")), "stats")
    rules = Q.learn_rules(stats, read(spark, sf_dir, "labels"))
    failed = Q.base_failed()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & Q.verdict(rules)).alias("kept"))
