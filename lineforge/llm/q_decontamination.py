"""op6_decontamination: documents that hold benchmark items, as they stand or with other values."""

from __future__ import annotations

from . import decontamination as D
from .common import read
from .registry import register


@register("op6_decontamination")
def op6_decontamination(spark, sf_dir):
    found = D.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_windows", "share", "n_slots", "reparameterised")
