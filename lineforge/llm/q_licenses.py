"""op7_licenses: license notices in every document."""

from __future__ import annotations

from . import licenses as L
from .common import read
from .registry import register


@register("op7_licenses")
def op7_licenses(spark, sf_dir):
    return L.scan(read(spark, sf_dir, "documents")).select("doc_id", "license", "share", "place")
