"""op9_suffix_dedup: bytes of documents that repeat 50 bytes of a document with a smaller doc_id."""

from __future__ import annotations

import hashlib

from . import suffix_dedup as S
from .common import read
from .registry import register

ROW = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest(data: bytes, left: bytes, n_spans: int) -> tuple:
    return len(data), len(data) - len(left), n_spans, hashlib.sha256(left).hexdigest()


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    return S.dedup(read(spark, sf_dir, "documents"), ROW, digest)
