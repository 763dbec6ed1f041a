"""op3_packing: all documents packed into windows of 4096 tokens."""

from __future__ import annotations

import public_tokenizers

from . import packing as P
from .common import read
from .registry import register

VOCABULARY = "word_bpe_49k.json"


def digest(packed):
    return packed.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset",
                             "cut_before", "cut_after")


@register("op3_packing")
def op3_packing(spark, sf_dir):
    return digest(P.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))
