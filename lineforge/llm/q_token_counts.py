"""op2_token_counts: tokens of every document under a unigram model."""

from __future__ import annotations

import public_tokenizers

from . import token_counts as K
from .common import read
from .registry import register

VOCABULARY = "piece_bpe_32k.model"


@register("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    return K.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
