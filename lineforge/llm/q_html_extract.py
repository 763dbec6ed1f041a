"""op4_html_extract: the main text of every page."""

from __future__ import annotations

from . import html_extract as H
from .common import read
from .registry import register


@register("op4_html_extract")
def op4_html_extract(spark, sf_dir):
    return H.extract(read(spark, sf_dir, "pages")).selectExpr("page_id", "url", "text", "CAST(char_length(text) AS BIGINT) AS n_chars")
