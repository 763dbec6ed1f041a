"""op10_quality_classifier: a quality score for every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import quality_classifier as C
from .common import read
from .registry import register


@register("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = C.train(docs, read(spark, sf_dir, "labels"))
    return C.scores(docs, model).select(
        "doc_id", F.expr(f"{C.FOLDS} = 0").alias("held_out"), "score",
        (F.col("score") >= C.GOOD).cast("int").alias("predicted"))
