"""op13_conversation_repair: damaged conversations and the cheapest edits that mend their roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import conversation_repair as C
from .common import read
from .registry import register


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn``; null values are one blank, nulls in turn and conv_id stay."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce("text", blank)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"),
                                F.pmod(F.crc32(key), F.lit(20)).alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


@register("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    conversations = read(spark, sf_dir, "conversations")
    return C.audits(damaged(conversations), conversations.select("conv_id"))
