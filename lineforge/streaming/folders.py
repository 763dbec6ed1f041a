"""Watched-folder gating as joins of listings: marker files and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def marker_gate(data: DataFrame, markers: DataFrame, name: str = "name", marker: str = "marker") -> DataFrame:
    """Decide each marker: process / missing_data / unsupported / invalid_marker.

    A data file is ready only when ``<name>.done`` exists; a marker without a
    data file, for an unsupported type, or not ending in ``.done`` is not
    processed.
    """
    m = markers.select(F.col(marker).alias("marker"))
    m = m.withColumn("data_name", N.data_name_of_marker("marker"))
    present = data.select(F.col(name).alias("data_name")).distinct().withColumn("_present", F.lit(True))
    j = m.join(present, "data_name", "left")
    invalid = (F.col("data_name") == F.col("marker")) | (F.col("data_name") == "")
    action = F.when(invalid, F.lit("invalid_marker")) \
        .when(F.col("_present").isNull(), F.lit("missing_data")) \
        .when(~N.supported_extension("data_name"), F.lit("unsupported")) \
        .otherwise(F.lit("process"))
    return j.select("marker", "data_name", action.alias("action"))


def stability_check(first: DataFrame, second: DataFrame, key: str = "path") -> DataFrame:
    """Files whose size and modification time did not change between two listings."""
    a = first.select(key, F.col("length").alias("_l1"), F.col("modification_time").alias("_t1"))
    b = second.select(key, F.col("length").alias("_l2"), F.col("modification_time").alias("_t2"))
    j = a.join(b, key)
    return j.select(key, ((F.col("_l1") == F.col("_l2")) & (F.col("_t1") == F.col("_t2"))).alias("stable"))
