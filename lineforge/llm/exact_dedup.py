"""Exact duplicates by an extendible-hash index whose files lie in the shared folder.

1. Every document gets a 64-bit key (``xxhash64``) and the SHA-256 of its
   normalised text; only these narrow rows are kept (*fingerprints*).
2. The *directory* starts as one bucket.  A bucket with more than ``CAPACITY``
   distinct fingerprints is split on the next leading bit of the key, and the
   directory doubles with it; a bucket that fits keeps its depth and is then
   named by several slots of the directory.
3. Where a fingerprint occurs once the text is unique and does not move (a
   bitmap of fixed size tells; beyond some hundred million repeated keys it
   lets unique texts through, which costs their shuffle and changes nothing).
   The others' texts meet by bucket, key **and bytes**: Spark's aggregation
   compares whole texts, after each task has merged its own copies, so a text
   that a third of all rows share sends one row per task.  Texts that differ
   under one key form the key's chain.
4. Owner tasks hold ranges of buckets: the chains are range-partitioned by
   bucket and key, sorted, and written as the *index*.  Documents look up the
   entry of their bucket, key and SHA-256.

Two different texts of equal key and equal SHA-256 would make the lookup
ambiguous; the run then stops with an error and merges nothing.

Results: of equal texts the row with the largest doc_id stays; rows without a
doc_id stay only where no row of the group has one; of rows equal in doc_id
and text exactly one stays.  A null text is empty, all empty texts are equal,
and an empty table has no rows.  Extra columns are ignored.  All steps are
DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: Distinct fingerprints in a bucket, about 5 MB of index rows.
CAPACITY = 1 << 16
#: Levels beyond those that evenly filled buckets need: keys are hashes, so buckets differ little.
SLACK = 4
#: Leading bits of a key in the bitmap of keys that occur twice: 16 MB, whatever the input.
BITMAP_BITS = 27
#: Slots of the directory that are broadcast (two numbers each).
BROADCAST_SLOTS = 1_000_000
#: Bits of one row of the bitmap, as ``bitmap_construct_agg`` makes them.
ROW_BITS = 32_768


def leading(key: str, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit key as a number."""
    return F.shiftrightunsigned(F.col(key), 64 - bits).cast("long") if bits else F.lit(0).cast("long")


def fingerprints(docs: DataFrame, text: Column) -> DataFrame:
    """uid (one per row), doc_id, h, sha; written, so that a uid stands for one row from here on."""
    return written(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64(text).alias("h"),
                               F.unhex(F.sha2(text, 256)).alias("sha")), "fingerprints")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory (slot, bucket, depth, n) over the keys ``h`` of ``entries``, and its global depth.

    A bucket is named by its first slot.  Counts per prefix of the deepest
    level are summed for every shallower level; a bucket is a prefix that
    fits while the prefix one bit shorter does not.
    """
    total = entries.count()
    deepest = min(40, max(0, math.ceil(math.log2(max(total, 1) / capacity)) + SLACK)) if total > capacity else 0
    finest = entries.groupBy(leading("h", deepest).alias("prefix")).agg(F.count("*").alias("n"))
    levels = finest.select("n", "prefix", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
    levels = levels.groupBy("depth", F.expr(f"shiftright(prefix, {deepest} - depth)").alias("prefix")).agg(F.sum("n").alias("n"))
    split = levels.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fits = (F.col("n") <= capacity) | (F.col("depth") == deepest)
    buckets = (levels.where(fits).withColumn("parent", F.expr("shiftright(prefix, 1)"))
               .join(split, ["depth", "parent"], "left_semi")
               .union(levels.where(fits & (F.col("depth") == 0)).withColumn("parent", F.lit(0).cast("long")).select("depth", "parent", "prefix", "n")))
    buckets = written(buckets.select("depth", "prefix", "n"), "buckets")
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    slots = buckets.select("depth", "n", F.expr(f"shiftleft(prefix, {depth} - depth)").alias("bucket")).select(
        F.explode(F.expr(f"sequence(bucket, bucket + shiftleft(1L, {depth} - depth) - 1)")).alias("slot"), "bucket", "depth", "n")
    return written(slots, "directory"), depth


def keys_met_twice(entries: DataFrame) -> DataFrame:
    """Rows (part, bits) of a bitmap of the leading key bits of fingerprints that occur more than once: 16 MB at most."""
    at = leading("h", BITMAP_BITS)
    return (entries.where("n > 1").groupBy(F.floor(at / ROW_BITS).alias("part"))
            .agg(F.bitmap_construct_agg(at % ROW_BITS).alias("bits")))


def maybe_met_twice(docs: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key ``h`` may be in the bitmap; a false positive moves one text for nothing."""
    at = leading("h", BITMAP_BITS)
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit div 8 + 1 AS INT), 1)")), 16, 10).cast("long")
    return (docs.withColumn("part", F.floor(at / ROW_BITS)).withColumn("bit", at % ROW_BITS)
            .join(F.broadcast(bitmap), "part").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).drop("part", "bit", "bits"))


def index(docs: DataFrame, text: Column, entries: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The index: bucket, h, chain (from 1), sha, group_size, keep_id, stays of every text that occurs more than once; written.

    ``stays`` is the uid of the row that stays.  The rows are complete here,
    so that the documents' lookup is a join of two shuffles, which Spark can
    split where one text holds a large share of all rows.
    """
    texts = maybe_met_twice(docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")), keys_met_twice(entries))
    placed = texts.withColumn("slot", leading("h", depth)).join(small(slots.select("slot", "bucket"), BROADCAST_SLOTS), "slot")
    same = (placed.groupBy("bucket", "h", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
            .where("group_size > 1").select("bucket", "h", F.unhex(F.sha2("text", 256)).alias("sha"), "group_size", "keep_id"))
    owned = same.repartitionByRange("bucket", "h")
    key = Window.partitionBy("bucket", "h").orderBy("sha")
    chain = owned.withColumn("chain", F.row_number().over(key)).withColumn("before", F.lag("sha").over(key))
    sha = F.when(F.col("before") == F.col("sha"),
                 F.raise_error(F.lit("exact_dedup: two texts of equal key and SHA-256")).cast("binary")).otherwise(F.col("sha"))
    chain = chain.select("bucket", "h", "chain", sha.alias("sha"), "group_size", "keep_id")
    return written(chain.join(entries.where("n > 1").select("h", "sha", "stays"), ["h", "sha"]), "index")


def groups(docs: DataFrame, normal: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``normal`` is the text that must be identical (default: ``text`` as it is).
    """
    text = F.coalesce(F.col("text") if normal is None else normal, F.lit(""))
    keys = fingerprints(docs, text)
    lowest = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    entries = written(keys.groupBy("h", "sha").agg(F.count("*").alias("n"), F.max_by("uid", lowest).alias("stays")), "entries")
    slots, depth = directory(entries, capacity)
    found = index(docs, text, entries, slots, depth)
    return keys.join(found.select("h", "sha", "group_size", "keep_id", "stays"), ["h", "sha"], "left").select(
        "doc_id", F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("uid") == F.coalesce("stays", "uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
