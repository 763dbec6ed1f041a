"""Helpers of the training-data operators: table reading, written tables, row maps over Arrow."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Words of a text: runs without ASCII white space, as in every contract of this package.
ASCII_SPACE = "\t\n\x0b\x0c\r "


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and return the re-read table.

    This cuts the lineage: later stages read files that every executor can
    reach, so a lost executor never repeats the work before this point.
    """
    path = os.path.join(scratch_path(df.sparkSession, "llm"), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint when a bounded count proves that it has at most ``max_rows`` rows.

    Beyond that the hint is left off and Spark joins by shuffle, with the
    same result.  Callers pass narrow frames of fixed-width columns, so that
    ``max_rows`` bounds the bytes as well.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def training_labels(labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id and quality of at most ``max_rows`` labelled documents, chosen by a hash of doc_id.

    Rows without a doc_id or quality and those of the held-out fold (crc32 of
    doc_id as text, modulo 5, is 0) never train.  Of several labels of a
    document the least counts.  A threshold on the hash thins the rows before
    the bound is applied, so no task sorts or sends more than about the bound.
    """
    rows = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
            .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def map_rows(df: DataFrame, columns: list[str], schema: str | T.StructType,
             rows_of: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Apply ``rows_of(*values) -> tuples`` to each row's ``columns``, in Arrow batches.

    Output batches hold at most a few thousand rows or some megabytes, so a
    worker's memory is bounded by one input batch and one output batch.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for values in zip(*(pieces(c) for c in batch.columns)):
                out.extend(rows_of(*values))
                if len(out) >= 4096:
                    yield as_batch(out, arrow)
                    out = []
        if out:
            yield as_batch(out, arrow)

    return df.select(*columns).mapInArrow(run, kind)


def pieces(column: pa.Array, step: int = 256) -> Iterator:
    """The Python values of an Arrow column, converted a few at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def to_arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def with_text(df: DataFrame, rewrite: Callable[[str], str]) -> DataFrame:
    """``df`` with its ``text`` rewritten per row and ``n_chars``, where present, recounted.

    All other columns pass through; a null text stays null.
    """
    names = df.columns
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = to_arrow(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else rewrite(t) for t in pieces(batch.column(at))]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, schema.field(at).type)
            if length is not None:
                was = batch.column(length).to_pylist()
                columns[length] = pa.array([n if t is None else len(t) for t, n in zip(texts, was)], schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.mapInArrow(run, df.schema)


def trim_memory() -> None:
    """Give back to the system what earlier tasks of this Python worker no longer use."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores before them until no column of ``df`` has one."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def no_nulls(text: str | None) -> str:
    return "" if text is None else text


def released(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df``, a written table, after its step's shuffle files have been let go.

    Spark drops shuffle files when the driver collects the objects that own
    them; asking for it between steps keeps one step's files on the
    executors' disks rather than all steps'.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return df
