"""Continuous pick-up of deliveries with Structured Streaming.

``delivery_stream`` reads new files of a folder as a plain file stream.
``watch_folder`` follows deliveries with markers through a source of its own
(:mod:`.arrivals`); ``foreachBatch`` runs the batch pipeline on each
micro-batch.  Checkpoint and admission records tell which deliveries were
taken, so a restarted query neither skips nor repeats one;
``trigger(availableNow=True)`` processes what is already there and stops
(start-up backfill), ``processingTime`` keeps polling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import store
from ..operators.common import bounded_broadcast, cut_lineage
from ..session import scratch_path, scratch_scope
from ..sources import files as FS
from .arrivals import Arrivals
from .folders import marker_gate

DEFAULT_MAX_FILES = 5
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
DEFAULT_POLL = "5 seconds"
#: Seconds between the two looks at a waiting file.
STABILITY_DELAY = 2.0


def delivery_stream(spark: SparkSession, path: str, fmt: str = "binaryFile", schema=None,
                    max_files: int = DEFAULT_MAX_FILES, glob: str | None = None) -> DataFrame:
    """Streaming DataFrame of new files under ``path`` (``max_files`` per trigger)."""
    r = spark.readStream.format(fmt).option("maxFilesPerTrigger", max_files)
    if schema is None and fmt == "binaryFile":
        schema = BINARY_FILE_SCHEMA
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def guard_in_flight(stream: DataFrame, key: str = "file_checksum", arrived_at: str = "arrived_at", horizon: str = "1 hour") -> DataFrame:
    """Each delivery once even when it shows up again within ``horizon`` of its first arrival.

    The state holds a checksum until the watermark on ``arrived_at`` has
    passed it by the horizon, so it is as large as the deliveries of that
    time.  What comes later than that meets the anti-join against COMPLETED
    manifests in the batch function.
    """
    return stream.withWatermark(arrived_at, horizon).dropDuplicatesWithinWatermark([key])


def run_stream(stream: DataFrame, process: Callable[[DataFrame, int], None], name: str,
               checkpoint: str | None = None, available_now: bool = True,
               poll: str = DEFAULT_POLL):
    """Start ``process`` over the stream with a reliable checkpoint folder.

    ``available_now=True`` backfills everything present and returns after the
    query stops; otherwise the started query is returned (polling ``poll``).
    """
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"streams/{name}")
    w = stream.writeStream.queryName(name).option("checkpointLocation", ckpt).foreachBatch(process)
    if available_now:
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return w.trigger(processingTime=poll).start()


def append_to(path: str, partition_by: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink writing each micro-batch to ``path/epoch_id=<n>``.

    The epoch folder is overwritten, so a batch replayed after a failure
    replaces its own output (exactly-once at the folder level).
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(f"{path}/epoch_id={epoch}")
    return sink


def arrivals(spark: SparkSession, upload_dir: str, log: str, max_files: int = DEFAULT_MAX_FILES,
             stability_delay: float = STABILITY_DELAY) -> DataFrame:
    """Streaming rows of marked deliveries that stood still, oldest marker first, ``max_files`` per micro-batch (see :mod:`.arrivals`)."""
    spark.dataSource.register(Arrivals)
    return spark.readStream.format(Arrivals.name()).option("path", upload_dir).option("log", log) \
        .option("maxFiles", str(max_files)).option("stabilityDelay", str(stability_delay)).load()


def watch_folder(spark: SparkSession, upload_dir: str, rules: DataFrame, state_dir: str,
                 tables_path: str | None = None, available_now: bool = True,
                 max_files: int = DEFAULT_MAX_FILES, poll: str = DEFAULT_POLL, stability_delay: float = STABILITY_DELAY):
    """Watched-folder pick-up: every new ``<name>.done`` marker releases ``<name>``.

    The stream's source is the folder's listing: a marker that was written
    anew is a new delivery even under old names, a file that still grows is
    held back, and a micro-batch has at most ``max_files`` deliveries.  The
    batch function loads extension-less files with :func:`ingest_files` and
    ``.zip`` files with ``ingest_archives`` (any other extension fails as
    unsupported), deduplicates against the stored manifest under
    ``state_dir/manifest`` and merges the run's rows into it
    (``operators.store.read_stored`` reads them).  Per-file results and issues
    go to ``state_dir/results`` and ``state_dir/issues``, a folder per
    micro-batch.  Files are not moved: their state is the manifest status
    (see ``lifecycle_state``).

    ``available_now`` works off what is there, ``max_files`` at a time, and
    returns the last query; otherwise the started query is returned.
    """
    state = _Watch(spark, rules, state_dir, tables_path)
    name = f"watch_{hashlib.sha256(upload_dir.encode()).hexdigest()[:12]}"
    while True:
        stream = arrivals(spark, upload_dir, f"{state_dir}/arrivals", max_files, stability_delay)
        query = run_stream(stream, state.process, name=name, checkpoint=f"{state_dir}/_checkpoint", available_now=available_now, poll=poll)
        if not available_now or not sum(p["numInputRows"] for p in query.recentProgress):
            return query


class _Watch:
    """The batch function of a watched folder."""

    def __init__(self, spark: SparkSession, rules: DataFrame, state_dir: str, tables_path: str | None) -> None:
        self.rules, self.state_dir = rules, state_dir
        self.tables_path = tables_path or f"{state_dir}/tables"
        self.manifest_path = f"{state_dir}/manifest"

    def known(self, spark: SparkSession, keys: DataFrame | None, own: DataFrame | None) -> DataFrame | None:
        """Manifest rows that may hold the given checksums, without this micro-batch's own from an earlier attempt."""
        rows = store.read_stored(spark, self.manifest_path, keys)
        return rows if rows is None or own is None else rows.join(own.select("batch_id"), "batch_id", "left_anti")

    def process(self, batch: DataFrame, epoch: int) -> None:
        with scratch_scope(batch.sparkSession):  # a watch that runs for months leaves no scratch
            self.load(batch, epoch)

    def load(self, batch: DataFrame, epoch: int) -> None:
        from ..plans.archives import batch_id_of, ingest_archives
        from ..plans.ingest import ingest_files

        spark = batch.sparkSession
        arrived = cut_lineage(batch, "watch_arrivals")  # a few rows
        gated = marker_gate(arrived.select(F.col("file_name").alias("name")), arrived.select("marker")) \
            .select(F.col("data_name").alias("file_name"), "action")
        arrived = arrived.join(gated.distinct(), "file_name")
        ext = F.lower(N.file_extension("file_name"))
        ready = F.col("action") == "process"
        outs, runs = [], []
        plain = [r.path for r in arrived.where(ready & (ext == "")).select("path").collect()]   # at most max_files names
        if plain:
            # names are delivered again with other content: content, path and time make the batch
            files = cut_lineage(FS.file_checksums(FS.binary_files(spark, plain)).select(
                "path", batch_id_of("file_checksum", "path", F.col("modification_time").cast("string")).alias("batch_id"),
                "file_name", F.col("length").alias("file_size_bytes"), F.col("path").alias("file_path"),
                "file_checksum", F.col("modification_time").cast("long").alias("arrival")), "watch_files")
            lines = FS.line_scan(spark, plain).join(
                bounded_broadcast(files.select(F.col("path").alias("file_path"), "batch_id")), "file_path") \
                .select("batch_id", "line_number", "line")
            files = files.drop("path")
            run = ingest_files(files, lines, self.rules, manifest=self.known(spark, files, files), tables_path=self.tables_path)
            outs.append((run.manifest, run.results, run.issues))
            runs.append(run)
        zips = [r.path for r in arrived.where(ready & (ext == ".zip")).select("path").collect()]
        if zips:
            found = FS.binary_files(spark, zips)
            own = FS.file_checksums(found).select(batch_id_of("file_checksum", "path").alias("parent_batch_id"))
            manifest = self.known(spark, None, None)
            if manifest is not None:
                manifest = manifest.join(own, "parent_batch_id", "left_anti") \
                    .join(own.select(F.col("parent_batch_id").alias("batch_id")), "batch_id", "left_anti")
            arc = ingest_archives(found, self.rules, manifest=manifest, tables_path=self.tables_path)
            now = F.current_timestamp().cast("timestamp_ntz")
            parents = arc.parents.withColumn("created_at", now).withColumn("started_at", now).withColumn("completed_at", now)
            outs.append((arc.children.manifest.unionByName(parents, allowMissingColumns=True), arc.results, arc.children.issues))
            runs.append(arc.children)
        other = arrived.where(~ready | ~ext.isin("", ".zip")).select(
            F.col("path").alias("batch_id"), F.lit(None).cast("string").alias("parent_batch_id"),
            F.col("file_name").alias("filename"), F.lit(None).cast("string").alias("table_name"),
            F.lit("FAILED").alias("status"), F.lit(0).cast("long").alias("rows_loaded"),
            F.concat(F.lit("Unsupported file type: "), N.file_extension("file_name")).alias("error_message"),
            F.lit(None).cast("string").alias("original_batch_id"))

        # each micro-batch writes its own folders with overwrite: one that is replayed
        # after a failure rewrites the same output instead of appending twice
        def put(df, name, part):
            df.write.mode("overwrite").parquet(f"{self.state_dir}/{name}/epoch_id={epoch}/part={part}")
        for n, (manifest, results, issues) in enumerate(outs):
            put(results, "results", n)
            put(issues, "issues", n)
            store.upsert_stored(self.manifest_path, manifest)
        put(other, "results", "other")
        for run in runs:
            run.release()
