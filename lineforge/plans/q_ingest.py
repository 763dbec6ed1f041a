"""The composite single-file flow over a whole run of derived deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.validate import rules_df
from . import derived as D
from . import oracle as O
from .ingest import ingest_files
from .q_load import SCANNED
from .registry import register

_MANIFEST_COLS = ("batch_id", "file_name", "table_name", "status", "total_records", "processed_records",
                  "failed_records", "corrected_records", "warning_count", "error_count",
                  "data_quality_status", "error_message", "error_details")


def _run(spark, sf, write=True):
    lines = D.orders_tsv(spark, sf)
    files = lines.groupBy("batch_id", "file_name").agg(
        F.sum(F.length("line") + 1).cast("long").alias("file_size_bytes")) \
        .withColumn("file_checksum", F.sha2("file_name", 256)).withColumn("arrival", F.lit(0))
    return ingest_files(files, lines.select("batch_id", "line_number", "line"), rules_df(spark), write=write)


@register("ingest_files", f"""{SCANNED},
files AS (SELECT batch_id, file_name, CAST(sum(length(line) + 1) AS BIGINT) AS file_size_bytes FROM lines GROUP BY ALL),
q AS (SELECT batch_id, count(*) AS n FROM im1 GROUP BY batch_id),
g AS (SELECT batch_id, count(*) AS row_count, count_if(len(violations) > 0) AS bad_rows,
             bool_or(len(violations) > 0) AS failed,
             arg_min(line_number, line_number) FILTER (WHERE len(violations) > 0) AS first_line,
             arg_min(array_to_string(violations, ', '), line_number) FILTER (WHERE len(violations) > 0) AS first_v
      FROM typed GROUP BY batch_id)
SELECT files.batch_id, files.file_name, 'im1' AS table_name,
  CASE WHEN failed THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CAST(CASE WHEN failed THEN 0 ELSE row_count END AS BIGINT) AS total_records,
  CAST(CASE WHEN failed THEN 0 ELSE row_count END AS BIGINT) AS processed_records,
  CAST(0 AS BIGINT) AS failed_records, CAST(0 AS BIGINT) AS corrected_records, 0 AS warning_count,
  CAST(q.n AS INTEGER) AS error_count,
  CASE WHEN failed THEN 'REJECTED' ELSE {O.quality_case('0', '0', 'q.n')} END AS data_quality_status,
  CASE WHEN failed THEN printf('Load failed: %d of %d rows violate the table schema', bad_rows, row_count) END AS error_message,
  CASE WHEN failed THEN printf('first violation at line %d: %s', first_line, first_v) END AS error_details
FROM files JOIN q USING (batch_id) JOIN g USING (batch_id)
WHERE starts_with(files.file_name, 'IM1')""")
def q_ingest_files(spark, sf):
    return _run(spark, sf).manifest.select(*_MANIFEST_COLS)


@register("ingest_results", f"""{SCANNED},
files AS (SELECT DISTINCT batch_id, file_name FROM lines),
g AS (SELECT batch_id, count(*) AS row_count, bool_or(len(violations) > 0) AS failed FROM typed GROUP BY batch_id)
SELECT files.batch_id, file_name AS filename,
  CASE WHEN starts_with(file_name, 'IM3') THEN 'FAILED' WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CAST(CASE WHEN NOT starts_with(file_name, 'IM3') AND NOT failed THEN row_count ELSE 0 END AS BIGINT) AS rows_loaded
FROM files LEFT JOIN g USING (batch_id)""")
def q_ingest_results(spark, sf):
    return _run(spark, sf, write=False).results.select("batch_id", "filename", "status", "rows_loaded")
