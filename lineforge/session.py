"""Spark session helpers.

Everything in the library takes a ``SparkSession`` from the caller; this
module only offers a sensible default builder and the shared checkpoint
folder lookup used to cut lineage between the gated stages.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the engine relies on.  AQE re-plans joins and coalesces shuffle
# output at run time and splits skewed join partitions (one delivery can hold
# a third of all lines); UTC keeps timestamp text identical on every executor.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Scratch folders of local applications that name none.
_LOCAL_FOLDERS: dict[str, str] = {}
# Folders of the scratch scopes that are open, by application.
_SCOPES: dict[str, list[str]] = {}


def build_session(master: str | None = None, app: str = "lineforge",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    On a cluster leave ``master`` unset and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system
    every executor can reach); it is an error there to leave it unset.  Only
    in local mode, where driver and executors are one process, a private
    scratch folder is made once per application.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[[^]]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if sc.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="lineforge-ckpt-")
        current = _LOCAL_FOLDERS[sc.applicationId]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    scopes = _SCOPES.get(spark.sparkContext.applicationId)
    return os.path.join(scopes[-1] if scopes else base, name)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """What is written to scratch or checkpointed inside is deleted at the end.

    Results must be written inside the scope: frames that still read scratch
    tables are of no use after it.
    """
    sc, base = spark.sparkContext, checkpoint_dir(spark)
    scopes = _SCOPES.setdefault(sc.applicationId, [])
    folder, before = os.path.join(scopes[-1] if scopes else base, f"scope-{uuid.uuid4().hex}"), sc.getCheckpointDir()
    scopes.append(folder)
    sc.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        scopes.pop()
        sc.setCheckpointDir(scopes[-1] if scopes else base)  # Spark makes a new folder in it
        to_path, conf = sc._jvm.org.apache.hadoop.fs.Path, sc._jsc.hadoopConfiguration()
        to_path(folder).getFileSystem(conf).delete(to_path(folder), True)
        old = to_path(before)
        if not old.getFileSystem(conf).listStatus(old):
            old.getFileSystem(conf).delete(old, False)
