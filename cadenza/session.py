"""Session construction and shared-folder helpers.

On a cluster the session is created by the platform; these helpers only
fill in settings that are still unset (tests and local runs).
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str = "local[8]", app: str = "cadenza", **conf: str) -> SparkSession:
    """Build (or reuse) a session with local defaults; explicit ``conf`` wins."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is unset
    and the master is local (tests) a private folder is created; on a cluster
    the executors would not see it, so there it must be named.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="cadenza-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make ``cadenza`` importable by the Python workers (once per SparkContext).

    Arrow UDF closures refer to functions of this package by module name, so
    executors need the package: it is zipped once and added with
    ``addPyFile`` (Spark distributes it to every executor).
    """
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_cadenza_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="cadenza-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    sc._cadenza_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that arrives in fewer partitions than the cluster has cores.

    Used before CPU-heavy per-row work (tokenising whole texts): a single
    large Parquet row group is read by one task.  Inputs that are already
    split (the normal case at scale) are returned unchanged - no shuffle.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def bounded_collect(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect an artifact that must stay small (labels, centroids, statistics).

    At most ``max_rows + 1`` rows are fetched; more than ``max_rows`` is an
    error instead of an unbounded pull to the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; refusing to collect it to the driver")
    return rows
