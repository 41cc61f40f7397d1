"""Spark session helpers.

Library code never sizes the cluster: it reads what the session says. Only
tests and ``bench.py`` build a local session; only a local master may go
without a shared checkpoint folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None, app: str = "tagloom") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    n = os.cpu_count() if cores == "*" else int(cores)
    parts = shuffle_partitions or max(4, 2 * (n or 4))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local master (tests, bench: one machine) gets a
    scratch folder, once; any other master is refused, since a folder of this
    machine is not one that executors share.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # no SparkContext view (e.g. Spark Connect): the server's setting applies
        sc = None
    if sc is not None:
        d = d or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if sc is None or not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tagloom-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # a session may treat it as static; the context setting below suffices
            pass
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written table."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/" + name


def written(spark: SparkSession, df, name: str, partition_by: str | None = None):
    """``df`` written once as Parquet under the shared folder, and read back:
    cuts the lineage, survives lost executors, and keeps column pruning,
    filter push-down and size statistics."""
    path = checkpoint_path(spark, f"tagloom-{name}-{uuid.uuid4().hex}")
    w = df.write
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    back = spark.read.parquet(path) if partition_by else spark.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)


def spread(df, spark: SparkSession):
    """Round-robin a DataFrame over the default parallelism when its scan
    yields fewer partitions (one big row group, an unsplittable .zst file).
    A large scan already has more splits than cores and is left alone."""
    try:
        want = spark.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a Spark Connect session): leave it to AQE
        return df
    return df.repartition(want) if have < want else df


TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}


def read_table(spark: SparkSession, sf_dir: str, name: str):
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, spark) if name in TEXT_TABLES else df
