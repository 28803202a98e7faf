"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings the plans are tuned for.  AQE coalesces small shuffle
# partitions and splits skewed ones at runtime.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "qsieve") -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("QSIEVE_DRIVER_MEMORY", "8g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's `spark.checkpoint.dir` when
    the cluster names one (the SparkContext already uses it).  Only where it
    is unset and all runs in one process (local masters, as in tests) a
    scratch folder is set on the SparkContext; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="qsieve-ckpt-")
    sc.setCheckpointDir(d)
    return d


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI or path below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage for a result that several outputs reuse: a reliable
    checkpoint into the shared checkpoint directory (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_DIMS: dict[tuple, DataFrame] = {}


def dimension(spark: SparkSession, key: str, build) -> DataFrame:
    """A small literal dimension, built once per session.  Reusing the same
    DataFrame keeps plans canonically equal, so a query that derives the
    same input twice gets its exchanges reused instead of recomputed."""
    try:
        owner = (spark.sparkContext.applicationId, id(spark._jsparkSession))
    except Exception:
        owner = (None, id(spark))
    k = owner + (key,)
    df = _DIMS.get(k)
    if df is None:
        df = build()
        _DIMS[k] = df
    return df
