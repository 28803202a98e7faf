"""Spark helpers shared by the operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

_SHIPPED: set[str] = set()
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Within it, a finished query's shuffle files are released at its end:
    for operators that write each step's result to a checkpoint."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def kept(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read from there:
    later steps do not go back behind it, and no lost executor takes it along."""
    with releasing(df.sparkSession):
        return materialize(df.select("*"))  # planned here, as the setting is read then


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    have = {c.lower() for f in frames for c in f.columns}
    while name.lower() in have:
        name += "_"
    return name


def salted(rows: DataFrame, key: list[str], most: int, spread_by: str) -> DataFrame:
    """rows with columns `salts` (how many parts the row's group has, so that
    a part holds about `most` rows) and `salt` (the row's part).  Group sizes
    are counted with partial aggregation; only groups beyond `most` are joined."""
    big = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_group")).filter(F.col("n_group") > most)
    big = big.select(*key, F.ceil(F.col("n_group") / most).cast("int").alias("salts"))
    out = rows.join(big, key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return out.withColumn("salt", F.pmod(F.xxhash64(F.lit(7), spread_by), F.col("salts")).cast("int"))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: nothing to do where the
    repository is on PYTHONPATH or installed; otherwise the driver hands a zip
    of its sources to Spark, which sends it to the executors."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or spark.sparkContext.applicationId in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="qsieve-src-"), "qsieve.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(spark.sparkContext.applicationId)
