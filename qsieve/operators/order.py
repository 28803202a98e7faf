"""O1–O3: total order, ordinals and running sums without a single-task window.

Rows are range-partitioned by group and order (one exchange; a group of any
size spreads over many partitions) and sorted within partitions.  One pass
adds each row's running sums within its partition's part of the group; the
result is checkpointed, so that range bounds and partitions stay as they are.
Per partition and group the sums are then totalled, and prefix sums over the
partitions of a group say what came before.  Only a partition's first group
can have begun earlier, so there is at most one such offset per partition:
they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import severity_rank
from ..session import materialize


def _summing(group: str, names: list[str]):
    """A mapInArrow function: rows sorted by group, with `names` and `_part` as
    their last columns -> the same rows, each amount replaced by the sum before
    it in this partition's part of the group, `_sum_` + name by the sum with it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held, sums = None, dict.fromkeys(names, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ends = pc.run_end_encode(batch[group]).run_ends.to_numpy()
            starts = np.append(0, ends[:-1])
            same = held is not None and held[0].equals(batch[group][0])
            out = {}
            for c in names:
                amount = batch[c].to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(amount)
                before = upto - amount
                base = before[starts].copy()
                base[0] -= sums[c] if same else 0
                shift = np.repeat(base, ends - starts)
                out[c], out["_sum_" + c] = pa.array(before - shift), pa.array(upto - shift)
                sums[c] = int(upto[-1] - shift[-1])
            held = (batch[group][n - 1],)
            keep = [c for c in batch.schema.names if c not in out]
            yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + list(out.values()), keep + list(out))

    return run


def running(rows: DataFrame, group: str, order: list[str | Column], amounts: dict[str, Column]) -> DataFrame:
    """rows with a long column for each amount: its sum over the rows of the
    group that come before in order.  order must be total (or its ties alike),
    else rows that tie stand in any order."""
    names = list(amounts)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    wide = rows.withColumns({f"_by_{i}": k for i, k in enumerate(keys)} | {n: F.coalesce(a.cast("long"), F.lit(0)) for n, a in amounts.items()})
    by = [group, *(f"_by_{i}" for i in range(len(keys)))]
    placed = wide.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(*by[1:]).withColumn("_part", F.spark_partition_id())
    kept = [f for f in placed.schema.fields if f.name not in names]
    schema = T.StructType(kept + [T.StructField(p + n, T.LongType()) for n in names for p in ("", "_sum_")])
    summed = materialize(placed.select(*(f.name for f in kept), *names).mapInArrow(_summing(group, names), schema))
    total = summed.groupBy("_part", group).agg(*(F.max("_sum_" + n).alias("_all_" + n) for n in names), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = total.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), *(F.sum("_all_" + n).over(along).alias("_off_" + n) for n in names))
    offsets = offsets.where(F.col("_off_" + names[0]).isNotNull())  # at most one group a partition began before it
    out = summed.join(F.broadcast(offsets), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.select(*rows.columns, *((F.col(n) + F.coalesce("_off_" + n, F.lit(0))).alias(n) for n in names))


def report_order(findings: DataFrame) -> list[Column]:
    """O1, O3: severity rank, file (binary order), first appearance, rule id."""
    at = (lambda c: F.col("first_pos").getField(c)) if "first_pos" in findings.columns else F.col
    return [severity_rank("severity"), F.col("file"), *(at(c) for c in ("phase", "rule_ord", "line", "column")), F.col("rule_id")]


def ordered(findings: DataFrame, group: str = "repo", name: str = "position") -> DataFrame:
    """O1–O3: findings with their place (from 1) in their repository's report order."""
    out = running(findings, group, report_order(findings), {"_rank": F.lit(1)})
    return out.withColumn(name, F.col("_rank") + 1).drop("_rank")
