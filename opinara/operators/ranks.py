"""Running sums and numbers over whole tables or groups of any size, without a window that one task must hold.

A window over a group puts the group in one task.  Here rows are range-partitioned by group and order, each partition is
summed by itself, and the partitions' sums before it (a few rows) are added."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.session import cut_lineage

#: Rows of a table of groups that is broadcast.  With more groups a shuffle by group is spread, and Spark splits what is skewed.
FEW = 10_000


def few(stored: DataFrame) -> DataFrame:
    """A stored table of groups, to be broadcast if it is small: a shuffle by a few groups puts all rows in as many tasks."""
    return F.broadcast(stored) if stored.limit(FEW + 1).count() <= FEW else stored


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, inclusive: bool = True) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the group's rows up to this one in ``order`` (which must tell rows
    apart), itself included or not.

    The partitioning is stored, so that a task that runs again sees the same partitions."""
    keys = [*by, *order]
    placed = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(placed, "ranges")
    sums = placed.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each group and partition that it touches: groups plus partitions at most.
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    split = few(cut_lineage(offsets.where(F.col("_before") != 0), "offsets"))
    own = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    summed = placed.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0)))
    match = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_part"]]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    joined = summed.alias("l").join(split.alias("r"), cond, "left")
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col(f"l.{name}") + F.coalesce("r._before", F.lit(0))).alias(name))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``_n`` (number in the group by ``order``, from 1) and ``_size`` (rows of the group).

    Rows are shuffled once: sorted range partitions are stored with ids that go up by one within a partition, so a number is an id
    less the first one of its group there, plus the group's rows in the partitions before (``runs``, a row for each group and
    partition that it touches)."""
    names = [f"_o{k}" for k in range(len(order))]
    keys = [*by, *names]
    keyed = rows.withColumns(dict(zip(names, order, strict=True)))
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*names).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(placed, "ranges").withColumn("_part", F.shiftright("_id", 33))  # the id's upper bits are the partition's
    runs = placed.groupBy(*by, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kinds = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    runs = runs.select(*kinds, F.col("_part").alias("_in"), (F.col("_first") - 1 - before).alias("_less"), F.sum("_rows").over(w).alias("_size"))
    runs = few(cut_lineage(runs, "runs"))
    cond = F.col("_part") == F.col("_in")
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(runs, cond).select(*rows.columns, (F.col("_id") - F.col("_less")).alias("_n"), "_size")
