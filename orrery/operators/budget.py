"""Selections under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.lineage import cut


def prefix_within(rows: DataFrame, cost: str, order: list, budget: int, group: list[str] | None = None) -> DataFrame:
    """Rows in order up to the first whose running cost exceeds the budget; ``running`` is the sum up to each.

    Costs are not negative, so the rows within are a prefix. Without a group, running sums go in two steps: sums of ranges
    of the order, then sums within each range; so no task holds all rows.
    """
    if group:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)
    # Materialised once: the borders of ranges come from a sample, which another run would draw anew.
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(cost).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "_part").withColumn("running", F.sum(cost).over(w) + F.col("_before")).where(F.col("running") <= budget).drop("_part", "_before")


def greedy_within(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Adds ``admitted`` and ``running``: in order, a row goes in if it still fits; one that does not is passed over.

    ``running`` is what is spent up to and with each row. Costs are not negative (null: 0); nulls of ``group`` are a group;
    rows that are equal in group and order come in any order.

    In rounds: the rows that are still open have running sums, made of sums of ranges and sums within them, so that no task
    holds a group. Those up to the first that exceeds what is left go in, that one is passed over, and so are all behind it
    that cost more than what is then left, as that only falls. A round settles each group's next run of rows that fit, and
    most rounds drop most of the rest.
    """
    names = [f"_{x}" for x in ("at", "part", "cost", "run", "left", "stop", "group")]
    at, part, price, run, left, stop, key = names
    ranged = rows.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn(at, F.monotonically_increasing_id())
    # Materialised once: the borders of ranges come from a sample, which another run would draw anew.
    ranged = cut(ranged.withColumn(part, F.shiftright(at, 33)).withColumn(price, F.coalesce(F.col(cost).cast("long"), F.lit(0))).withColumn(key, F.struct(group)))

    def summed(t: DataFrame, value: Column) -> DataFrame:
        """``t`` with ``run``: sums of ``value`` within each group up to each row."""
        own = t.withColumn("_value", value)
        sums = own.groupBy(key, part).agg(F.sum("_value").alias("_sum"))
        before = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        within = F.sum("_value").over(Window.partitionBy(key, part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
        return own.withColumn("_within", within).join(sums.select(key, part, before.alias("_before")), [key, part]).withColumn(run, F.col("_within") + F.col("_before")).drop("_value", "_within", "_before")

    open_ = ranged.where(F.col(price) <= budget).select(key, part, at, price, F.lit(budget).cast("long").alias(left))
    admitted = None
    while True:
        sums = cut(summed(open_, F.col(price)))
        stops = sums.groupBy(key).agg(F.min(F.when(F.col(run) > F.col(left), F.col(at))).alias(stop), F.max(F.when(F.col(run) <= F.col(left), F.col(run))).alias("_spent"))
        told = cut(sums.join(stops, key).withColumn(left, F.col(left) - F.coalesce("_spent", F.lit(0))))
        went = told.where(F.col(stop).isNull() | (F.col(at) < F.col(stop))).select(at)
        admitted = went if admitted is None else admitted.unionByName(went)
        open_ = told.where((F.col(at) > F.col(stop)) & (F.col(price) <= F.col(left))).select(key, part, at, price, left)
        if open_.isEmpty():
            break
    out = ranged.join(admitted.withColumn("admitted", F.lit(True)), at, "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))
    out = summed(out, F.when(F.col("admitted"), F.col(price)).otherwise(0)).withColumn("running", F.col(run))
    return out.select(*rows.columns, "admitted", "running")
