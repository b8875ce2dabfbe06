"""Positions, running sums and neighbours in a global order, without one task that sees all rows.

Rows are range-partitioned by their order and sorted in their partitions; what crosses a partition's border
(a sum, the last row) is carried by a table of one row a partition, or one a partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.storage import checkpointed, shuffle_partitions


def in_order(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df sorted by keys over range partitions, with __part and __at, a place that ascends in the partition.
    Keys that many rows share belong behind a unique one, so that ranges can part those rows."""
    ordered = checkpointed(df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys))
    at = F.monotonically_increasing_id()
    return ordered.select("*", F.shiftright(at, 33).cast("int").alias("__part"), at.alias("__at"))


def running(ordered: DataFrame, value: Column, name: str, group: tuple[str, ...] = ()) -> DataFrame:
    """ordered with the sum of value over a group's rows up to each row, itself included. Groups are leading
    columns of the order (none: all rows are one group)."""
    own = Window.partitionBy("__part", *group).orderBy("__at")
    summed = ordered.withColumn("__value", value)
    parts = summed.groupBy("__part", *group).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    carried = parts.select(F.col("__part").alias("__p"), *(F.col(g).alias(f"__g_{g}") for g in group), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carried"))
    on = F.col("__part") == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    here = summed.withColumn("__run", F.sum("__value").over(own))
    out = here.join(carried, on).withColumn(name, F.col("__run") + F.col("__carried"))
    return out.select(*ordered.columns, name)


def place_in_group(df: DataFrame, group: tuple[str, ...], *keys: Column | str, name: str = "n") -> DataFrame:
    """df with each row's number (from 1) in its group by keys. A group's rows may lie in many tasks."""
    placed = running(in_order(df, *group, *keys), F.lit(1).cast("long"), name, group)
    return placed.drop("__part", "__at")


def previous(ordered: DataFrame, column: str, name: str) -> DataFrame:
    """ordered with the value of column in the row before, across partitions' borders; null for the first row."""
    own = Window.partitionBy("__part").orderBy("__at")
    value = F.struct(F.col(column).alias("v"))
    lasts = ordered.groupBy("__part").agg(F.max_by(value, F.col("__at")).alias("__last"))
    carried = lasts.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__carried"))  # a row a partition
    out = ordered.join(F.broadcast(carried), "__part").withColumn("__before", F.coalesce(F.lag(value).over(own), F.col("__carried")))
    return out.select(*ordered.columns, F.col("__before")["v"].alias(name))


def lookup(rows: DataFrame, table: DataFrame, on: tuple[str, ...], how: str = "inner", count: int | None = None) -> DataFrame:
    """rows (count of them, if known) joined to a table whose keys are unique. Keys that hold more than a partition's share of rows (fewer
    of them than partitions) meet theirs by broadcast, all others by a join, so no task gets a hot key whole."""
    share = max(1, (rows.count() if count is None else count) // shuffle_partitions(rows.sparkSession))
    hot = rows.groupBy(*on).count().where(F.col("count") > share).select(*on).collect()  # fewer than partitions
    if not hot:
        return rows.join(table, list(on), how)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*on).schema))
    marked = rows.join(few.withColumn("__hot", F.lit(True)), list(on), "left")
    by_broadcast = marked.where("__hot").drop("__hot").join(F.broadcast(table.join(few, list(on), "left_semi")), list(on), how)
    return by_broadcast.unionByName(marked.where(F.col("__hot").isNull()).drop("__hot").join(table, list(on), how))


def quantiles(df: DataFrame, group: str, value: str, places: dict[str, float]) -> DataFrame:
    """(group, n, <name> for each place): interpolated quantiles, exact, by selection in a global order of distinct
    values: no task or buffer holds a group. Null values and null groups do not count."""
    given = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counted = given.groupBy(group, value).agg(F.count("*").alias("__c"))
    upto = running(in_order(counted, group, value), F.col("__c"), "__upto", (group,))
    totals = counted.groupBy(F.col(group).alias("__group")).agg(F.sum("__c").alias("n"))  # a row a group
    met = upto.join(totals, F.col(group) == F.col("__group"))
    picks = []
    for name, p in places.items():
        at = F.lit(p) * (F.col("n") - 1)  # from 0
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            holds = (F.col("__upto") > place) & (F.col("__upto") - F.col("__c") <= place)
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"__{name}_{side}"))
    found = met.groupBy(group).agg(F.first("n").alias("n"), *picks)
    between = {name: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1)) for name, p in places.items()}
    return found.select(group, "n", *((F.col(f"__{k}_low") * (1 - w) + F.col(f"__{k}_high") * w).alias(k) for k, w in between.items()))
