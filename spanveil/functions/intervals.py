"""Interval algebra on arrays of struct<start, end>, row by row, and on tables of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KIND = "array<struct<start:int,end:int>>"


def as_intervals(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))


def merge(spans: Column) -> Column:
    """Sorted, with those that overlap or touch made one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(as_intervals(spans)), F.array().cast(KIND), step)


def total_bytes(merged: Column) -> Column:
    return F.aggregate(merged, F.lit(0), lambda acc, s: acc + s["end"] - s["start"])


def union_bytes(spans: Column) -> Column:
    return total_bytes(merge(spans))


def intersection(a: Column, b: Column) -> Column:
    """Of two merged lists."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["start"], y["start"]).alias("start"), F.least(x["end"], y["end"]).alias("end")))))
    return F.array_sort(F.filter(pairs, lambda p: p["start"] < p["end"]))


def difference(a: Column, b: Column) -> Column:
    """What the merged list a has and the merged list b hasn't."""
    ends = lambda s: F.concat(F.array(s["start"]), F.flatten(F.transform(F.filter(b, lambda y: (y["start"] < s["end"]) & (s["start"] < y["end"])), lambda y: F.array(F.greatest(y["start"], s["start"]), F.least(y["end"], s["end"])))), F.array(s["end"]))

    def rest(s: Column) -> Column:
        cuts = ends(s)
        pairs = F.transform(F.sequence(F.lit(0), (F.size(cuts) / 2).cast("int") - 1), lambda i: F.struct(F.get(cuts, 2 * i).alias("start"), F.get(cuts, 2 * i + 1).alias("end")))
        return F.filter(pairs, lambda p: p["start"] < p["end"])

    return F.flatten(F.transform(a, rest))


def covered(span: Column, merged: Column) -> Column:
    return F.exists(merged, lambda m: (m["start"] <= span["start"]) & (m["end"] >= span["end"]))


def merge_rows(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The same merge over rows: keys, start, end of each island. Null bounds give no interval."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
