"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Within each source the rows are shuffled by a seeded hash and ranked; a row's fractional rank is its rank divided by
its source's rows. Sorted by fractional rank, any stretch of rows holds the sources in the whole table's proportions,
so equal cuts give shards of the same mixture, with row counts at most one apart.

Both ranks are exact and neither needs a source, or the table, in one task: rows fall into many ordered buckets, each
bucket is numbered by itself, and running sums of the buckets' counts place it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

ROWS_PER_BUCKET = 2048
BLOCK = 4096


def running_starts(counts: DataFrame, key: str, value: str, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """(by,) key, start: the sum of `value` over all smaller keys (integers from 0) of the same `by`, in two levels so that no task takes all keys."""
    own = counts.withColumn("_block", F.expr(f"{key} div {block}"))
    if by:
        own = own.withColumn("_by", F.col(by))
    else:
        own = own.withColumn("_by", F.lit(0))
    blocks = own.groupBy("_by", "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_by").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_by").alias("_of"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_by", "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    placed = placed.join(blocks, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_b")))
    return placed.select(*([by] if by else []), key, (F.col("_base") + F.col("_in")).alias("start"))


def assign(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: int = 42,
    carry: dict[str, Column] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per input row: id, source, the `carry` columns, shard and slot (gapless from 0 in each shard).

    A null source is a source of its own; null ids and repeated rows are rows like any other, ties between them are
    settled by the carried columns (rows equal in all of these are interchangeable); an empty table gives no rows;
    with fewer rows than shards some shards stay empty. Columns of the input that aren't named don't matter.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    carry = carry or {}
    total = docs.count()
    buckets = max(1, -(-total // rows_per_bucket))
    dealt = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"))
    part = F.expr("0")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), dealt.alias("h"), *(c.alias(f"carry_{n}") for n, c in carry.items()))
    part = F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(buckets).cast("long"), 31)
    rows = rows.withColumn("bucket", part)
    carried = [f"carry_{n}" for n in carry]

    counts = docs.select(F.col(f"`{source_col}`").alias("source"), dealt.alias("h")).withColumn("bucket", part).groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "sharding")
    of = counts.groupBy(F.col("source").alias("o")).agg(F.sum("n").alias("of"))
    counts = running_starts(counts, "bucket", "n", by="source").join(of, F.col("source").eqNullSafe(F.col("o")))
    counts = counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("start").alias("before"), "of")
    within = Window.partitionBy("source", "bucket").orderBy("h", "id", *carried)
    ranked = rows.withColumn("k", F.row_number().over(within)).join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    # a source's phase spreads the ranks of many small sources over the whole range
    phase = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("source")), 11) + 0.5) / float(1 << 53)
    ranked = ranked.withColumn("f", (F.col("before") + F.col("k") - phase) / F.col("of"))
    ranked = ranked.select("id", "source", "h", *carried, "f", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1)).alias("bucket"))
    ranked = written(ranked, "sharding")

    starts = running_starts(ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "n")
    order = Window.partitionBy("bucket").orderBy("f", "source", "h", "id", *carried)
    placed = ranked.withColumn("k", F.row_number().over(order)).join(starts, "bucket").withColumn("g", F.col("start") + F.col("k") - 1)
    placed = placed.withColumn("shard", F.expr(f"int(g * {shards}L div {max(1, total)}L)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), *(F.col(f"carry_{n}").alias(n) for n in carry), "shard", (F.col("g") - first).alias("slot"))
