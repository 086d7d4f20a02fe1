"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's word shingles (all of them if there
are fewer, so that the sketch of a short text is exact). Sketches of parts merge into the sketch of the whole, and give
estimates of resemblance, containment and the number of distinct shingles.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer words than a shingle takes is
one shingle; a text without words has an empty sketch.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, lower_ascii

WORDS = 5
K = 128
#: Neighbour search deals the rows to ranges of about so many rows each, but makes at most MOST_PARTS ranges (their first
#: ids, 20 bytes each, are broadcast): MOST_RANGES come from quantiles, and are cut further by equal widths.
RANGE_ROWS, MOST_RANGES, MOST_PARTS = 256, 8192, 1 << 18
#: Rows that a task takes then.
TASK_ROWS = 1 << 15


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(lower_ascii(text), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, n: int = WORDS) -> Column:
    """`hashes` has to be a column of its own, not an expression: it is named once for each word of a shingle."""
    size = F.size(hashes)
    each = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(n))))
    return F.when(size >= n, each).when(size > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def add_sketch(df: DataFrame, text: Column, name: str, n: int = WORDS, k: int = K) -> DataFrame:
    """`df` with the sketch of `text` as column `name`. A null text has an empty sketch."""
    made = df.withColumn(name, word_hashes(F.coalesce(text, F.lit(""))))
    return made.withColumn(name, bottom(shingle_hashes(F.col(name), n), k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' union. Shingles that cross the parts' border aren't in either."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1: the share of the union's k smallest hashes that both have. Of two empty sketches: 1."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, k) + F.lit(float(1 << 63))) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1. Of an empty a: 1."""
    whole = distinct_shingles(merge(a, b, k), k) * resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), whole / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    """Base64 of the hashes, 8 bytes each, big end first."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def rank_in(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are at most x, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*(F.lit(b) for b in bounds))
    top = 1 << (len(bounds).bit_length() - 1)
    steps = F.array(*(F.lit(top >> i) for i in range(top.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= x), at + step).otherwise(at))


def unit_of(h: Column) -> Column:
    """A 64-bit hash as a share of all of them, 0 to 1."""
    return (h.cast("double") + F.lit(float(1 << 63))) / float(1 << 64)


def range_of(bounds: list[int], low: int, high: int, sub: int, alike: int, nulls: int) -> Column:
    """The number of the range that a row (columns id, h) falls into; it doesn't fall as (id, h) rises.

    Quantiles are cut into `sub` ranges of equal width; rows of an id that is a quantile by itself, into `alike` by
    their hash; rows without an id come before all others, in `nulls` ranges.
    """
    at = rank_in(bounds, F.col("id"))
    edges = F.array(*(F.lit(x) for x in (low, *bounds, high)))
    a, b = F.get(edges, at), F.get(edges, at + 1)
    share = (F.col("id").cast("double") - a.cast("double")) / F.greatest(b.cast("double") - a.cast("double"), F.lit(1.0))
    fine = F.greatest(F.lit(0), F.least(F.lit(sub - 1), F.floor(share * sub)))
    place = at * sub + fine
    if alike > 1:
        slot = F.when(F.col("id") == a, F.least(F.lit(alike - 1), F.floor(unit_of(F.col("h")) * alike))).otherwise(F.lit(alike))
        place = place * (alike + 1) + slot
    null_slot = F.least(F.lit(nulls - 1), F.floor(unit_of(F.col("h")) * nulls)) - nulls
    return F.when(F.col("id").isNull(), null_slot).otherwise(place).cast("long")


def with_next(docs: DataFrame, id_col: str, carry: list[str], range_rows: int = RANGE_ROWS, most_ranges: int = MOST_RANGES, most_parts: int = MOST_PARTS, prepare=None) -> DataFrame:
    """`docs` and, as next_<name>, the carried columns of the row with the next id; the last row's next is the first.

    Rows are dealt to ranges of ids, see range_of(); a range's first row is also dealt to the range before it. Null ids
    come first; rows of equal id follow each other in the order of the first carried column's hash. `prepare` adds
    columns to the rows once they have been dealt. Columns of any name are fine, but for those that start with "next_".
    """
    hashed = F.xxhash64(carry[0])
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), hashed.alias("h"))
    total, some, low, high = ids.agg(F.count(F.lit(1)), F.count("id"), F.coalesce(F.min("id"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).head()
    wanted = max(1, min(most_parts, total // range_rows))
    ranges = min(most_ranges, wanted)
    cuts = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 100 * most_ranges)).head()[0] if ranges > 1 else []
    bounds = sorted(set(cuts or []))
    alike = max((sum(1 for _ in g) for _, g in itertools.groupby(cuts or [])), default=1)
    part = range_of(bounds, low, high, -(-wanted // ranges), alike, max(1, min(wanted, (total - some) // range_rows)))
    first = {r.part: (r.at.id, r.at.h) for r in ids.groupBy(part.alias("part")).agg(F.min(F.struct("id", "h")).alias("at")).collect()}  # MOST_PARTS bounds them
    parts = sorted(first)
    before = [(p, *first[p], parts[i - 1], i == 0) for i, p in enumerate(parts)]
    spark = docs.sparkSession
    extra = F.broadcast(spark.createDataFrame(before, "p long, first_id long, first_h long, target long, wraps boolean"))

    names = docs.columns
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), hashed.alias("h"))
    given = given.withColumn("part", part).join(extra, F.col("part") == F.col("p"), "left")
    own = F.struct(F.col("part").alias("to"), F.lit(False).alias("guest"), F.lit(False).alias("last"))
    guest = F.struct(F.col("target").alias("to"), F.lit(True).alias("guest"), F.col("wraps").alias("last"))
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    dealt = given.withColumn("at", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select("row", "id", "h", "at.*")
    # a column of its own, not a struct's field: else the window deals the rows anew
    to, place = free_name("to", names), free_name("place", names)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS + 1)
    dealt = dealt.select(F.col("to").alias(to), F.struct("id", "h", "guest", "last").alias(place), *(F.col(f"row.`{c}`") for c in names)).repartition(n, to)
    if prepare:
        dealt = prepare(dealt)
    order = Window.partitionBy(to).orderBy(F.col(place)["last"], F.col(place)["id"].asc_nulls_first(), F.col(place)["h"], F.col(place)["guest"])
    new = [c for c in dealt.columns if c not in (to, place)]
    ahead = dealt.select(place, *(F.col(f"`{c}`") for c in new), *(F.lead(c).over(order).alias(f"next_{c}") for c in carry))
    return ahead.where(~F.col(place)["guest"]).drop(place)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, k: int = K) -> DataFrame:
    """One row per input row: its id and `sketch` (array of longs). Needs no shuffle."""
    given = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    return add_sketch(given, F.col("_text"), "sketch", n, k).select(id_col, "sketch")


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, k: int = K) -> DataFrame:
    """Per document, its fingerprint, that of a text edited from it, and estimated likeness to that and to the next document.

    The edited text has the last quarter of the code points (rounded down) replaced by the first as many of the next
    document, or all if it has fewer. A null text counts as an empty one. A lone row is its own next. Repeated rows
    are rows each; an empty table gives no rows; other columns of the input don't matter.
    """
    given = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    ahead = with_next(given, "doc", ["body", "sketch"], prepare=lambda df: add_sketch(df, F.col("body"), "sketch", n, k))
    n_chars = F.char_length("body")
    moved = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), n_chars - moved), F.substring("next_body", F.lit(1), moved))
    made = ahead.select("doc", n_chars.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    made = made.select("doc", "n_chars", "sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"), "edited")
    made = add_sketch(made, F.col("edited"), "edited_sketch", n, k)
    return made.select(
        F.col("doc").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        "near_next",
    )
