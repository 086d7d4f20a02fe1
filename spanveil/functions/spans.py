"""Span columns: the places of a pattern as Catalyst expressions, whose cost follows the text and its spans, not their product.

A span is struct<start, end, value>: half-open UTF-8 byte offsets and its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a running sum takes together; it costs about this many steps for each.
RUN = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, wherever and however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def indexes(n: Column) -> Column:
    """0 to n - 1; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Of an array of ints, in each place what `combine` makes of all values before it; `zero` in the first.

    Done in runs of RUN values, and then over the runs, so that the cost follows the length and not its square.
    """
    one = lambda xs: F.aggregate(
        xs,
        F.struct(zero.alias("now"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct(combine(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")),
    )

    def by_runs(xs: Column) -> Column:
        runs = F.transform(indexes(F.ceil(F.size(xs) / RUN).cast("int")), lambda i: one(F.slice(xs, i * RUN + 1, F.lit(RUN))))
        based = lambda rs: F.zip_with(rs, one(F.transform(rs, lambda r: r["now"]))["out"], lambda r, base: F.transform(r["out"], lambda x: combine(base, x)))
        return F.flatten(let(runs, based))

    return let(values, lambda xs: F.when(F.size(xs) <= RUN, one(xs)["out"]).otherwise(by_runs(xs)))


def find_spans(text: Column, pattern: str) -> Column:
    """All matches of a Java pattern from left to right, without overlap; matches of nothing are left out.

    What stands between the matches is had by a split, and running sums of lengths give the offsets.
    """
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def placed(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: p["gap"] + p["size"]), lambda a, b: a + b, F.lit(0))
        whole = F.zip_with(parts, ends, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["value"].alias("value")))
        return F.filter(whole, lambda s: s["start"] < s["end"])

    # the last gap has no match after it
    pairs = lambda f: F.zip_with(F.slice(f["gaps"], 1, F.size(f["hits"])), f["hits"], lambda g, h: F.struct(F.octet_length(g).alias("gap"), F.octet_length(h).alias("size"), h.alias("value")))
    return let(found, lambda f: let(pairs(f), placed))


def overlaps(a: Column, b: Column) -> Column:
    """Half-open spans that share a byte; touching ones don't."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def byte_slice(raw: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets of a binary column."""
    return F.substring(raw, start + 1, end - start).cast("string")
