"""Line dedup by site-relative frequency, with DataFrame functions only.

For each host and line: the host's pages that hold the line, divided by the host's pages. Lines above the ratio are
boilerplate of that host and are cut from its pages. A line is what stands between line feeds, without spaces and tabs
around it; lines that are blank then neither count nor go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

#: Share of a host's pages above which a line is boilerplate, and the pages that must hold it at least. A template line of
#: a tenth of n pages is found on a share that scatters by sqrt(0.09 / n): a bar at that rate misses it on half of the
#: hosts, one at half of it is three deviations below from 324 pages on. On small hosts the least pages decide.
RATIO = 0.05
LEAST_PAGES = 3
#: Boilerplate lines (all hosts) that are broadcast; beyond it the join shuffles.
BROADCAST_LINES = 200_000


def line_keys(text: Column) -> Column:
    """The distinct hashes of a page's lines that aren't blank."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def page_key(words: Column) -> Column:
    """The least hash of a page's three-word shingles: pages have the same one about as often as their shingles are the same."""
    after = lambda k: F.slice(words, k, F.size(words))
    return F.array_min(F.transform(F.arrays_zip(words.alias("a"), after(2).alias("b"), after(3).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"])))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float, least_pages: int, copies_once: bool = False) -> DataFrame:
    """host, line (hash), pages, of: the lines above the ratio. Counts are combined before each shuffle, so a hot line or host costs a row per task.

    With `copies_once`, pages of one page_key count once for a line. A near copy that five-word shingles liken by 0.8 to
    a text has a key of its own with a probability of a fifteenth if single words differ, of a ninth at most: as many of
    its shingles are new. So a group's lines are boilerplate only where it holds nine times the ratio of the host's pages.
    """
    pages = docs.select(host.alias("host"), text.alias("text"))
    if copies_once:
        words = F.filter(F.split("text", "[ \\t\\r\\n]+", -1), lambda x: x != "")
        keyed = pages.withColumn("words", words).select("host", "text", page_key(F.col("words")).alias("page"))
        lines = keyed.select("host", "page", F.explode(line_keys(F.col("text"))).alias("line")).groupBy("host", "line").agg(F.count_distinct("page").alias("pages"))
    else:
        lines = pages.select("host", F.explode(line_keys(F.col("text"))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("of"))
    common = lines.where(F.col("pages") >= least_pages)
    return common.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("pages") > F.col("of") * F.lit(ratio)).select("host", "line", "pages", "of")


def clean(
    docs: DataFrame,
    host: Column,
    text_col: str = "text",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
    copies_once: bool = False,
) -> DataFrame:
    """`docs` with boilerplate lines cut from the text, and n_lines, n_cut as a last column `line_dedup` (struct).

    If the input has a column of that name, the last column has underscores behind its name.

    A null text stays null and is a page without lines; null hosts are one host; a line that a page repeats counts
    once for it and goes everywhere on it; repeated rows are pages each, unless `copies_once` counts a line once for the
    copies and near copies of a page (and cuts what is boilerplate nevertheless from each of them); an empty table gives no rows. The input's
    columns come back as they are but for the text. Long texts are split whole. A host has at most its pages' mean
    number of lines / ratio boilerplate lines, as each takes a share `ratio` of its pages.
    """
    given = docs.select(F.struct("*").alias("row"), host.alias("host"), F.col(f"`{text_col}`").alias("text"))
    found = written(boilerplate(given, F.col("host"), F.col("text"), ratio, least_pages, copies_once), "line-dedup")
    bad = found.groupBy(F.col("host").alias("h")).agg(F.collect_list("line").alias("bad"))
    bad = F.broadcast(bad) if found.count() <= broadcast_lines else bad.hint("merge")  # the count bounds what is broadcast
    joined = given.join(bad, F.col("host").eqNullSafe(F.col("h")), "left")

    key = lambda x: F.trim(x, F.lit(" \t\r"))
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.filter(lines, lambda x: (key(x) == "") | ~F.array_contains(F.col("bad"), F.xxhash64(key(x))))
    joined = joined.withColumn("kept", F.when(F.col("bad").isNotNull() & F.col("text").isNotNull(), kept))
    joined = joined.withColumn("n_lines", F.coalesce(F.size(F.split(F.col("text"), "\n", -1)), F.lit(0)))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    n_cut = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept"))
    return joined.select(
        *(text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns),
        F.struct(F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), n_cut.alias("n_cut")).alias(free_name("line_dedup", docs.columns)),
    )
