"""Findings columns: order, validation, and resolution of overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import indexes, let, overlaps, running
from .detectors import ENTITIES, FINDING, PRIORITY


def priority(entity: Column) -> Column:
    """Rank of an entity; 0 for one of the caller's."""
    table = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    return F.coalesce(F.try_element_at(table, entity), F.lit(0))


def bucket(entity: Column) -> Column:
    """The entity's name in metrics: caller's entities are all CUSTOM."""
    return F.when(entity.isin(*ENTITIES), entity).otherwise(F.lit("CUSTOM"))


def ordered(findings: Column) -> Column:
    """By start, end, entity, detector, then the surer first."""
    keyed = F.transform(findings, lambda f: F.struct(f["start"], f["end"], f["entity"], f["detector"], (-f["confidence"]).alias("c"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def resolve(findings: Column) -> Column:
    """Non-overlapping findings: chosen by priority, length, confidence, start, end, entity, detector and place; in text order.

    Findings fall into clusters that overlap no other cluster; the choice is made within each, so the cost follows the
    number of findings and the square of the largest cluster.
    """
    return F.when(F.size(findings) < 2, findings).otherwise(let(ordered(findings), lambda all_: F.when(_overlap(all_), _by_cluster(all_)).otherwise(all_)))


def _overlap(lined: Column) -> Column:
    """Whether any of the findings, in order, overlap: then some neighbours do."""
    return F.exists(F.zip_with(lined, F.slice(lined, 2, F.greatest(F.size(lined) - 1, F.lit(0))), lambda a, b: F.coalesce(b["start"] < a["end"], F.lit(False))), lambda x: x)


def _by_cluster(lined: Column) -> Column:
    reach = running(F.transform(lined, lambda f: f["end"]), lambda a, b: F.greatest(a, b), F.lit(-1))
    opens = F.filter(F.zip_with(indexes(F.size(lined)), F.zip_with(lined, reach, lambda f, r: r <= f["start"]), lambda i, new: F.when(new, i)), lambda i: i.isNotNull())
    bounds = lambda at: F.zip_with(at, F.concat(F.slice(at, 2, F.size(at) - 1), F.array(F.size(lined))), lambda a, b: F.slice(lined, a + 1, b - a))
    return F.flatten(F.transform(let(opens, bounds), lambda c: F.when(F.size(c) < 2, c).otherwise(_best(c))))


def _best(findings: Column) -> Column:
    ranked = F.transform(
        findings,
        lambda f, i: F.struct(
            (-priority(f["entity"])).alias("p"),
            (f["start"] - f["end"]).alias("l"),
            (-f["confidence"]).alias("c"),
            f["start"].alias("s"),
            f["end"].alias("e"),
            f["entity"].alias("n"),
            f["detector"].alias("d"),
            i.alias("i"),
            f.alias("f"),
        ),
    )
    chosen = F.aggregate(
        F.array_sort(ranked),
        F.array().cast(f"array<{FINDING}>"),
        lambda acc, k: F.when(F.exists(acc, lambda x: overlaps(x, k["f"])), acc).otherwise(F.concat(acc, F.array(k["f"]))),
    )
    return ordered(chosen)


def span_error(span: Column, raw: Column) -> Column:
    """span if it isn't a stretch of the text's bytes, utf8_boundary if it cuts a character, else null."""
    a, b = span["start"], span["end"]
    inner = lambda at: (at < F.octet_length(raw)) & F.hex(F.substring(raw, at + 1, F.lit(1))).between("80", "BF")
    return F.when(a.isNull() | b.isNull() | (a < 0) | (a >= b) | (b > F.octet_length(raw)), "span").when(inner(a) | inner(b), "utf8_boundary")


def finding_error(finding: Column, raw: Column) -> Column:
    """The first field of a finding that is wrong for the text's bytes, or null: entity, confidence, span, utf8_boundary, detector."""
    c, span = finding["confidence"], span_error(finding, raw)
    return (
        F.when(finding["entity"].isNull() | (F.trim(finding["entity"]) == ""), "entity")
        .when(c.isNull() | F.isnan(c) | (c < 0) | (c > 1), "confidence")
        .when(span.isNotNull(), span)
        .when(finding["detector"].isNull(), "detector")
    )


def first_error(findings: Column, text: Column) -> Column:
    raw = text.cast("binary")
    return F.try_element_at(F.filter(F.transform(findings, lambda f: finding_error(f, raw)), lambda e: e.isNotNull()), F.lit(1))


def resolve_checked(findings: Column, text: Column) -> Column:
    """struct<findings, error>: resolve() of findings that are right for the text; else none, and the first wrong field."""
    error = first_error(findings, text)
    return let(error, lambda e: F.struct(F.when(e.isNull(), resolve(findings)).otherwise(F.array().cast(f"array<{FINDING}>")).alias("findings"), e.alias("error")))
