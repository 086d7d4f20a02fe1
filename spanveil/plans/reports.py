"""Reports of the four profiles as dictionaries, Markdown and JSON. No report holds a text; inputs are named by digest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.guard import Guard
from ..operators.resolve import resolve
from ..sources import suites
from . import evaluation as ev
from . import gates

#: The columns of the reports' tables, as (title, field).
ENTITY_COLUMNS = (
    ("Entity", "entity"), ("TP", "tp"), ("FP", "fp"), ("FN", "fn"), ("Neg cases", "negative_cases"), ("FP cases", "false_positive_cases"),
    ("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"), ("FPR", "fpr"), ("FNR", "fnr"),
)
SOURCE_COLUMNS = (("Source", "source_id"), ("TP", "tp"), ("FP", "fp"), ("FN", "fn"), ("Precision", "precision"), ("Recall", "recall"))
FAILURE_COLUMNS = (("Source record", "source_record_id"), ("Label", "source_label"), ("Entity", "entity"), ("Kind", "kind"), ("Gold span", "gold"), ("Predicted span", "predicted"), ("Input SHA-256", "input_sha256"))
EXPOSURE_BYTES = (("Sensitive bytes", "sensitive_bytes"), ("Covered", "covered_sensitive_bytes"), ("Leaked", "leaked_sensitive_bytes"), ("Overmatched", "overmatched_bytes"))
LABEL_COLUMNS = (("Source label", "source_label"), ("Mapped entity", "mapped_entity"), ("Disposition", "disposition"), ("Spans", "span_count"), ("Fully covered", "fully_covered_span_count"), *EXPOSURE_BYTES)
IGNORED_COLUMNS = (("Source label", "source_label"), ("Reason", "reason"), ("Count", "count"))
LIFECYCLE_COLUMNS = (("Source record", "source_record_id"), ("Expected action", "expected_action"), ("Recipe", "response_recipe"), ("Outcome", "outcome"), ("Detail", "detail"), ("Input SHA-256", "input_sha256"))
#: A report's own fields for the sums that evaluation names shortly.
BYTES = {"sensitive": "sensitive_bytes", "covered": "covered_sensitive_bytes", "leaked": "leaked_sensitive_bytes", "overmatched": "overmatched_bytes", "coverage": "byte_coverage"}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _pick(row: dict, columns) -> dict:
    return {field: row.get(field) for _, field in columns}


def _head(profile: str, suite: DataFrame, thresholds: gates.Thresholds | None) -> dict:
    """What a suite's reports begin with. Ids are one each (load_suite() saw to that); the names of sources are collected."""
    one = suite.agg(F.first("suite_id").alias("suite_id"), F.first("mapping_version").alias("mapping_version"), F.count(F.lit(1)).alias("cases"), F.sort_array(F.collect_set("source_id")).alias("source_ids")).head()
    out = {"profile": profile, "suite_id": one.suite_id, "mapping_version": one.mapping_version, "source_ids": list(one.source_ids), "cases": one.cases}
    return out | ({"threshold_id": thresholds.id} if thresholds else {})


def cases_report(cases: DataFrame, guard: Guard) -> dict:
    """The first version: all built-in entities, and whether each has a positive and a negative case."""
    records = cases.select(F.col("id").alias("record"), F.col("input").alias("text"))
    gold = cases.select(F.col("id").alias("record"), F.explode("expected").alias("s")).select("record", "s.*")
    rows = _rows(ev.by_entity(gold, guard.findings_table(records, ["record"], resolved=True), records))
    covers = _rows(suites.coverage(cases))
    whole = all(c["has_positive"] and c["has_negative"] for c in covers)
    summary = {k: sum(r[k] for r in rows) for k in ("tp", "fp", "fn")}
    status = gates.PASS if whole and not summary["fp"] and not summary["fn"] else gates.FAIL
    return {"profile": "v1", "cases": records.count(), "entities": [_pick(r, ENTITY_COLUMNS) for r in rows], "summary": summary, "coverage": {"complete": whole, "entities": covers}, "status": status}


def contract_report(suite: DataFrame, guard: Guard, thresholds: gates.Thresholds | None = None) -> dict:
    found = guard.findings_table(suite.select(F.col("source_record_id").alias("record"), F.col("input").alias("text")), ["record"], resolved=True)
    made = ev.contract_suite(suite, found)
    entities = [_pick(r, ENTITY_COLUMNS) for r in _rows(made["entities"])]
    sources = [_pick(r, SOURCE_COLUMNS) for r in _rows(made["sources"])]
    summary = {k: sum(r[k] for r in entities) for k in ("tp", "fp", "fn")}
    rated = dict(zip(("precision", "recall", "f1"), ev.rates_of(**summary), strict=True))
    status = gates.decide(thresholds, "contract", summary | rated, {r["entity"]: r for r in entities}, {r["source_id"]: r for r in sources}) if thresholds else gates.FAIL if summary["fp"] or summary["fn"] else gates.PASS
    about = {"overlapping_pairs": made["overlaps"].count(), "failures": _rows(made["failures"])}
    return _head("contract", suite, thresholds) | {"status": status, "entities": entities, "summary": summary, "by_source": sources, "diagnostics": about}


def exposure_report(suite: DataFrame, guard: Guard, thresholds: gates.Thresholds | None = None) -> dict:
    seen = guard.detect(suite, "input").withColumn("findings", resolve(F.col("detected.findings")))
    rows = ev.exposure(seen)
    named = lambda r: {BYTES.get(k, k): v for k, v in r.items()}
    total = ev.exposure_summary(rows).head().asDict()
    sources = _rows(ev.exposure_summary(rows, ["source_id"]).orderBy("source_id"))
    status = gates.decide(thresholds, "exposure", total, sources={r["source_id"]: r for r in sources})
    labels = [_pick(named(r), LABEL_COLUMNS) for r in _rows(ev.exposure_by_label(seen, "source_record_id"))]
    return _head("exposure", suite, thresholds) | {"status": status, "summary": named(total), "by_source": [named(r) for r in sources], "by_label": labels, "ignored": _rows(ev.ignored_counts(suite))}


def lifecycle_report(suite: DataFrame, guard: Guard, thresholds: gates.Thresholds | None = None) -> dict:
    rows = ev.lifecycle(suite, guard, "source_record_id")
    # one pass for counts and failures; a filter above would copy all that an outcome is made of
    failed = F.struct(F.col("source_record_id"), F.col("action").alias("expected_action"), F.col("recipe").alias("response_recipe"), F.col("outcome"), F.col("reason").alias("detail"), F.col("input_sha256"))
    found = rows.withColumn("failed", F.when(F.col("reason").isNotNull(), failed)).groupBy("outcome").agg(F.count(F.lit(1)).alias("count"), F.collect_list("failed").alias("failures")).collect()
    counted = {r.outcome: r["count"] for r in found}
    failures = sorted((x.asDict() for r in found for x in r.failures), key=lambda x: x["source_record_id"])
    total = {"fn": len(failures), "fp": counted.get("error", 0)}
    status = gates.decide(thresholds, "lifecycle", total) if thresholds else gates.FAIL if failures else gates.PASS
    counts = {k: counted.get(k, 0) for k in ("ok", "blocked", "mutation_miss", "restore_miss")} | {"errors": counted.get("error", 0)}
    return _head("lifecycle", suite, thresholds) | {"status": status, **counts, "diagnostics": failures}


def regressed(report: dict) -> bool:
    """Coverage is incomplete, something was missed or found wrongly, or a lifecycle failed; exposure has thresholds only."""
    if report["profile"] in ("v1", "contract"):
        return not report.get("coverage", {"complete": True})["complete"] or bool(report["summary"]["fp"] or report["summary"]["fn"])
    return report["profile"] == "lifecycle" and bool(report["diagnostics"])


REPORTS = {"contract": contract_report, "exposure": exposure_report, "lifecycle": lifecycle_report}


# rendering -------------------------------------------------------------------------------------------------------

def _cell(value) -> str:
    return "" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value).lower() if isinstance(value, bool) else str(value)


def _table(columns, rows: list[dict]) -> list[str]:
    words = {"entity", "source_id", "source_label", "mapped_entity", "disposition", "reason", "kind", "gold", "predicted", "source_record_id", "expected_action", "response_recipe", "outcome", "detail", "input_sha256"}
    rule = ["---" if field in words else "---:" for _, field in columns]
    return ["| " + " | ".join(x) + " |" for x in ([title for title, _ in columns], rule, *([_cell(r.get(field)) for _, field in columns] for r in rows))]


def _span(row: dict, side: str) -> str:
    start, end = row.get(f"{side}_start"), row.get(f"{side}_end")
    return "" if start is None or end is None else f"[{start},{end})"


def markdown(report: dict) -> str:
    profile = report["profile"]
    out = [f"# {profile} evaluation report", ""]
    for title, field in (("Suite", "suite_id"), ("Mapping version", "mapping_version"), ("Thresholds", "threshold_id"), ("Sources", "source_ids"), ("Cases", "cases"), ("Status", "status")):
        if field in report:
            out.append(f"{title}: {', '.join(report[field]) if field == 'source_ids' else report[field]}")
    out.append("")
    if "entities" in report:
        out += ["Findings count that agree in entity and byte span; a rate without anything to divide by is 0.", "", *_table(ENTITY_COLUMNS, report["entities"]), ""]
        out.append("Aggregate " + " ".join(f"{k.upper()}={report['summary'][k]}" for k in ("tp", "fp", "fn")))
    if profile == "v1":
        out.append(f"Coverage complete: {_cell(report['coverage']['complete'])}")
        if not report["coverage"]["complete"]:
            out += ["", *_table((("Entity", "entity"), ("Positive", "has_positive"), ("Negative", "has_negative")), report["coverage"]["entities"])]
    if profile == "contract":
        out += ["", "By source:", "", *_table(SOURCE_COLUMNS, report["by_source"])]
        about = report["diagnostics"]
        if about["overlapping_pairs"]:
            out += ["", f"Overlaps that aren't exact (no gate): {about['overlapping_pairs']}"]
        if about["failures"]:
            shown = [r | {"gold": _span(r, "gold"), "predicted": _span(r, "predicted")} for r in about["failures"]]
            out += ["", "Failures:", "", *_table(FAILURE_COLUMNS, shown)]
    if profile == "exposure":
        out += [f"{field.replace('_', ' ').capitalize()}: {_cell(value)}" for field, value in report["summary"].items()]
        out += ["", "By source:", "", *_table((("Source", "source_id"), *EXPOSURE_BYTES, ("Byte coverage", "byte_coverage")), report["by_source"])]
        if report["by_label"]:
            out += ["", *_table(LABEL_COLUMNS, report["by_label"])]
        if report["ignored"]:
            out += ["", "Ignored annotations:", "", *_table(IGNORED_COLUMNS, report["ignored"])]
    if profile == "lifecycle":
        out += [f"{title}: {report[field]}" for title, field in (("OK", "ok"), ("Blocked", "blocked"), ("Mutation/miss expected", "mutation_miss"), ("Restore misses", "restore_miss"), ("Errors", "errors"))]
        if report["diagnostics"]:
            out += ["", "Failures:", "", *_table(LIFECYCLE_COLUMNS, report["diagnostics"])]
    return "\n".join(out).rstrip() + "\n"


def as_json(report: dict) -> str:
    """Fields in report order; what a failure lacks is left out."""
    def tidy(x):
        if isinstance(x, list):
            return [tidy(y) for y in x]
        return {k: tidy(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else x

    return json.dumps(tidy(report), ensure_ascii=False, indent=2) + "\n"
