"""Thresholds and manifests (strict configuration), gate decisions, and reports as Markdown or JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass

from ..operators.errors import SuiteError

RATES = ("min_precision", "min_recall", "min_f1", "min_byte_coverage")
COUNTS = ("max_fp", "max_fn", "max_leaked_sensitive_bytes", "max_overmatched_bytes")
PROFILES = {
    "contract": {"min_precision", "min_recall", "min_f1", "max_fp", "max_fn"},
    "exposure": {"min_byte_coverage", "max_leaked_sensitive_bytes", "max_overmatched_bytes"},
    "lifecycle": {"max_fp", "max_fn"},
}
#: Which level of a profile may have bounds of its own.
NESTED = {"contract": ("entities", "sources"), "exposure": ("sources",), "lifecycle": ()}
DISTRIBUTIONS = ("manifest-only", "cache-only", "committed-derived")
MANIFEST = {"schema_version", "id", "canonical_url", "revision", "digest_sha256", "license", "attribution", "distribution", "adapter_version", "snapshot_date"}
DIAGNOSTIC, PASS, FAIL = "diagnostic", "pass", "fail"


def read_json(text: str) -> dict:
    """One object, and nothing after it."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise SuiteError("not JSON") from e
    if not isinstance(found, dict):
        raise SuiteError("not a JSON object")
    return found


def manifest(text: str) -> dict:
    found = read_json(text)
    if set(found) - MANIFEST or found.get("schema_version") != 1:
        raise SuiteError("manifest: schema")
    missing = [k for k in sorted(MANIFEST - {"schema_version", "snapshot_date"}) if not str(found.get(k, "")).strip()]
    if missing or found["distribution"] not in DISTRIBUTIONS:
        raise SuiteError("manifest: " + (", ".join(missing) or "distribution"))
    return found


def _bounds(profile: str, spec: dict, top: bool) -> None:
    allowed = PROFILES[profile] | ({"status", *NESTED[profile]} if top else set())
    for k, v in spec.items():
        if k not in allowed:
            raise SuiteError(f"thresholds: {profile} has no {k}")
        if k in RATES and not 0 <= v <= 1 or k in COUNTS and v < 0:
            raise SuiteError(f"thresholds: {k}")
        if k in ("entities", "sources"):
            for nested in v.values():
                _bounds(profile, nested, False)


@dataclass(frozen=True)
class Thresholds:
    id: str
    profiles: dict[str, dict]

    @classmethod
    def of(cls, text: str) -> Thresholds:
        found = read_json(text)
        if set(found) - {"schema_version", "id", "profiles"} or found.get("schema_version") != 1 or not str(found.get("id", "")).strip() or not found.get("profiles"):
            raise SuiteError("thresholds: schema")
        for name, spec in found["profiles"].items():
            if name not in PROFILES or spec.get("status") not in ("gate", DIAGNOSTIC):
                raise SuiteError("thresholds: profile")
            _bounds(name, spec, True)
        return cls(found["id"], found["profiles"])


def broken(spec: dict, row: dict) -> bool:
    """A rate below its least, or a count above its most. Bounds of what the row lacks hold."""
    value = lambda k: row.get({"max_leaked_sensitive_bytes": "leaked", "max_overmatched_bytes": "overmatched", "min_byte_coverage": "coverage"}.get(k, k[4:]))
    return any(value(k) is not None and (value(k) < v if k in RATES else value(k) > v) for k, v in spec.items() if k in RATES + COUNTS)


def decide(thresholds: Thresholds | None, profile: str, total: dict, entities: dict[str, dict] | None = None, sources: dict[str, dict] | None = None) -> str:
    """diagnostic without a gate; else pass or fail by the bounds, or, where the contract has none, by any false finding at all."""
    spec = thresholds.profiles.get(profile) if thresholds else None
    if not spec or spec["status"] == DIAGNOSTIC:
        return DIAGNOSTIC
    if profile != "exposure" and not any(spec.get(k) is not None and spec.get(k) != {} for k in (*RATES, *COUNTS, "entities", "sources")):
        return FAIL if total.get("fp") or total.get("fn") else PASS
    bad = broken(spec, total)
    for level, rows in (("entities", entities or {}), ("sources", sources or {})):
        bad |= any(broken(bounds, rows[name]) for name, bounds in spec.get(level, {}).items() if name in rows)
    return FAIL if bad else PASS


def markdown(title: str, columns: list[str], rows: list[dict], notes: list[str] = ()) -> str:
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    out = [f"# {title}", ""]
    out += ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    out += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join([*out, "", *notes]).rstrip() + "\n"


def as_json(**parts) -> str:
    return json.dumps(parts, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
