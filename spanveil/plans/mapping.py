"""Source labels to the engine's entities: direct labels, and runs of name or address parts that stand together."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detectors import ENTITIES
from ..operators.errors import SuiteError
from .evaluation import ANNOTATION, IGNORED, SUPPORTED, UNSUPPORTED

#: Labels of parts, and the orders of name parts that make a person.
PERSON_PARTS = ("FIRST_NAME", "LAST_NAME", "MIDDLE_NAME")
ADDRESS_PARTS = ("COUNTRY", "REGION", "DISTRICT", "CITY", "STREET", "HOUSE")
PERSON_ORDERS = (("FIRST_NAME", "LAST_NAME"), ("LAST_NAME", "FIRST_NAME"), ("FIRST_NAME", "MIDDLE_NAME", "LAST_NAME"), ("LAST_NAME", "FIRST_NAME", "MIDDLE_NAME"))
GAP = re.compile(rb"[ \t\n\r,.;]*")


@dataclass(frozen=True)
class Mapping:
    version: str
    source_id: str
    direct: dict[str, str]
    person_parts: tuple[str, ...] = ()
    least_parts: int = 1
    address_required: tuple[str, ...] = ()
    unmapped_sensitive: tuple[str, ...] = ()
    ignore_reasons: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not self.version.strip() or not self.source_id.strip():
            raise SuiteError("mapping: version and source_id are needed")
        if any(not k.strip() for k in self.direct) or any(v not in ENTITIES for v in self.direct.values()):
            raise SuiteError("mapping: direct")
        if self.least_parts < 1 or any(not p.strip() for p in (*self.person_parts, *self.address_required)):
            raise SuiteError("mapping: parts")

    @classmethod
    def of(cls, spec: dict) -> Mapping:
        known = {"schema_version", "version", "source_id", "direct", "person", "address", "unmapped_sensitive", "ignore_reasons"}
        if set(spec) - known or spec.get("schema_version") != 1 or not isinstance(spec.get("direct"), dict):
            raise SuiteError("mapping: schema")
        person, address = spec.get("person"), spec.get("address")
        if person is not None and not person.get("components") or address is not None and not address.get("required"):
            raise SuiteError("mapping: parts")
        person, address = person or {}, address or {}
        return cls(spec.get("version", ""), spec.get("source_id", ""), spec["direct"], tuple(person.get("components", ())), person.get("min_components", 1), tuple(address.get("required", ())), tuple(spec.get("unmapped_sensitive", ())), tuple(spec.get("ignore_reasons", ())))


def plain(label: str) -> str:
    return label[2:] if label[:2] in ("B-", "I-") else label


def apply(mapping: Mapping, raw: bytes, spans: list[tuple[str, int, int]]) -> list[tuple]:
    """(source_label, mapped_entity, start, end, disposition, reason) of a text's label spans.

    The parts of a run stay unsupported; a run that makes a whole adds the whole as supported.
    """
    rows = sorted(spans, key=lambda s: (s[1], s[2]))
    used, out = set(), []
    for i, (label, start, end) in enumerate(rows):
        if i in used:
            continue
        parts = next((p for p in (PERSON_PARTS, ADDRESS_PARTS) if plain(label) in p), None)
        if parts is None:
            entity = mapping.direct.get(plain(label)) or mapping.direct.get(label)
            out.append((label, entity or "", start, end, SUPPORTED if entity else UNSUPPORTED, ""))
            continue
        run, reach = [rows[i]], end
        used.add(i)
        for j in range(i + 1, len(rows)):
            if j in used:
                continue
            if plain(rows[j][0]) not in parts or rows[j][1] > reach and not GAP.fullmatch(raw, reach, rows[j][1]):
                break
            run.append(rows[j])
            used.add(j)
            reach = max(reach, rows[j][2])
        out += [(x, "", a, b, UNSUPPORTED, "") for x, a, b in run]
        names = tuple(plain(x) for x, _, _ in run)
        person = parts is PERSON_PARTS and mapping.person_parts and len(names) >= mapping.least_parts and set(names) <= set(mapping.person_parts) and names in PERSON_ORDERS
        address = parts is ADDRESS_PARTS and mapping.address_required and {"STREET", "HOUSE"} <= set(names)
        if person or address:
            whole = "PERSON" if person else "ADDRESS"
            out.append((whole, whole, min(a for _, a, _ in run), max(b for _, _, b in run), SUPPORTED, ""))
    return out


def map_labels(rows: DataFrame, mapping: Mapping, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """`rows` and annotations. Rows whose spans are null (what couldn't be aligned) get one ignored annotation of the whole text."""
    @F.pandas_udf(f"array<{ANNOTATION}>")
    def annotate(text: pd.Series, spans: pd.Series) -> pd.Series:
        names = ("source_label", "mapped_entity", "start", "end", "disposition", "reason")
        out = []
        for t, s in zip(text, spans, strict=True):
            raw = (t or "").encode()
            found = [("record", "", 0, len(raw), IGNORED, "adapter_gap")] if s is None else apply(mapping, raw, [(x["label"], x["start"], x["end"]) for x in s])
            out.append([dict(zip(names, f, strict=True)) for f in found])
        return pd.Series(out)

    return rows.withColumn("annotations", annotate(text_col, spans_col))


def as_suite(rows: DataFrame, mapping: Mapping, suite_id: str, record_col: str = "record", text_col: str = "text") -> DataFrame:
    """Second-version records, ready for write_suite()."""
    return rows.select(F.lit(2).alias("schema_version"), F.lit(suite_id).alias("suite_id"), F.lit(mapping.source_id).alias("source_id"), F.col(record_col).cast("string").alias("source_record_id"), F.lit(mapping.version).alias("mapping_version"), F.col(text_col).alias("input"), F.sha2(F.col(text_col).cast("binary"), 256).alias("input_sha256"), "annotations")
