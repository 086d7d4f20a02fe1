"""Metrics without values: an event for each detection, masking and restoring, their totals, and callbacks.

An event holds sizes, counts and an outcome; no text, value, token or cause of an error. Raw rows are for development
alone, and only unsafe_rows() makes them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .errors import ConfigError
from .guard import BLOCKED, OK, RESTORE_MISS, Guard, entity_counts

DETECT, MASK, RESTORE = "detect", "mask", "restore"
#: What stands for a token set and for a text wherever a result is shown.
TOKENS_SHOWN, TEXT_SHOWN = "<tokens>", "<text>"
COUNTS = "array<struct<{}:string,count:int>>"
EVENT = f"operation string, outcome string, input_bytes int, output_bytes int, finding_count int, restore_misses int, entity_counts {COUNTS.format('entity')}, action_counts {COUNTS.format('action')}"


@dataclass(frozen=True)
class Event:
    """A row of events as a value; it shows as a line of numbers."""

    operation: str
    outcome: str
    input_bytes: int = 0
    output_bytes: int = 0
    finding_count: int = 0
    restore_misses: int = 0
    entity_counts: dict[str, int] = field(default_factory=dict)
    action_counts: dict[str, int] = field(default_factory=dict)

    def __repr__(self) -> str:
        sizes = " ".join(f"{k}={len(v) if isinstance(v, dict) else v}" for k, v in asdict(self).items())
        return f"Event({sizes})"

    def as_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class MaskResult:
    """A masked row as a value: it shows neither its text nor its tokens."""

    text: str | None
    findings: tuple = ()
    tokens: tuple = ()
    status: str = OK

    def __repr__(self) -> str:
        return f"MaskResult(text={TEXT_SHOWN}, findings={len(self.findings)}, tokens={TOKENS_SHOWN}, status={self.status})"

    def as_json(self) -> str:
        return json.dumps({"findings_count": len(self.findings), "status": self.status, "text": TEXT_SHOWN, "tokens": TOKENS_SHOWN}, sort_keys=True)


class TokenSet(tuple):
    """(token, value) pairs that show as a constant."""

    __slots__ = ()

    def __repr__(self) -> str:
        return TOKENS_SHOWN

    __str__ = __repr__

    def __format__(self, spec: str) -> str:
        return TOKENS_SHOWN


def mask_result(row) -> MaskResult:
    """Of a collected struct that Guard.mask() made."""
    return MaskResult(row.text, tuple(row.findings or ()), TokenSet((t.token, t.value) for t in row.tokens or ()), row.status)


def outcome(status: Column) -> Column:
    """success, blocked, restore_miss or error."""
    return F.when(status.isin(OK, BLOCKED, RESTORE_MISS), status).otherwise(F.lit("error"))


def action_counts(guard: Guard, findings: Column) -> Column:
    actions = F.transform(findings, lambda f: guard.action(f["entity"]))
    return F.transform(F.array_sort(F.array_distinct(actions)), lambda a: F.struct(a.alias("action"), F.size(F.filter(actions, lambda x: x == a)).alias("count")))


def _events(operation: str, rows: DataFrame, input_bytes: Column, output_bytes: Column, status: Column, findings: Column | None, misses: Column | None, guard: Guard | None) -> DataFrame:
    held = rows.select(
        F.coalesce(input_bytes, F.lit(0)).alias("input_bytes"),
        F.coalesce(output_bytes, F.lit(0)).alias("output_bytes"),
        outcome(status).alias("outcome"),
        *([findings.alias("f")] if findings is not None else []),
        F.coalesce(misses, F.lit(0)).alias("restore_misses") if misses is not None else F.lit(0).alias("restore_misses"),
    )
    none = lambda name: F.array().cast(COUNTS.format(name)).alias(f"{name}_counts")
    return held.select(
        F.lit(operation).alias("operation"),
        "outcome",
        "input_bytes",
        "output_bytes",
        (F.size("f") if findings is not None else F.lit(0)).alias("finding_count"),
        "restore_misses",
        entity_counts(F.col("f")).alias("entity_counts") if findings is not None else none("entity"),
        action_counts(guard, F.col("f")).alias("action_counts") if guard is not None else none("action"),
    )


def detect_events(detected: DataFrame, text_col: str = "text", into: str = "detected") -> DataFrame:
    """One event per row of guard.detect()."""
    own = F.col(into)
    return _events(DETECT, detected, F.octet_length(text_col), F.lit(0), own["status"], own["findings"], None, None)


def mask_events(guard: Guard, masked: DataFrame, text_col: str = "text", into: str = "masked") -> DataFrame:
    """One event per row of guard.mask()."""
    own = F.col(into)
    return _events(MASK, masked, F.octet_length(text_col), F.octet_length(own["text"]), own["status"], own["findings"], None, guard)


def restore_events(restored: DataFrame, response_col: str, into: str = "restored") -> DataFrame:
    """One event per row of restore()."""
    own = F.col(into)
    return _events(RESTORE, restored, F.octet_length(response_col), F.octet_length(own["text"]), own["status"], None, own["misses"], None)


def totals(events: DataFrame) -> DataFrame:
    return events.groupBy("operation", "outcome").agg(F.count(F.lit(1)).alias("calls"), F.sum("finding_count").alias("findings"), F.sum("restore_misses").alias("restore_misses"), F.sum("input_bytes").alias("input_bytes"))


def observed(df: DataFrame, into: str, observation: Observation) -> DataFrame:
    """`df` (of detect, mask or restore), whose action fills `observation`: calls, and calls by outcome; no job of its own."""
    if observation is None:
        raise ConfigError("observer is missing")
    out = outcome(F.col(into)["status"])
    return df.observe(observation, F.count(F.lit(1)).alias("calls"), *(F.count_if(out == o).alias(o) for o in (OK, BLOCKED, RESTORE_MISS, "error")))


def each_event(events: DataFrame, call: Callable[[Event], None]) -> DataFrame:
    """`events`, and `call` for each of them where its row is made: on an executor, again if a task is run again. An error in `call` is its own."""
    if not callable(call):
        raise ConfigError("observer can't be called")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for name in ("entity", "action"):
                    r[f"{name}_counts"] = {x[name]: x["count"] for x in r[f"{name}_counts"] or ()}
                try:
                    call(Event(**r))
                except Exception:  # noqa: S110  an observer that fails mustn't fail what it observes
                    pass
            yield batch

    return events.mapInArrow(run, events.schema)


def unsafe_rows(operation: str, df: DataFrame, input_col: str, into: str) -> DataFrame:
    """UNSAFE, for development only: operation, outcome, input, output and findings of each row, with the text in clear. Tokens aren't in it."""
    if operation not in (DETECT, MASK, RESTORE):
        raise ConfigError("operation")
    own, fields = F.col(into), df.schema[into].dataType.names
    return df.select(
        F.lit(operation).alias("operation"),
        outcome(own["status"]).alias("outcome"),
        F.col(input_col).alias("input"),
        (own["text"] if "text" in fields else F.lit(None).cast("string")).alias("output"),
        (own["findings"] if "findings" in fields else F.lit(None).cast("array<string>")).alias("findings"),
    )
