"""The guard: detectors and a policy, applied to a text column of any batch or streaming DataFrame."""

from __future__ import annotations

import re
import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import masking
from .detectors import ENTITIES, FINDING, RAW, SECRETS, Detector, builtin, scanning
from .errors import ConfigError
from .resolve import bucket, ordered, resolve, span_error

ALLOW, MASK, BLOCK = "allow", "mask", "block"
ACTIONS = (ALLOW, MASK, BLOCK)
OK, INVALID_TEXT, DETECTOR_ERROR, BLOCKED, COLLISION, RESTORE_MISS, NO_TOKENS = "success", "invalid_text", "detector_error", "blocked", "namespace_collision", "restore_miss", "invalid_token_set"
NONE = f"array<{FINDING}>"


def once(column: Column) -> Column:
    """The same column, behind a condition that the optimiser can't fold: filters above aren't copied below it with all that it is made of."""
    return F.when(F.rand() >= 0, column)


@dataclass(frozen=True)
class Guard:
    """Immutable. Secrets are blocked and everything else is masked unless the policy says otherwise.

    `key` names the masking key; without one a fresh key is drawn, so that tokens can't be told but two runs differ.
    """

    detectors: tuple[Detector, ...]
    secret_action: str = BLOCK
    entity_actions: dict[str, str] = field(default_factory=dict)
    key: str = field(default_factory=lambda: secrets.token_hex(32), repr=False)

    def __post_init__(self):
        object.__setattr__(self, "detectors", tuple(self.detectors))
        object.__setattr__(self, "entity_actions", dict(self.entity_actions))
        if any(not isinstance(d, Detector) for d in self.detectors):
            raise ConfigError("detector")
        names = [d.name for d in self.detectors]
        if len(set(names)) < len(names):
            raise ConfigError("duplicate detector name")
        if self.secret_action not in ACTIONS or any(a not in ACTIONS for a in self.entity_actions.values()):
            raise ConfigError("unknown action")
        if any(not e.strip() for e in self.entity_actions):
            raise ConfigError("policy entity")
        if not self.key:
            raise ConfigError("masking key")

    @classmethod
    def full(cls, **more) -> Guard:
        """All sixteen built-in detectors."""
        return cls(tuple(builtin()), **more)

    # columns -------------------------------------------------------------------------------------------------------

    def action(self, entity: Column) -> Column:
        """The policy: the entity's own action, else the secrets' action, else mask."""
        out = F.when(entity.isin(*SECRETS), F.lit(self.secret_action)).otherwise(F.lit(MASK))
        if self.entity_actions:
            table = F.create_map(*(F.lit(x) for pair in self.entity_actions.items() for x in pair))
            out = F.coalesce(F.try_element_at(table, entity), out)
        return out

    def _finding(self, raw: Column) -> Column:
        table = F.array(*(F.struct(F.lit(d.entity).alias("entity"), F.lit(float(d.confidence)).alias("confidence"), F.lit(d.name).alias("detector")) for d in self.detectors))
        own = F.get(table, raw["reg"])
        return F.struct(own["entity"].alias("entity"), raw["start"].alias("start"), raw["end"].alias("end"), own["confidence"].alias("confidence"), own["detector"].alias("detector"))

    # tables --------------------------------------------------------------------------------------------------------

    def detect(self, df: DataFrame, text_col: str = "text", into: str = "detected") -> DataFrame:
        """`df` and struct `into`: findings in order, status, and which detector failed in which field.

        A row that isn't valid UTF-8, or in which a detector fails, has no findings at all. A null text has none either.
        """
        text = F.col(text_col)
        valid = F.coalesce(F.is_valid_utf8(text), F.lit(True))
        empty = F.array().cast(RAW)
        scans = [(i, d) for i, d in enumerate(self.detectors) if d.scan]
        natives = [(i, d) for i, d in enumerate(self.detectors) if d.spans]
        held = df
        if scans:
            # a bit for each scan whose hint a row has; rows without any reach Python as nulls
            held = held.withColumn("_sv_asked", F.when(valid & text.isNotNull(), asked(text, [d.hint for _, d in scans])).otherwise(0))
            held = held.withColumn("_sv_scanned", scanning(scans)(F.when(F.col("_sv_asked") > 0, text), F.col("_sv_asked")))
        parts = [F.coalesce(F.col("_sv_scanned.found"), empty)] if scans else []
        for i, d in natives:
            own = F.transform(d.spans(text), _raw(i))
            parts.append(F.when(valid & text.rlike(d.hint), own).otherwise(empty) if d.hint else F.when(valid, own).otherwise(empty))
        found = F.concat(*parts) if parts else empty
        held = held.withColumn("_sv_found", F.when(text.isNull(), empty).otherwise(found))
        keyed = F.transform(
            F.col("_sv_found"),
            lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), self._finding(r)["entity"].alias("entity"), self._finding(r)["detector"].alias("detector"), (-self._finding(r)["confidence"]).alias("c"), r["reg"].alias("reg"), r["local"].alias("local")),
        )
        failed = F.col("_sv_scanned.failed") if scans else F.lit(None).cast("int")
        field = F.col("_sv_scanned.field") if scans else F.lit(None).cast("string")
        doubted = [(i, d) for i, d in natives if not d.sure]
        if doubted:  # the first detector that fails is named
            raw = text.cast("binary")
            wrong = lambda i: F.array_compact(F.transform(F.filter("_sv_found", lambda r: r["reg"] == i), lambda r: span_error(r, raw)))
            marks = F.array(*(F.struct(F.lit(i).alias("reg"), F.get(wrong(i), F.lit(0)).alias("field")) for i, _ in doubted), *([F.struct(F.col("_sv_scanned.failed").alias("reg"), F.col("_sv_scanned.field").alias("field"))] if scans else []))
            held = held.withColumn("_sv_wrong", F.get(F.array_sort(F.filter(marks, lambda m: m["field"].isNotNull())), F.lit(0)))
            failed, field = F.col("_sv_wrong.reg"), F.col("_sv_wrong.field")
        names = F.array(*(F.lit(d.name) for d in self.detectors)) if self.detectors else F.array(F.lit(""))
        findings = F.transform(
            F.array_sort(keyed), lambda k: F.struct(k["entity"].alias("entity"), k["start"].alias("start"), k["end"].alias("end"), (-k["c"]).alias("confidence"), k["detector"].alias("detector"))
        ).cast(NONE)
        status = F.when(~valid, INVALID_TEXT).when(failed.isNotNull(), DETECTOR_ERROR).otherwise(OK)
        held = held.withColumn("_sv_status", status)
        out = F.struct(
            F.when((F.col("_sv_status") == OK) & (F.size("_sv_found") > 0), findings).otherwise(F.array().cast(NONE)).alias("findings"),
            F.col("_sv_status").alias("status"),
            F.get(names, failed).alias("error_detector"),
            field.alias("error_field"),
        )
        return held.withColumn(into, once(out)).select(*(F.col(c) for c in df.columns if c != into), into)

    def findings_table(self, df: DataFrame, keys: list[str], text_col: str = "text", resolved: bool = False) -> DataFrame:
        """One row per finding: keys, entity, start, end, confidence, detector. The text doesn't come along."""
        found = self.detect(df.select(*dict.fromkeys([*keys, text_col])), text_col).select(*keys, F.col("detected.findings").alias("_sv_findings"))
        spans = F.col("_sv_findings")
        return found.select(*keys, F.inline(resolve(spans) if resolved else spans))

    def mask(self, df: DataFrame, row_key: str | Column, text_col: str = "text", into: str = "masked") -> DataFrame:
        """`df` and struct `into`: text, findings (resolved), tokens, status.

        A row with a finding whose action is block, or that failed, has null text and nothing else. Without findings, or
        with allowed ones only, the text is as it was. `row_key` tells rows apart; rows of equal key share name spaces.
        """
        text, raw = F.col(text_col), F.col(text_col).cast("binary")
        # each step is a column of its own: a struct's fields would be computed anew wherever they are named
        held = self.detect(df, text_col, "_sv_detected").withColumns({"_sv_findings": F.col("_sv_detected.findings"), "_sv_seen": F.col("_sv_detected.status")}).drop("_sv_detected")
        held = held.withColumn("_sv_resolved", resolve(F.col("_sv_findings")))
        held = held.withColumn("_sv_masked", F.filter("_sv_resolved", lambda f: self.action(f["entity"]) == MASK))
        key = row_key if isinstance(row_key, Column) else F.col(row_key)
        some = F.size("_sv_masked") > 0
        held = held.withColumn("_sv_space", F.when(some, masking.namespace(text, self.key, key, F.size("_sv_masked"))))
        held = held.withColumn("_sv_tokens", F.when(some & F.col("_sv_space").isNotNull(), masking.token_list(raw, F.col("_sv_masked"), F.col("_sv_space"))).otherwise(F.array().cast(masking.TOKENS)))
        blocks = F.exists("_sv_resolved", lambda f: self.action(f["entity"]) == BLOCK)
        held = held.withColumn("_sv_status", F.when(F.col("_sv_seen") != OK, F.col("_sv_seen")).when(blocks, BLOCKED).when(some & F.col("_sv_space").isNull(), COLLISION).otherwise(OK))
        good = F.col("_sv_status") == OK
        out = F.struct(
            F.when(good & some, masking.rebuilt(raw, F.col("_sv_masked"), F.col("_sv_tokens"))).when(good, text).alias("text"),
            F.when(good, F.col("_sv_resolved")).otherwise(F.array().cast(NONE)).alias("findings"),
            F.when(good, F.col("_sv_tokens")).otherwise(F.array().cast(masking.TOKENS)).alias("tokens"),
            F.col("_sv_status").alias("status"),
        )
        return held.withColumn(into, once(out)).select(*(F.col(c) for c in df.columns if c != into), into)


def _raw(reg: int):
    return lambda s, k: F.struct(F.lit(reg).alias("reg"), k.alias("local"), s["start"].alias("start"), s["end"].alias("end"))


def asked(text: Column, hints: list[str | None]) -> Column:
    """A bit for each hint that a text has; no hint is always had. Equal hints are looked for once, words by a plain search."""
    out = F.lit(0)
    for h in dict.fromkeys(hints):
        bits = sum(1 << k for k, x in enumerate(hints) if x == h)
        words = None if h is None else h.split("|")
        if h is None:
            out = out + F.lit(bits)
            continue
        has = _any_word(text, words) if all(re.fullmatch(r"[\w@:/ -]+", w) for w in words) else text.rlike(h)
        out = out + F.when(has, F.lit(bits)).otherwise(F.lit(0))
    return out


def _any_word(text: Column, words: list[str]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def restore(df: DataFrame, response_col: str, tokens_col: str, into: str = "restored") -> DataFrame:
    """`df` and struct `into`: text, misses, status. A null token set, or a response that isn't UTF-8, is an error with null text."""
    held = df.withColumns({"_sv_response": F.col(response_col), "_sv_tokens": F.col(tokens_col)})
    text, tokens = F.col("_sv_response"), F.col("_sv_tokens")
    held = held.withColumn("_sv_hits", masking.hits_of(text, F.coalesce(tokens, F.array().cast(masking.TOKENS))))
    held = held.withColumn("_sv_misses", masking.misses(F.col("_sv_hits")))
    status = F.when(tokens.isNull(), NO_TOKENS).when(~F.coalesce(F.is_valid_utf8(text), F.lit(True)), INVALID_TEXT).when(F.col("_sv_misses") > 0, RESTORE_MISS).otherwise(OK)
    held = held.withColumn("_sv_status", status)
    good = F.col("_sv_status").isin(OK, RESTORE_MISS)
    out = F.struct(F.when(good, masking.restored(text, tokens, F.col("_sv_hits"))).alias("text"), F.when(good, F.col("_sv_misses")).alias("misses"), F.col("_sv_status").alias("status"))
    return held.withColumn(into, once(out)).drop("_sv_response", "_sv_tokens", "_sv_hits", "_sv_misses", "_sv_status")


def entity_counts(findings: Column) -> Column:
    """Per row: entity (CUSTOM for the caller's) and count, by entity."""
    names = F.transform(findings, lambda f: bucket(f["entity"]))
    return F.transform(F.array_sort(F.array_distinct(names)), lambda e: F.struct(e.alias("entity"), F.size(F.filter(names, lambda x: x == e)).alias("count")))


__all__ = ["ACTIONS", "ALLOW", "BLOCK", "ENTITIES", "MASK", "Guard", "entity_counts", "ordered", "restore"]
