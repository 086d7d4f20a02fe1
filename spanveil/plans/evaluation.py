"""Evaluation of findings against annotated records: contract (exact spans), exposure (bytes) and lifecycle (mask, answer, restore)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..operators import guard as gd
from ..operators import masking
from ..operators.detectors import ENTITIES, FINDING, SECRETS
from ..operators.guard import Guard, once, restore

SPAN = ["entity", "start", "end"]
ANNOTATION = "struct<source_label:string,mapped_entity:string,start:int,end:int,disposition:string,reason:string>"
SUPPORTED, UNSUPPORTED, IGNORED = "supported", "unsupported", "ignored"


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def rates(df: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn; 0 where there is nothing to divide by."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rates_of(tp: int, fp: int, fn: int) -> tuple[float, float, float]:
    """precision, recall and F1 of plain counts."""
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def error_rates(df: DataFrame) -> DataFrame:
    """fpr: share of the negative cases with a false positive; fnr: share of the gold that was missed."""
    return df.withColumn("fpr", ratio(F.col("false_positive_cases"), F.col("negative_cases"))).withColumn("fnr", ratio(F.col("fn"), F.col("tp") + F.col("fn")))


def matches(gold: DataFrame, found: DataFrame, record: str = "record") -> DataFrame:
    """record, entity, start, end and kind (tp, fp, fn); doubles on either side count once."""
    keys = [record, *SPAN]
    a = gold.select(*keys).distinct().withColumn("_gold", F.lit(True))
    b = found.select(*keys).distinct().withColumn("_found", F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_gold") & F.col("_found"), "tp").when(F.col("_found"), "fp").otherwise("fn").alias("kind"))


def contract(gold: DataFrame, found: DataFrame, sources: DataFrame | None = None, scope: list[str] | None = None, record: str = "record") -> DataFrame:
    """entity, source, tp, fp, fn and rates: by entity (source null), by source (entity null), and in total (both null).

    `scope` names the entities that count; others are left out on both sides. `sources` has record and source.
    """
    kinds = matches(gold, found, record)
    if scope is not None:
        kinds = kinds.where(F.col("entity").isin(*scope))
    kinds = kinds.join(sources, record, "left") if sources is not None else kinds.withColumn("source", F.lit(None).cast("string"))
    count = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long").alias(k)
    sets = kinds.groupingSets([["entity"], ["source"], []], "entity", "source").agg(count("tp"), count("fp"), count("fn"), F.grouping_id().alias("_g"))
    if sources is None:
        sets = sets.where("_g <> 2")
    total = sets.select(F.when(F.col("_g") == 1, "entity").when(F.col("_g") == 2, "source").otherwise("total").alias("level"), "entity", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return rates(total)


def by_entity(gold: DataFrame, found: DataFrame, records: DataFrame, record: str = "record") -> DataFrame:
    """The first-version report: a row for each built-in entity in any case, with its negative records and those with a false positive."""
    spark = gold.sparkSession
    dim = spark.createDataFrame([(e, i) for i, e in enumerate(ENTITIES)], "entity string, place int")
    kinds = matches(gold, found, record)
    counts = kinds.groupBy("entity").agg(*(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in ("tp", "fp", "fn")))
    held = gold.select(record, "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("with_gold"))
    wrong = kinds.where("kind = 'fp'").select(record, "entity").distinct().join(gold.select(record, "entity").distinct(), [record, "entity"], "left_anti").groupBy("entity").agg(F.count(F.lit(1)).alias("false_positive_cases"))
    n = records.select(record).distinct().count()
    out = dim.join(counts, "entity", "left").join(held, "entity", "left").join(wrong, "entity", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = out.select("entity", "place", zero("tp"), zero("fp"), zero("fn"), (F.lit(n) - F.coalesce("with_gold", F.lit(0))).cast("long").alias("negative_cases"), zero("false_positive_cases"))
    return error_rates(rates(out)).orderBy("place").drop("place")


def record_scopes(suite: DataFrame, record: str = "source_record_id") -> DataFrame:
    """record, entity: what counts in each record. Its declared entities, else those of the suite: declared ones, else those of supported annotations."""
    declared = suite.select(F.col(record).alias("record"), "declared_entities", F.coalesce(F.size("declared_entities") > 0, F.lit(False)).alias("own"))
    named = suite.select(F.explode("annotations").alias("a")).where(F.col("a.disposition") == SUPPORTED).select(F.col("a.mapped_entity").alias("entity"))
    whole = declared.where("own").select(F.explode("declared_entities").alias("entity"))
    any_declared = whole.agg((F.count(F.lit(1)) > 0).alias("any_declared"))
    general = whole.withColumn("d", F.lit(True)).unionByName(named.withColumn("d", F.lit(False))).distinct().crossJoin(F.broadcast(any_declared)).where("d = any_declared").select("entity")  # entities are few
    own = declared.where("own").select("record", F.explode("declared_entities").alias("entity")).distinct()
    rest = declared.where("not own").select("record").crossJoin(F.broadcast(general))
    return own.unionByName(rest)


def contract_suite(suite: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """The contract profile of a suite, each record within its own scope: tables `entities`, `sources`, `overlaps` and `failures`.

    `found` has record, entity, start and end. A record is a negative case of each entity in its scope without gold.
    """
    scopes = record_scopes(suite)
    notes = suite.select(F.col("source_record_id").alias("record"), F.explode("annotations").alias("a")).where(F.col("a.disposition") == SUPPORTED)
    notes = notes.select("record", F.col("a.mapped_entity").alias("entity"), F.col("a.start").alias("start"), F.col("a.end").alias("end"), F.col("a.source_label").alias("source_label"))
    keys = ["record", "entity"]
    gold, seen = notes.join(scopes, keys, "left_semi"), found.select("record", *SPAN).join(scopes, keys, "left_semi")
    kinds = matches(gold, seen)
    count = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0)).alias(k)
    counts = [count(k) for k in ("tp", "fp", "fn")]
    per = kinds.groupBy(keys).agg(*counts, F.max(F.col("kind") != "fp").alias("has_gold"))
    negative = ~F.coalesce("has_gold", F.lit(False))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    entities = scopes.join(per, keys, "left").groupBy("entity").agg(zero("tp"), zero("fp"), zero("fn"), F.count_if(negative).alias("negative_cases"), F.count_if(negative & (F.col("fp") > 0)).alias("false_positive_cases"))
    sources = suite.select(F.col("source_record_id").alias("record"), "source_id").join(per, "record", "left").groupBy("source_id").agg(zero("tp"), zero("fp"), zero("fn"))
    labels = gold.groupBy("record", *SPAN).agg(F.max("source_label").alias("source_label"))
    digests = suite.select(F.col("source_record_id").alias("record"), "input_sha256")
    fn = F.col("kind") == "fn"
    failures = kinds.where("kind <> 'tp'").join(labels, ["record", *SPAN], "left").join(digests, "record")
    failures = failures.select(
        F.col("record").alias("source_record_id"), "source_label", "entity", "kind", F.when(fn, F.col("start")).alias("gold_start"), F.when(fn, F.col("end")).alias("gold_end"),
        F.when(~fn, F.col("start")).alias("predicted_start"), F.when(~fn, F.col("end")).alias("predicted_end"), "input_sha256",
    )
    order = [F.col(c).asc_nulls_last() for c in ("gold_start", "gold_end", "predicted_start", "predicted_end", "source_label")]
    return {
        "entities": error_rates(rates(entities)).orderBy("entity"),
        "sources": rates(sources).orderBy("source_id"),
        "overlaps": overlapping_pairs(gold, seen),
        "failures": failures.orderBy("source_record_id", "entity", "kind", *order),
    }


def overlapping_pairs(gold: DataFrame, found: DataFrame, record: str = "record") -> DataFrame:
    """Gold and found spans of one record and entity that overlap without being equal."""
    a = gold.select(record, "entity", F.col("start").alias("gold_start"), F.col("end").alias("gold_end")).distinct()
    b = found.select(record, "entity", F.col("start").alias("found_start"), F.col("end").alias("found_end")).distinct()
    pairs = a.join(b, [record, "entity"]).where("gold_start < found_end and found_start < gold_end")
    return pairs.where("not (gold_start = found_start and gold_end = found_end)")


def diagnostics(gold: DataFrame, found: DataFrame, record: str = "record") -> DataFrame:
    """False negatives and false positives with their offsets, in report order; the other side's offsets are null."""
    kinds = matches(gold, found, record).where("kind <> 'tp'")
    fn = F.col("kind") == "fn"
    rows = kinds.select(record, "entity", "kind", F.when(fn, F.col("start")).alias("gold_start"), F.when(fn, F.col("end")).alias("gold_end"), F.when(~fn, F.col("start")).alias("found_start"), F.when(~fn, F.col("end")).alias("found_end"))
    return rows.orderBy(record, "entity", "kind", *(F.col(c).asc_nulls_last() for c in ("gold_start", "gold_end", "found_start", "found_end")))


# exposure ------------------------------------------------------------------------------------------------------------

def exposure(records: DataFrame, annotations: str = "annotations", findings: str = "findings") -> DataFrame:
    """`records` and sensitive, covered, leaked, overmatched: bytes of the unions, row by row.

    Supported and unsupported annotations are sensitive, ignored ones aren't; any finding covers, whatever its entity.
    """
    gold = F.filter(F.coalesce(annotations, F.array().cast(f"array<{ANNOTATION}>")), lambda a: a["disposition"] != IGNORED)
    held = records.withColumn("_gold", iv.merge(gold)).withColumn("_found", iv.merge(F.coalesce(findings, F.array().cast(f"array<{FINDING}>"))))
    held = held.withColumn("covered", iv.total_bytes(iv.intersection(F.col("_gold"), F.col("_found"))))
    held = held.withColumn("sensitive", iv.total_bytes(F.col("_gold"))).withColumn("overmatched", iv.total_bytes(F.col("_found")) - F.col("covered"))
    return held.withColumn("leaked", F.col("sensitive") - F.col("covered")).drop("_gold", "_found")


def exposure_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("sensitive", "covered", "leaked", "overmatched")]
    out = rows.groupBy(*(by or [])).agg(*sums)
    return out.withColumn("coverage", ratio(F.col("covered"), F.col("sensitive")))


def exposure_by_label(records: DataFrame, record: str, annotations: str = "annotations", findings: str = "findings") -> DataFrame:
    """By label, entity and disposition: annotations, how many of them are wholly covered, and the bytes of each group's own union.

    What a finding covers beyond all sensitive bytes is overmatched, and counts for an empty label and the finding's entity.
    """
    rows = records.select(record, F.col(findings).alias("_f"), F.explode(annotations).alias("a")).where(F.col("a.disposition") != IGNORED)
    keys = [F.col("a.source_label").alias("source_label"), F.coalesce("a.mapped_entity", F.lit("")).alias("mapped_entity"), F.col("a.disposition").alias("disposition")]
    groups = rows.groupBy(record, *keys).agg(F.collect_list(F.struct(F.col("a.start").alias("start"), F.col("a.end").alias("end"))).alias("spans"), F.first("_f").alias("_f"))
    sized = groups.withColumn("_u", iv.merge(F.col("spans"))).withColumn("_m", iv.merge(F.col("_f")))
    sized = sized.select("source_label", "mapped_entity", "disposition", F.size("spans").alias("n"), F.size(F.filter("spans", lambda s: iv.covered(s, F.col("_m")))).alias("f"), iv.total_bytes(F.col("_u")).alias("s"), iv.total_bytes(iv.intersection(F.col("_u"), F.col("_m"))).alias("c"))
    out = sized.groupBy("source_label", "mapped_entity", "disposition").agg(*(F.sum(a).cast("long").alias(b) for a, b in (("n", "span_count"), ("f", "fully_covered_span_count"), ("s", "sensitive"), ("c", "covered"))))
    out = out.withColumn("leaked", F.col("sensitive") - F.col("covered")).withColumn("overmatched", F.lit(0).cast("long"))
    gold = F.filter(F.coalesce(annotations, F.array().cast(f"array<{ANNOTATION}>")), lambda a: a["disposition"] != IGNORED)
    each = records.select(F.col(findings).alias("all"), iv.merge(gold).alias("g")).select(F.explode("all").alias("f"), "g").select("f.entity", iv.total_bytes(iv.difference(iv.merge(F.array("f")), F.col("g"))).alias("o"))
    none = F.lit(0).cast("long")
    over = each.groupBy("entity").agg(F.sum("o").cast("long").alias("overmatched")).where("overmatched > 0")
    over = over.select(F.lit("").alias("source_label"), F.col("entity").alias("mapped_entity"), F.lit("").alias("disposition"), *(none.alias(c) for c in ("span_count", "fully_covered_span_count", "sensitive", "covered", "leaked")), "overmatched")
    return out.unionByName(over).orderBy("source_label", "mapped_entity", "disposition")


def ignored_counts(records: DataFrame, annotations: str = "annotations") -> DataFrame:
    rows = records.select(F.inline(annotations)).where(F.col("disposition") == IGNORED)
    return rows.groupBy("source_label", "reason").agg(F.count(F.lit(1)).alias("count")).orderBy("source_label", "reason")


# lifecycle -----------------------------------------------------------------------------------------------------------

def expectation(annotations: Column, action: Column, recipe: Column) -> tuple[Column, Column]:
    """What a record says, else block if a secret is annotated, else mask and an identical answer; null for nothing to do."""
    kinds = F.transform(F.filter(annotations, lambda a: a["disposition"] == SUPPORTED), lambda a: a["mapped_entity"])
    secret = F.exists(kinds, lambda e: e.isin(*SECRETS))
    own = F.coalesce(action, F.when(secret, gd.BLOCK).when(F.size(kinds) > 0, gd.MASK))
    return own, F.coalesce(recipe, F.lit("identity"))


def answer(masked: Column, tokens: Column, recipe: Column) -> Column:
    """The response that a recipe makes of the masked text: itself; its first known token with another last digit; without it; with a foreign token before it."""
    known = F.transform(tokens, lambda t: t["token"])
    first = F.try_element_at(F.filter(F.regexp_extract_all(masked, F.lit(masking.TOKEN), F.lit(0)), lambda t: F.array_contains(known, t)), F.lit(1))
    cut = F.length(first) - len(masking.SUFFIX)
    last = F.when(F.substring(first, cut, F.lit(1)) == "0", F.lit("1")).otherwise(F.lit("0"))
    other = F.concat(F.substring(first, F.lit(1), cut - 1), last, F.lit(masking.SUFFIX))
    at = F.call_function("locate", first, masked)
    swap = lambda new: F.concat(F.substring(masked, F.lit(1), at - 1), new, F.substring(masked, at + F.length(first), F.length(masked)))
    foreign = F.concat(F.lit(masking.PREFIX + "0" * 32 + "_0001" + masking.SUFFIX), masked)
    changed = F.when(recipe == "mutate_placeholder", swap(other)).when(recipe == "delete_placeholder", swap(F.lit("")))
    return F.when(recipe == "collision", foreign).when(first.isNull() | (recipe == "identity"), masked).otherwise(changed)


def lifecycle(records: DataFrame, guard: Guard, row_key: str, text_col: str = "input") -> DataFrame:
    """row_key, action, recipe, outcome (ok, blocked, mutation_miss, restore_miss, error, skipped), reason and the input's SHA-256, row by row.

    `records` has annotations and may have lifecycle<expected_action, response_recipe>.
    """
    plan = F.col("lifecycle") if "lifecycle" in records.columns else F.lit(None).cast("struct<expected_action:string,response_recipe:string>")
    action, recipe = expectation(F.col("annotations"), plan["expected_action"], plan["response_recipe"])
    held = guard.mask(records.withColumn("_plan", plan).withColumns({"_action": action, "_recipe": recipe}), row_key, text_col, "_m")
    held = held.withColumns({"_text": F.col("_m.text"), "_tokens": F.col("_m.tokens"), "_status": F.col("_m.status")})
    raw = F.col(text_col).cast("binary")
    values = F.transform(F.filter("annotations", lambda a: a["disposition"] == SUPPORTED), lambda a: F.substring(raw, a["start"] + 1, a["end"] - a["start"]).cast("string"))
    held = held.withColumn("_leak", F.exists(values, lambda v: F.contains(F.col("_text"), v))).withColumn("_answer", answer(F.col("_text"), F.col("_tokens"), F.col("_recipe")))
    masked = F.filter("_m.findings", lambda f: guard.action(f["entity"]) == gd.MASK)
    held = held.withColumn("_pairs", masking.placeholder_map(F.col(text_col), F.col("_text"), masked))
    held = restore(held, "_answer", "_tokens", "_r").withColumn("_back", F.col("_r.text"))
    same, mask = F.col("_recipe") == "identity", F.col("_action") == gd.MASK
    outcome = (
        F.when(F.col("_action").isNull(), F.struct(F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("reason")))
        .when(~F.col("_action").isin(gd.MASK, gd.BLOCK), F.struct(F.lit("error").alias("outcome"), F.lit("unknown action").alias("reason")))
        .when(~mask & (F.col("_status") == gd.BLOCKED), F.struct(F.lit("blocked").alias("outcome"), F.lit(None).cast("string").alias("reason")))
        .when(~mask, F.struct(F.lit("error").alias("outcome"), F.lit("not blocked").alias("reason")))
        .when(F.col("_status") != gd.OK, F.struct(F.lit("error").alias("outcome"), F.lit("mask failed").alias("reason")))
        .when(F.col("_leak"), F.struct(F.lit("error").alias("outcome"), F.lit("leak").alias("reason")))
        .when(F.col("_pairs").isNull(), F.struct(F.lit("error").alias("outcome"), F.lit("placeholders don't align").alias("reason")))
        .when(same & (F.col("_back") == F.col(text_col)), F.struct(F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("reason")))
        .when(same, F.struct(F.lit("restore_miss").alias("outcome"), F.lit("not restored").alias("reason")))
        .when((F.col("_answer") != F.col("_text")) & (F.col("_back") != F.col(text_col)), F.struct(F.lit("mutation_miss").alias("outcome"), F.lit(None).cast("string").alias("reason")))
        .otherwise(F.struct(F.lit("restore_miss").alias("outcome"), F.lit("recipe changed nothing").alias("reason")))
    )
    return held.select(F.col(row_key), F.col("_action").alias("action"), F.col("_recipe").alias("recipe"), F.sha2(raw, 256).alias("input_sha256"), once(outcome).alias("o")).select(row_key, "action", "recipe", "o.*", "input_sha256")


def lifecycle_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("count"), F.sum(F.when(F.col("reason").isNotNull(), 1).otherwise(0)).cast("long").alias("diagnostics")).orderBy("outcome")
