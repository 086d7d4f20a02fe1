"""Annotated suites: strict JSON lines in, JSON lines out; annotation files of other shapes; digests.

A line with an unknown field, text after its object, or a broken rule gets a reason in column `error`; load() raises
if any row has one. Nothing is inferred, and no message holds a record's text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detectors import ENTITIES
from ..operators.errors import SuiteError
from ..plans.evaluation import ANNOTATION, IGNORED, SUPPORTED, UNSUPPORTED

EXPECTED = "struct<entity:string,start:int,end:int>"
CASE = f"struct<schema_version:int,id:string,category:string,input:string,expected:array<{EXPECTED}>>"
SUITE = (
    "struct<schema_version:int,suite_id:string,source_id:string,source_record_id:string,mapping_version:string,input:string,input_sha256:string,"
    f"annotations:array<{ANNOTATION}>,declared_entities:array<string>,lifecycle:struct<expected_action:string,response_recipe:string>>"
)
FIELDS = {
    "case": ["schema_version", "id", "category", "input", "expected"],
    "suite": ["schema_version", "suite_id", "source_id", "source_record_id", "mapping_version", "input", "input_sha256", "annotations", "declared_entities", "lifecycle"],
}
INNER = {"annotations": ["source_label", "mapped_entity", "start", "end", "disposition", "reason"], "expected": ["entity", "start", "end"]}
#: Fixed value: bytes that a line may have.
MOST_LINE_BYTES = 1 << 20
ACTIONS, RECIPES = ("mask", "block", "allow"), ("identity", "mutate_placeholder", "delete_placeholder", "collision")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def span_wrong(s: Column, raw: Column) -> Column:
    """Out of bounds, or cutting a character."""
    cut = lambda at: (at < F.octet_length(raw)) & F.hex(F.substring(raw, at + 1, F.lit(1))).between("80", "BF")
    return s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.octet_length(raw)) | cut(s["start"]) | cut(s["end"])


def annotation_error(a: Column, raw: Column) -> Column:
    kind, entity, reason = a["disposition"], F.coalesce(a["mapped_entity"], F.lit("")), F.coalesce(a["reason"], F.lit(""))
    return (
        F.when(blank(a["source_label"]), "source_label is empty")
        .when(kind.isNull() | ~kind.isin(SUPPORTED, UNSUPPORTED, IGNORED), "unknown disposition")
        .when((kind == IGNORED) & (F.trim(reason) == ""), "ignored disposition requires reason")
        .when((kind == SUPPORTED) & (entity == ""), "supported disposition requires mapped_entity")
        .when((kind != IGNORED) & (entity != "") & ~entity.isin(*ENTITIES), "unknown mapped_entity")
        .when((kind != IGNORED) & (reason != ""), "reason must be empty")
        .when(span_wrong(a, raw), "span")
    )


def _strict(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    """line, r (the record, null if it isn't one) and error of lines that aren't blank."""
    line = F.col("line")
    keys = F.json_object_keys(line)
    extra = F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*(F.lit(x) for x in FIELDS[kind])))) > 0
    inner_of = "annotations" if kind == "suite" else "expected"
    parts = F.from_json(F.get_json_object(line, f"$.{inner_of}"), "array<map<string,string>>")
    inner = F.exists(F.coalesce(parts, F.array().cast("array<map<string,string>>")), lambda m: F.size(F.array_except(F.map_keys(m), F.array(*(F.lit(x) for x in INNER[inner_of])))) > 0)
    read = lines.where(F.trim(line) != "").withColumn("r", F.from_json(line, schema))
    return read.withColumn("error", F.when(keys.isNull() | ~one_object(line) | F.col("r.schema_version").isNull(), "not a JSON object").when(extra | inner, "unknown field").when(F.octet_length(line) > MOST_LINE_BYTES, "line is too long"))


def is_object(line: str | None) -> bool:
    try:
        return isinstance(json.loads(line or ""), dict)
    except ValueError:
        return False


def one_object(line: Column) -> Column:
    """Whether a line is one JSON object with nothing after it. Spark's own parsers stop at an object's end, so this asks one that doesn't."""

    @F.pandas_udf("boolean")
    def whole(lines: pd.Series) -> pd.Series:
        return lines.map(is_object).astype(bool)

    return whole(line)


def case_rows(lines: DataFrame) -> DataFrame:
    """First-version cases of column `line`: the record's fields and error."""
    read = _strict(lines, "case", CASE)
    raw, spans = F.col("r.input").cast("binary"), F.coalesce(F.col("r.expected"), F.array().cast(f"array<{EXPECTED}>"))
    n, kinds, category = F.size(spans), F.size(F.array_distinct(F.transform(spans, lambda s: s["entity"]))), F.col("r.category")
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("r.schema_version") != 1, "unsupported schema_version")
        .when(blank(F.col("r.id")), "id is empty")
        .when(category.isNull() | ~category.isin("positive", "negative", "mixed"), "unknown category")
        .when((category == "positive") & (n == 0) | (category == "negative") & (n > 0) | (category == "mixed") & (kinds < 2), "expected doesn't fit the category")
        .when(F.exists(spans, lambda s: F.coalesce(~s["entity"].isin(*ENTITIES), F.lit(True))), "unknown entity")
        .when(F.exists(spans, lambda s: span_wrong(s, raw)), "span")
        .when(F.size(F.array_distinct(spans)) < n, "duplicate span")
    )
    return read.select("r.*", error.alias("error"))


def suite_rows(lines: DataFrame) -> DataFrame:
    """Second-version records of column `line`: the record's fields and error."""
    read = _strict(lines, "suite", SUITE)
    raw, notes = F.col("r.input").cast("binary"), F.coalesce(F.col("r.annotations"), F.array().cast(f"array<{ANNOTATION}>"))
    plan = F.col("r.lifecycle")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("r.schema_version") != 2, "unsupported schema_version")
    for name in ("suite_id", "source_id", "source_record_id", "mapping_version"):
        error = error.when(blank(F.col(f"r.{name}")), f"{name} is empty")
    first = F.try_element_at(F.filter(F.transform(notes, lambda a: annotation_error(a, raw)), lambda e: e.isNotNull()), F.lit(1))
    places = F.transform(notes, lambda a: F.struct(a["source_label"], a["start"], a["end"]))
    error = (
        error.when(F.col("r.input").isNull() | ~F.is_valid_utf8("r.input"), "input")
        .when(F.coalesce(F.col("r.input_sha256"), F.lit("")) != F.sha2(raw, 256), "input_sha256 mismatch")
        .when(first.isNotNull(), first)
        .when(F.size(F.array_distinct(places)) < F.size(notes), "duplicate annotation")
        .when(plan.isNotNull() & ~F.coalesce(plan["expected_action"].isin(*ACTIONS), F.lit(False)), "unknown expected_action")
        .when(plan["response_recipe"].isNotNull() & ~plan["response_recipe"].isin("", *RECIPES), "unknown response_recipe")
        .when(F.exists(F.coalesce("r.declared_entities", F.array().cast("array<string>")), lambda e: ~e.isin(*ENTITIES)), "declared_entities")
    )
    return read.select("r.*", error.alias("error"))


def _load(rows: DataFrame, key: str, uniform: list[str]) -> DataFrame:
    wrong = rows.where("error is not null").select("error").limit(1).collect()
    if wrong:
        raise SuiteError(wrong[0].error)
    total = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(c).alias(c) for c in uniform)).head()
    if not total.n:
        raise SuiteError("the suite is empty")
    if any(total[c] > 1 for c in uniform):
        raise SuiteError("suite_id and mapping_version must be one each")
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise SuiteError(f"duplicate {key}")
    return rows.drop("error")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def load_cases(spark: SparkSession, path: str, full_coverage: bool = True) -> DataFrame:
    rows = _load(case_rows(lines_of(spark, path)), "id", [])
    if full_coverage and coverage(rows).where("not (has_positive and has_negative)").limit(1).count():
        raise SuiteError("an entity has no positive or no negative case")
    return rows


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    return _load(suite_rows(lines_of(spark, path)), "source_record_id", ["suite_id", "mapping_version"])


def write_suite(suite: DataFrame, path: str) -> None:
    """JSON lines; nulls are left out. A failed write leaves no part file that counts."""
    suite.write.mode("overwrite").json(path)


def coverage(cases: DataFrame) -> DataFrame:
    """entity, has_positive, has_negative: whether a case has it, and whether one has not."""
    spark = cases.sparkSession
    held = cases.select("id", F.explode("expected").alias("s")).select("id", "s.entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("k"))
    n = cases.count()
    dim = spark.createDataFrame([(e, i) for i, e in enumerate(ENTITIES)], "entity string, place int")
    out = dim.join(held, "entity", "left")
    return out.select("entity", (F.coalesce("k", F.lit(0)) > 0).alias("has_positive"), (F.coalesce("k", F.lit(0)) < n).alias("has_negative"), "place").orderBy("place").drop("place")


def scope_of(suite: DataFrame) -> list[str]:
    """Declared entities, else those of supported annotations; by name."""
    declared = suite.select(F.explode("declared_entities").alias("e")).distinct()
    named = suite.select(F.explode("annotations").alias("a")).where(F.col("a.disposition") == SUPPORTED).select(F.col("a.mapped_entity").alias("e")).distinct()
    own = sorted(r.e for r in declared.collect())
    return own or sorted(r.e for r in named.collect())


def gold_spans(suite: DataFrame, record: str = "source_record_id") -> DataFrame:
    notes = suite.select(F.col(record).alias("record"), F.explode("annotations").alias("a")).where(F.col("a.disposition") == SUPPORTED)
    return notes.select("record", F.col("a.mapped_entity").alias("entity"), F.col("a.start").alias("start"), F.col("a.end").alias("end"))


# other annotation shapes ------------------------------------------------------------------------------------------------

def read_token_tags(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of text, tokens and ner_tags (JSON arrays): record, text, tokens, tags. Missing columns are an error."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    if not {"text", "tokens", "ner_tags"} <= set(rows.columns):
        raise SuiteError("the header needs text, tokens and ner_tags")
    listed = lambda c: F.from_json(c, "array<string>")
    return rows.select(F.monotonically_increasing_id().alias("record"), F.coalesce("text", F.lit("")).alias("text"), listed("tokens").alias("tokens"), listed("ner_tags").alias("tags"))


def align_tags(text: str, tokens: list[str] | None, tags: list[str] | None) -> list[tuple[str, int, int]] | None:
    """Byte spans of runs of tags (B-X I-X ...; a lone I-X starts one, too); None if the tokens can't be found one after another."""
    if tokens is None or tags is None or len(tokens) != len(tags):
        return None
    at, runs, open_ = 0, [], None
    for token, tag in zip(tokens, tags, strict=True):
        while at < len(text) and text[at].isspace():
            at += 1
        if not text.startswith(token, at):
            return None
        start, at = at, at + len(token)
        base = tag[2:] if tag[:2] in ("B-", "I-") else tag
        if tag in ("O", ""):
            open_ = None
        elif open_ and tag.startswith("I-") and open_[0] == base:
            open_[2] = at
        else:
            open_ = [base, start, at]
            runs.append(open_)
    return [(label, len(text[:a].encode()), len(text[:b].encode())) for label, a, b in runs]


def token_tag_spans(rows: DataFrame) -> DataFrame:
    """record, text, spans (label, start, end), aligned."""
    @F.pandas_udf("struct<spans:array<struct<label:string,start:int,end:int>>,aligned:boolean>")
    def align(text: pd.Series, tokens: pd.Series, tags: pd.Series) -> pd.DataFrame:
        found = [align_tags(a, None if b is None else list(b), None if c is None else list(c)) for a, b, c in zip(text, tokens, tags, strict=True)]
        return pd.DataFrame({"spans": [[{"label": x, "start": s, "end": e} for x, s, e in f or []] for f in found], "aligned": [f is not None for f in found]})

    return rows.withColumn("a", align("text", "tokens", "tags")).select("record", "text", "a.*")


def read_standoff(spark: SparkSession, root: str) -> DataFrame:
    """Documents of <stem>.txt, .spans and .objects under `root`: stem, text, spans<id,type,start,end (bytes)>, objects<id,type,span_ids>.

    Spans are given as code points from a start; lines with fewer than four fields don't count.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,spans,objects}").select("value", F.col("_metadata.file_path").alias("path"))
    files = files.where(~F.col("path").endswith("/list.txt")).withColumn("stem", F.regexp_replace("path", r"\.[a-z]+$", "")).withColumn("ext", F.regexp_extract("path", r"\.([a-z]+)$", 1))
    part = lambda ext, name: files.where(F.col("ext") == ext).select("stem", F.col("value").alias(name))
    docs = part("txt", "text").join(part("spans", "s"), "stem", "left").join(part("objects", "o"), "stem", "left")
    fields = lambda line: F.split(F.trim(line), r"\s+")
    span_rows = F.filter(F.transform(F.split(F.coalesce("s", F.lit("")), "\n"), fields), lambda f: F.size(f) >= 4)
    byte = lambda n: F.octet_length(F.substring(F.col("text"), F.lit(1), n))
    spans = F.transform(span_rows, lambda f: F.struct(f[0].alias("id"), f[1].alias("type"), byte(F.expr("1") * f[2].try_cast("int")).alias("start"), byte(f[2].try_cast("int") + f[3].try_cast("int")).alias("end")))
    object_rows = F.filter(F.transform(F.split(F.coalesce("o", F.lit("")), "\n"), lambda x: fields(F.substring_index(x, "#", 1))), lambda f: F.size(f) >= 3)
    objects = F.transform(object_rows, lambda f: F.struct(f[0].alias("id"), f[1].alias("type"), F.slice(f, 3, F.size(f)).alias("span_ids")))
    return docs.select("stem", "text", F.filter(spans, lambda x: x["start"].isNotNull() & x["end"].isNotNull()).alias("spans"), objects.alias("objects"))


def object_spans(docs: DataFrame) -> DataFrame:
    """stem, object, kind and its spans in order; ids without a span are skipped."""
    spans = docs.select("stem", F.inline("spans")).withColumnRenamed("id", "span_id").withColumnRenamed("type", "span_type")
    held = docs.select("stem", F.explode("objects").alias("o")).select("stem", F.col("o.id").alias("object"), F.col("o.type").alias("kind"), F.explode("o.span_ids").alias("span_id"))
    return held.join(spans, ["stem", "span_id"]).groupBy("stem", "object", "kind").agg(F.sort_array(F.collect_list(F.struct("start", "end", "span_type"))).alias("spans"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def tree_digest(spark: SparkSession, root: str) -> str:
    """SHA-256 over the files' relative paths and bytes, by path, each followed by a zero byte; for trees of a fixture's size."""
    import hashlib

    total = hashlib.sha256()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    for r in sorted(rows.collect(), key=lambda r: r.path):
        total.update(r.path.split(base, 1)[-1].lstrip("/").encode() + b"\0" + bytes(r.content) + b"\0")
    return total.hexdigest()


def verify_digest(spark: SparkSession, path: str, sha256: str) -> None:
    found = [r.sha256 for r in file_digests(spark, path).collect()]
    if found != [sha256]:
        raise SuiteError("digest mismatch")


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"token_tags": lambda s, p: token_tag_spans(read_token_tags(s, p)), "standoff": read_standoff, "suite": load_suite, "cases": load_cases}
