"""A training corpus from raw documents, stage by stage; each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import decontamination, language_id, line_dedup, ngram_join, packing
from spanveil.llm.common import free_name, table, written

#: Language scores below this are noise: texts whose letters follow no learned language's frequencies.
LEAST_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or like no learned language, go. A table that names no language rejects nothing."""
    profiles = language_id.fit(docs, F.col("lang"), F.col("text"))
    if not profiles:
        return docs
    judged = language_id.predict(docs, profiles, F.col("text"), [F.struct("*").alias("row")])
    return judged.where((F.col("lang_pred") != language_id.NO_LANGUAGE) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A source's boilerplate lines are cut, and n_chars follows the text. Copies and near copies of a page count once for a line, so a large group of them is left to the next stage. A document whose whole text is one such line stays whole, for the next stage to judge; one of several such lines is left blank."""
    uncut = free_name("uncut", docs.columns)
    given = docs.withColumn(uncut, F.col("text"))
    cleaned = line_dedup.clean(given, F.col("source"), copies_once=True)
    said = F.col(f"`{free_name('line_dedup', given.columns)}`")
    one_line = (F.trim(F.col("text"), F.lit(" \t\r\n")) == "") & (F.size(line_dedup.line_keys(F.col(uncut))) == 1)
    whole = (said["n_cut"] == 0) | one_line
    text = F.when(whole, F.col(uncut)).otherwise(F.col("text"))
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return cleaned.select(*(text.alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 over five-word shingles connect, the one with the smallest id stays, once: of several rows of an id, that whose hash is the least. Rows without an id stay."""
    linked = written(ngram_join.link_components(docs, n=5, near=80, of=100), "linked")
    gone = written(linked.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "near-duplicates")
    kept = docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    if linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1):
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        named = kept.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.min_by(row, F.xxhash64("text", "source", "lang")).alias("row"))
        kept = named.select("row.*").unionByName(kept.where("doc_id is null"))
    return kept


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a full window of a test item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, by sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", cut_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("packing", pack),
]
#: SQL can't express language profiles, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
