"""Clashing names, repeated and null ids, hot keys and very long values, for every operator and stage."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from spanveil.llm import common, decontamination, fingerprints, language_id, line_dedup, ngram_join, quality, sharding, url_filter

CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, `to` int, part int, `row` string, kept string, place string, line_dedup string, uncut string, `_raw` string, `_hits` string"
MORE = (7, 1, 2, "r", "k", "p", "l", "u", "w", "h")


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or ""), *MORE) for i, t in enumerate(texts)], CLASH)


def test_next_rows_of_hot_and_null_ids(spark):
    rng = np.random.default_rng(5)
    ids = [*rng.integers(-50, 10**6, 60).tolist(), *[500] * 70, *[None] * 40, *[-(2**62), 2**62]]
    rows = [(i, f"t{k}", 1, 2, "x") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "id long, body string, `to` int, part int, `row` string").repartition(3)
    got = fingerprints.with_next(docs, "id", ["body"], range_rows=5, most_ranges=8, most_parts=40).collect()
    assert sorted(r.body for r in got) == sorted(r[1] for r in rows)
    after = {r.body: r.next_body for r in got}
    by_hash = {r.body: r.h for r in docs.select("body", F.xxhash64("body").alias("h")).collect()}
    lined = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, by_hash[r[1]]))
    assert after == {a[1]: b[1] for a, b in zip(lined, [*lined[1:], lined[0]], strict=True)}


def test_stages_keep_clashing_columns(spark, tmp_path):
    words = lambda k: " ".join(f"the word {k} and {j}" for j in range(30))
    docs = clashing(spark, [*(words(i) + "\nthe footer of all pages" for i in range(40)), None, "", "the footer of all pages"])
    spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = common.written(out, "stage")
        assert all(tuple(r)[5:] == MORE for r in docs.collect())
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() >= docs.count() > 0


def test_line_dedup_names_its_column_apart(spark):
    out = line_dedup.clean(clashing(spark, ["a\nb", "a\nc", "a", None]), F.col("source"))
    assert out.columns[-1] == "line_dedup_" and out.count() == 4


def test_scan_with_any_id_columns(spark):
    docs = clashing(spark, ["x one two y", None]).withColumnRenamed("text", "kept_text")
    bench = spark.createDataFrame([("i", "One, two!"), (None, "x"), ("j", None), ("i", "y")], "item_id string, text string")
    names = ["_raw", "_hits", "kept", "row", "to"]
    got = decontamination.scan(docs, bench, names, text_col="kept_text", carry_text=True).orderBy(F.desc("n_words")).collect()
    assert [(r.n_words, r.n_hit, list(r["items"]), r.clean_text, r._raw) for r in got] == [(4, 3, ["i"], "x ", "w"), (0, 0, [], None, "w")]


def test_windows_of_equal_hash_are_told_apart():
    own = decontamination.Windows([("a", b"p q r"), ("b", b"s t u"), ("c", b"p q r")], 3)
    sized = own.sets[3]
    sized.hashes[:] = sized.hashes[0]
    sized.alike = len(sized.hashes)
    own.factor = np.zeros(3, np.uint64)
    sized.hashes[:] = 0
    names = lambda words: [own.names[i] for _, _, items in own.hits(words) for i in items]
    assert names([b"p", b"q", b"r"]) == ["a", "c"] and names([b"s", b"t", b"u"]) == ["b"] and names([b"p", b"t", b"r"]) == []


def test_hot_source_is_dealt_evenly(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 7 == 0, "b").otherwise("a").alias("source"))
    got = sharding.assign(docs, 7, rows_per_bucket=16)
    counts = got.groupBy("shard", "source").count().collect()
    for source in (None, "a", "b"):
        per = [r["count"] for r in counts if r.source == source]
        assert max(per) - min(per) <= 2
    starts = sharding.running_starts(spark.createDataFrame([(s, b, b + 1) for s in ("x", None) for b in range(20)], "s string, b int, n int"), "b", "n", block=3, by="s")
    assert {(r.s, r.b, r.start) for r in starts.collect()} == {(s, b, b * (b + 1) // 2) for s in ("x", None) for b in range(20)}


def test_long_urls_and_repeated_rows(spark):
    long = "http://example.com/" + "a/" * 200_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, "http://" + "b." * 50_000 + "example.com/en/")], "page_id long, url string")
    got = url_filter.judge(pages, [("block", "example.com/en/"), ("allow", "com/")], ["page_id"]).collect()
    assert sorted((r.page_id, r.rule) for r in got) == [(1, "com/"), (1, "com/"), (2, "example.com/en/")]
    docs = spark.createDataFrame([(1, "der die das und"), (1, "der die das und"), (2, None)], "doc_id long, text string")
    profiles = language_id.fit(docs, F.lit("de"), F.col("text"))
    assert sorted((r.doc_id, r.lang_pred) for r in language_id.predict(docs, profiles, F.col("text"), [F.col("doc_id")]).collect()) == [(1, "de"), (1, "de"), (2, "und")]


def test_quality_counts_an_id_once(spark):
    rows = [(i, f"good text number {i} with words" if i % 2 else "x" * (i + 1)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    once = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = quality.train(spark.createDataFrame(rows * 3, "doc_id long, text string"), labels)
    assert all(np.array_equal(a, b) for a, b in zip(once.tables, again.tables, strict=True)) and once.start == again.start


def test_whole_uri_of_the_shared_folder(spark):
    assert common.shared_dir(spark).startswith("file:///")
    assert common.free_name("a", ["A", "a_"]) == "a__" and common.free_name("a", []) == "a"
    assert ngram_join.link_components(clashing(spark, ["a b c d e f", "a b c d e f"])).count() == 2
