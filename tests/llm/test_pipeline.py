import corpus_pipeline
from spanveil.llm.common import written

SENTENCE = "the old man and the young woman went to the market near the river and bought some bread with them number {}"


def rows():
    passage = "alpha beta gamma delta epsilon zeta eta theta iota"
    long = " ".join(SENTENCE.format(i) for i in range(12))
    out = [(i, f"unique opening {i} {i * 7} {i * 13} " + " ".join(f"w{i}x{j}" for j in range(30)) + " and the man of the sea\nshared footer line", "en", f"s{i % 2}") for i in range(24)]
    out += [(50, long, "en", "s9"), (51, long + " tail", "en", "s9"), (52, long, "en", "s9"), (53, f"this one has {passage} in it", "en", "s8"), (54, "12345 !!!", "en", "s8"), (55, None, None, None), (50, long, "en", "s9"), (56, "shared footer line", "en", "s0")]
    return [(*r, len(r[1] or "")) for r in out], passage


def test_stages(spark, tmp_path):
    made, passage = rows()
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = written(out, "stage")
        if name == "line dedup":
            cut = {r.doc_id: r for r in docs.collect()}
            assert not cut[3].text.endswith("footer line") and cut[3].n_chars == len(cut[3].text) and cut[56].text == "shared footer line"
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert set(kept["language ID"]) == {*range(24), 50, 51, 52, 53, 56}
    assert kept["line dedup"] == kept["language ID"]
    assert kept["n-gram Jaccard join"] == [*range(24), 50, 53, 56]
    assert kept["benchmark decontamination"] == [*range(24), 50, 56]
    assert set(kept["packing"]) == {*range(24), 50, 56}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_over_a_third_of_a_source(spark, tmp_path):
    import random

    rng = random.Random(7)
    line = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(25))
    base = [line() for _ in range(12)]
    rows = [(i, "\n".join([*(line() for _ in range(6)), *["footer of the site"] * (i % 2)]), "en", "s0", 0) for i in range(600)]
    for i in range(600, 900):
        own = [x.split() for x in base]
        own[rng.randrange(12)][rng.randrange(25)] = f"edit{i}"
        rows.append((i, "\n".join([*map(" ".join, own), "footer of the site"]), "en", "s0", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cut = written(corpus_pipeline.cut_lines(spark, docs, ""), "stage")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(texts[r[0]] == "\n".join(x for x in r[1].split("\n") if not x.startswith("footer")) for r in rows)
    left = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, cut, "").select("doc_id").collect())
    assert left == [*range(601)]


def test_pages_of_boilerplate_lines_only(spark):
    rows = [(i, f"own text of page {i}\nhome\nnews\nlicence", "en", "s0", 0) for i in range(40)]
    rows += [(40, "home\nnews", "en", "s0", 9), (41, "news\n\nlicence", "en", "s0", 13), (42, "licence", "en", "s0", 7)]
    rows += [(50 + i, "one line\nanother line", "en", "s1", 21) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r.doc_id: r for r in corpus_pipeline.cut_lines(spark, docs, "").collect()}
    assert cut[0].text == "own text of page 0" and cut[40].text == "" and cut[40].n_chars == 0 and cut[41].text.strip() == ""
    assert cut[42].text == "licence" and all(cut[50 + i].text == "one line\nanother line" for i in range(5))
