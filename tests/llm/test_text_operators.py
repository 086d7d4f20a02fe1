import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.llm import decontamination as dc
from spanveil.llm import fingerprints as fp
from spanveil.llm import language_id as li
from spanveil.llm import line_dedup as ld
from spanveil.llm import quality, sharding


# decontamination ---------------------------------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, n=8):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        want = words(item)
        size = min(n, len(want))
        for k in range(len(want) - size + 1 if size else 0):
            for a in range(len(own) - size + 1):
                if own[a : a + size] == want[k : k + size]:
                    hit |= set(range(a, a + size))
                    found.add(name)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [32 << 20, 300])
def test_scan_against_brute_force(spark, part_bytes):
    rng = random.Random(4)
    vocabulary = ["a", "B", "ça", "über", "x1", "The", "of", "日本"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(str(i), say(rng.choice([1, 5, 8, 12]))) for i in range(12)] + [("n", ""), ("m", None), ("twin", "q w e r t y u i o"), ("twin2", "q w e r t y u i o")]
    texts = [say(rng.randint(0, 40)) for _ in range(30)] + [f"x {items[i][1]} y" for i in range(12)] + [None, "", "...", "q W e-r t y u i o p"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in dc.scan(docs, bench, ["doc_id"], part_bytes=part_bytes).collect()}
    known = [(a, b) for a, b in items if b]
    assert got == {i: brute_hits(t, known) for i, t in enumerate(texts)}


def test_decontaminate(spark):
    passage = "one two three four five six seven eight"
    rows = [(1, f"Start. {passage}! End", "k"), (2, "clean text", "k"), (3, None, None), (1, f"Start. {passage}! End", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame([(1, passage), (2, "clean")], "item_id long, text string")
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, "spans").collect()}
    assert cut == {1: "Start. ! End", 2: "clean text", 3: None}
    assert dc.decontaminate(docs, bench.limit(0)).count() == 4
    assert dc.decontaminate(docs.limit(0), bench).count() == 0


# fingerprints ------------------------------------------------------------------------------------------------------

def test_edit_and_neighbours(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta", "éé日", "", None, "x y", "one two three four five six seven eight nine ten"]
    rows = [(10 * i, t, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edited string").repartition(3)
    got = {r.doc_id: r for r in fp.compare_with_edit(docs).collect()}
    assert len(got) == len(rows)
    for i, (name, text, _) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        moved = len(text) // 4
        edited = text[: len(text) - moved] + after[:moved]
        assert (got[name].n_chars, got[name].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[name].near_edited <= 1 and 0 <= got[name].near_next <= 1
    assert got[20].fingerprint == got[30].fingerprint and got[20].near_next == 1.0
    lone = fp.compare_with_edit(docs.where("doc_id = 0")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    assert fp.compare_with_edit(docs.limit(0)).count() == 0


def test_neighbours_over_many_ranges(spark):
    ids = random.Random(2).sample(range(100_000), 400) + [10**12, 10**12 + 1]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, body string")
    got = {r.doc_id: r.next_body for r in fp.with_next(docs, "doc_id", ["body"], range_rows=7).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_sketch_estimates_and_merge(spark):
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for share in (0.0, 0.3, 0.6, 1.0):
        a = say(3000)
        b = a[: int(3000 * share)] + say(3000 - int(3000 * share))
        rows.append((" ".join(a), " ".join(b), share))
    df = spark.createDataFrame(rows, "a string, b string, share double")
    df = fp.add_sketch(fp.add_sketch(df, F.col("a"), "sa"), F.col("b"), "sb")
    for r in df.select("share", fp.resemblance(F.col("sa"), F.col("sb")).alias("j"), fp.containment(F.col("sa"), F.col("sb")).alias("c"), fp.distinct_shingles(F.col("sa")).alias("n"), F.size(fp.merge(F.col("sa"), F.col("sb"))).alias("k")).collect():
        assert abs(r.j - r.share / (2 - r.share)) < 0.15 and abs(r.c - r.share) < 0.25 and abs(r.n / 2996 - 1) < 0.3 and r.k == fp.K


# sharding ----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(("n", "shards", "bucket"), [(500, 7, 16), (500, 7, 2048), (3, 10, 4), (0, 5, 4)])
def test_shards_match_the_mixture(spark, n, shards, bucket):
    source = lambda i: None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 11}"
    docs = spark.createDataFrame([(i, source(i), "x") for i in range(n)], "doc_id long, source string, shard string")
    got = sharding.assign(docs, shards, rows_per_bucket=bucket).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in by.values())
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    for name in {r.source for r in got}:
        share = sum(r.source == name for r in got) / shards
        assert all(abs(sum(r.source == name and r.shard == s for r in got) - share) <= 2 + len({r.source for r in got}) / 4 for s in range(shards))


# line dedup --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bound", [0, 1000])
def test_lines(spark, bound):
    rows = [(i, f"menu\nown {i}\n\n menu \nrare {i // 4}", "a", 1) for i in range(8)] + [(8, None, "a", 1), (9, "", "a", 1), (10, "menu", None, 1), (11, "menu\nx", "b", 1), (11, "menu\nx", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bad int")
    got = ld.clean(docs, F.col("source"), ratio=0.5, least_pages=3, broadcast_lines=bound)
    assert got.columns == [*docs.columns, "line_dedup"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[3].text == "own 3\n\nrare 0" and rows[3].line_dedup.n_cut == 2
    assert rows[8].text is None and rows[9].text == "" and rows[10].text == "menu" and rows[11].text == "menu\nx"
    assert got.count() == 13 and ld.clean(docs.limit(0), F.col("source")).count() == 0


def test_line_below_a_tenth_of_a_source(spark):
    rows = [(i, f"own {i}\n" + ("junk line" if i % 14 == 0 else "rare" if i % 25 == 1 else ""), "a") for i in range(200)]
    rows += [(200 + i, f"own {i}\n" + ("seldom" if i < 2 else ""), "small") for i in range(4)]
    rows = {r.doc_id: r for r in ld.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source")).collect()}
    assert rows[14].text == "own 14" and rows[196].line_dedup.n_cut == 1
    assert rows[26].text == "own 26\nrare" and rows[200].text == "own 0\nseldom"


# language and quality ----------------------------------------------------------------------------------------------

def brute_grams(text):
    out = []
    for run in "".join(c if c.isalpha() else " " for c in f" {text.lower()} ").split():
        padded = f" {run} "
        out += [padded[i : i + n] for n in range(1, 5) for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]
    return out


def test_grams_against_brute_force():
    from collections import Counter

    code = lambda g: sum((ord(c) & 0xFFFF) << 16 * (len(g) - 1 - i) for i, c in enumerate(g))
    for text in ("", "a", "ab, cd!", "Été  où\nça", "x1y", "日本 a", "...", "The the THE"):
        assert Counter(li.grams(text.encode()).tolist()) == Counter(map(code, brute_grams(text)))


def test_languages(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de")] * 5)]
    rows += [(90, None, "en"), (91, "123 !!", None), (92, "the the and dog", None), (93, "le chien", None), (94, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = li.fit(docs, F.col("lang"), F.col("text"))
    got = {r.doc_id: r for r in li.predict(docs, profiles, F.col("text"), [F.col("doc_id")]).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 90, 91, 92, 93, 94)] == ["en", "fr", "de", "und", "und", "en", "fr", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in li.predict(docs, {}, F.col("text"), [F.col("doc_id")]).collect()} == {"und"}
    assert li.fit(docs.limit(0), F.col("lang"), F.col("text")) == {}


def test_additive_model():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ ((x[:, 1] > 0) & (x[:, 2] > 0))).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    p = model.score(x[2000:])
    assert ((p >= 0.5) == (y[2000:] == 1)).mean() > 0.9 and model.pairs
    assert np.allclose(quality.fit(x, np.ones(len(x))).score(x[:3]), (len(x) + 0.5) / (len(x) + 1))
    assert np.isfinite(quality.fit(np.zeros((0, 4)), np.zeros(0)).score(x[:3])).all()


def test_quality_rows(spark):
    good = "The quick brown fox jumps over the lazy dog near the river bank. " * 3
    rows = [(i, f"{good} {i}" if i % 2 else "BUY!! NOW!! " * 9, i) for i in range(200)] + [(900, None, 0), (901, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(5, None, 1), (None, 1, 0), (12345, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model, [F.col("doc_id")], F.col("text")).collect()}
    assert len(got) == 202 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(150, 200))
    assert got[900] == got[901]
