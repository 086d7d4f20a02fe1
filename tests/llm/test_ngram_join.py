import random
import re

import numpy as np
import pytest

from spanveil.llm import ngram_join as nj
from spanveil.llm.components import components


def brute(rows, n, near, of):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        m = min(n, len(words))
        sets[i] = {tuple(words[k : k + m]) for k in range(len(words) - m + 1)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and of * both >= near * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, groups=25, copies=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 9, 40, 120]))] + (shared if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 10])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return [*enumerate(texts), (len(texts), None), (len(texts) + 1, ""), (len(texts) + 2, " \n\t"), (len(texts) + 3, texts[0].upper()), (len(texts) + 4, "é É ß")]


@pytest.mark.parametrize(("n", "near", "unit"), [(4, 85, 512), (5, 80, 3), (1, 60, 4)])
def test_against_brute_force(spark, monkeypatch, n, near, unit):
    monkeypatch.setattr(nj, "UNIT_SETS", unit)
    rows = corpus(n)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, name_a string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_components(docs, n, near, 100).collect()}
    assert got == brute(rows, n, near, 100)


def test_a_large_component_is_not_copied_for_each_block(spark, monkeypatch):
    """Sets that are alike but hardly link (0.65 of 0.8): nearly all of their component ask all of it."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(52)]
    rows = [(i, " ".join(rng.sample(vocabulary, 40))) for i in range(300)]
    rows += [(300 + i, rows[i][1].replace(rows[i][1].split()[0], "other")) for i in range(0, 300, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    resolve, dealt = nj._resolve_units, []

    def counted(given, *args):
        dealt.append(given.count())
        return resolve(given, *args)

    monkeypatch.setattr(nj, "UNIT_SETS", 8)
    monkeypatch.setattr(nj, "_resolve_units", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_components(docs, 1, 80, 100).collect()}
    assert got == brute(rows, 1, 80, 100)
    assert len(rows) / 2 < max(dealt) < 2 * len(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "p q r s t"), (None, None), (None, "A B C D E F")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(nj.link_components(docs).collect(), key=str)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (-1, 3), (3, 3), (7, 3), (7, 3)]
    assert nj.link_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_ids_of_several_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(nj, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(nj, "UNIT_SETS", 4)
    rng = random.Random(3)
    text = lambda: [f"v{rng.randrange(10**6)}" for _ in range(60)]
    near = lambda words: " ".join([*words[:-1], "other"])
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, ""), (5, near(a)), (7, near(b)), (0, near(["first", *b[1:]]))]
    rows += [(None, " ".join(c)), (None, " ".join(d)), (21, near(c)), (20, near(["first", *c])), (22, near(d)), (9, None)]
    rows += [(100 + i, " ".join([*a[:50], *text()[:2], *a[50:]])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.component_id) for r in nj.link_components(docs, 1).collect()), key=str)
    want = [(i, 0) for i in (0, 1, 1, 1, 5, 7, *range(100, 112))] + [(None, 20), (20, 20), (21, 20), (None, 22), (22, 22), (9, 9)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("near", [95, 99, 100])
def test_high_thresholds(spark, near):
    rng = random.Random(near)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(40_000)}" for _ in range(rng.choice([3, 60, 900, 6000]))]
        for edits in (0, 0, 1, 8, 40):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_components(docs, 2, near, 100).collect()}
    assert got == brute(rows, 2, near, 100)


def test_bands_that_would_be_too_many(spark):
    with pytest.raises(ValueError, match="too close"):
        nj.Bands(99_999, 100_000)
    long = nj.Bands(99, 100)
    assert long.parts(len(long.starts) - 3)[0] > 0 and np.searchsorted(long.starts, nj.MOST_TOKENS - 1, "right") - 1 <= len(long.starts) - 3


def test_linked_sets_share_enough_signatures():
    rng = np.random.default_rng(0)
    bands = nj.Bands(80, 100)
    for _ in range(60):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        gone = int(len(a) * 20 // 100 * rng.random())
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(gone * rng.random() * 0.1), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        (x, p), (y, q) = bands.signatures(a, 0), bands.signatures(b, 0)
        shared = [(s, w) for s, w in set(zip(x.tolist(), p.tolist(), strict=True)) & set(zip(y.tolist(), q.tolist(), strict=True))]
        assert any(sum(w == band for _, w in shared) >= bands.parts(band)[2] for band in {w for _, w in shared})


def test_link_sets_groups_and_queries():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
    sets = [np.sort(np.concatenate([base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in range(0, 60, 2)]
    root = nj.link_sets(sets, 85, 100, group=4)
    small = nj.link_sets(sets, 85, 100, query=np.array([i == 0 for i in range(len(sets))]), group=4)
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    assert root.tolist() == want
    first = [100 * len(np.intersect1d(s, sets[0])) >= 85 * (len(s) + len(sets[0]) - len(np.intersect1d(s, sets[0]))) for s in sets]
    assert [r == small[0] for r in small] == first


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (5, 5), (300, 300)] + [(1000, 1001 + i) for i in range(300)] + [(999, 1300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and {found[x] for x in (100, 150, 200)} == {100} and 300 not in found
    assert {found[x] for x in range(999, 1301)} == {999}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
