"""Each registered query on whole small tables: against SQL where there is some, else against a plain rewrite."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash

from spanveil.llm import queries, quality

from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"
HELD = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return table("documents")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, SF)
    order = sorted(want.column_names)
    assert order == sorted(got.columns)
    rows = lambda t: sorted(repr(tuple(r[c] for c in order)) for r in t)
    assert rows([r.asDict() for r in got.collect()]) == rows(want.to_pylist())


def test_op2(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_ngram_jaccard_join(spark, SF).collect()}
    assert got == brute([(d["doc_id"], d["text"]) for d in docs], 4, 85, 100)


def ranked(texts):
    """n-grams of one to four letters in words with a blank on either side, by count and then by their 16-bit letters."""
    counts = Counter()
    for text in texts:
        word = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        letters = f" {' '.join(word.split())} "
        for n in range(1, 5):
            for i in range(len(letters) - n + 1):
                gram = letters[i : i + n]
                if " " not in (gram if n == 1 else gram[1:-1]) and (n > 1 or gram != " "):
                    counts[gram] += 1
    code = lambda g: int.from_bytes(b"".join((ord(c) & 0xFFFF).to_bytes(2, "big") for c in g), "big")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return counts, code, signed


def test_op3(spark, docs):
    known = {}
    for lang in {d["lang"] for d in docs if d["lang"]}:
        counts, code, signed = ranked(d["text"] for d in docs if d["lang"] == lang and d["text"] and not HELD(d["doc_id"]))
        known[lang] = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], signed(code(g))))[:400])}
    got = {r.doc_id: r for r in queries.op3_language_profiles(spark, SF).collect()}
    right = []
    for d in docs:
        counts, code, _ = ranked([d["text"] or ""])
        top = sorted(counts, key=lambda g: (-counts[g], code(g)))[:400]
        r = got[d["doc_id"]]
        assert r.held_out == HELD(d["doc_id"])
        if not top:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        away = {lang: sum(abs(place[g] - i) if g in place else 400 for i, g in enumerate(top)) for lang, place in known.items()}
        best = min(sorted(away), key=away.get)
        assert r.lang_pred == best and abs(r.score - (1 - away[best] / (400 * len(top)))) < 1e-9
        if r.held_out and d["lang"] and len(d["text"]) > 40:
            right.append(r.lang_pred == d["lang"])
    assert len(right) > 10 and np.mean(right) > 0.9


def test_op5(spark, docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op5_best_fit_packing(spark, SF).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {d["doc_id"] for d in docs}
    for d in docs:
        ids = np.array([*encode.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d["doc_id"]], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in rows.values():
        own.sort()
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
    assert sum(r.length for r in got) / (2048 * len(rows)) > 0.97


def test_op6(spark, docs):
    got = {r.doc_id: r for r in queries.op6_stratified_sharding(spark, SF).collect()}
    for d in docs:
        raw = (d["text"] or "").encode()
        assert (got[d["doc_id"]].size, got[d["doc_id"]].text_crc32, got[d["doc_id"]].law) == (len(raw) + 16, zlib.crc32(raw), "rows")
    shards = {}
    for r in got.values():
        shards.setdefault(r.shard, []).append(r)
    counts = [len(x) for x in shards.values()]
    assert set(shards) == set(range(40)) and max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
    share = Counter(d["source"] for d in docs)
    for own in shards.values():  # of each source, the share of the whole table, rounded up or down
        for source, n in Counter(r.source for r in own).items():
            assert n <= -(-share[source] * len(own) // len(docs)) + 1


def test_op7(spark, docs):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER).encode())
    windows = {}
    for item in table("benchmark"):
        own = split(item["text"])
        for i in range(max(1, len(own) - 7) if own else 0):
            windows.setdefault(tuple(own[i : i + 8]), set()).add(str(item["item_id"]))
    got = {r.doc_id: r for r in queries.op7_benchmark_decontamination(spark, SF).collect()}
    for d in docs:
        own, hit, items = split(d["text"]), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if (found := windows.get(tuple(own[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= found
        want = (len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2)
        r = got[d["doc_id"]]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want


def sketch(text, n=5, k=128):
    words = [xxhash.xxh64_intdigest(w, seed=42) for w in re.split(rb"[\x20\x09-\x0D]+", text.translate(LOWER).encode()) if w]
    m = min(n, len(words))
    found = set()
    for i in range(len(words) - m + 1 if words else 0):
        h = 42
        if len(words) >= n:
            for w in words[i : i + n]:
                h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed=h)
        else:  # an array is hashed element by element in the same way
            for w in words:
                h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed=h)
        found.add(h - (1 << 64) if h >> 63 else h)
    return sorted(found)[:k]


def likeness(a, b, k=128):
    both = sorted({*a, *b})[:k]
    return 1.0 if not a and not b else len({*both} & {*a} & {*b}) / max(1, len(both))


def test_op8(spark, docs):
    import base64

    lined = sorted(docs, key=lambda d: d["doc_id"])
    shown = lambda s: base64.b64encode(b"".join((x & (1 << 64) - 1).to_bytes(8, "big") for x in s)).decode()
    got = {r.doc_id: r for r in queries.op8_bottom_k_fingerprints(spark, SF).collect()}
    for i, d in enumerate(lined):
        text, after = d["text"] or "", lined[(i + 1) % len(lined)]["text"] or ""
        moved = len(text) // 4
        edited = text[: len(text) - moved] + after[:moved]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        r = got[d["doc_id"]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint.replace("\r\n", ""), r.edited_fingerprint.replace("\r\n", "")) == (shown(a), shown(b))
        assert abs(r.near_edited - likeness(a, b)) < 1e-12 and abs(r.near_next - likeness(a, c)) < 1e-12


def test_op10(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op10_additive_quality(spark, sf).collect()}
    labels = {x["doc_id"]: x["quality"] for x in table("labels", sf)}
    texts = {d["doc_id"]: d["text"] for d in table("documents", sf)}
    assert set(got) == set(texts) and all(r.held_out == HELD(i) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    fitted = [(i, q) for i, q in labels.items() if not HELD(i) and q in (0, 1) and i in texts]
    rows = sorted(([i, q, quality.features((texts[i] or "").encode())] for i, q in fitted), key=lambda r: (r[0], r[1], r[2]))
    model = quality.fit(np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float))
    for i in sorted(texts)[:200]:
        x = quality.features((texts[i] or "").encode())
        total = model.start + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(x, model.edges, model.tables, strict=True))
        total += sum(t[sum(x[a] >= e for e in model.pair_edges[a]), sum(x[b] >= e for e in model.pair_edges[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(got[i].score - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-9
    apart = [(got[i].score, q) for i, q in labels.items() if HELD(i) and q in (0, 1) and i in got]
    good, bad = [s for s, q in apart if q], [s for s, q in apart if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_letters_are_what_the_rewrite_takes_for_letters():
    assert all(unicodedata.category(c)[0] == "L" for c in "aéßя日") and not "1".isalpha()
