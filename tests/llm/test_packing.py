import random

import numpy as np
import public_tokenizers
import pytest

from spanveil.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_place_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        window = rng.choice([8, 30, 64])
        lengths = np.array([rng.randint(1, window) for _ in range(rng.randint(0, 60))], np.int64)
        where, offset, n = packing.place(lengths, window)
        free, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [c for c in free if c >= lengths[i]]
            capacity = min(fits) if fits else window
            if fits:
                free.remove(capacity)
            want.append((i, window - capacity))
            free.append(capacity - lengths[i])
        assert n == len(free) and all(offset[i] == o for i, o in want)
        for w in range(n):
            mine = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if where[i] == w)
            assert mine[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(mine, mine[1:], strict=False)) and sum(mine[-1]) <= window


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(PATH)
    for text in ("", " ", "a  b\n\n c", "été 日本 <|endoftext|> it's 1234\t!?", "x" * 3000, "\r\n \r\n a"):
        assert list(packing.encoder(PATH)(text)) == slow.encode(text, add_special_tokens=False).ids
    assert 50256 not in packing.encoder(PATH, True)("a<|endoftext|>b")


@pytest.mark.parametrize("block", [2, 65536])
def test_pieces_make_the_documents_again(spark, block):
    rows = [(1, "one two", "k"), (2, None, "k"), (3, "", "k"), (4, "word " * 5000, "k"), (1, "one two", "k"), (None, "no id", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `offset` string").coalesce(1)
    got = packing.pack(docs, PATH, window=512, block=block, with_ids=True).collect()
    encode = packing.encoder(PATH)
    for text in {r[1] or "" for r in rows}:
        ids = [*encode(text), 1]
        own = sorted((r.start, r.ids) for r in got if r.doc_tokens == len(ids))
        times = sum((r[1] or "") == text or len([*encode(r[1] or ""), 1]) == len(ids) for r in rows)
        assert sum(len(x) for _, x in own) == times * len(ids)
    for s in {r.sequence_id for r in got}:
        mine = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert mine[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(mine, mine[1:], strict=False)) and sum(mine[-1]) <= 512
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("unit", [" ", "a", "\n", "1", "!", " \n", "é", "\u3000", "日本"])
def test_long_runs(unit):
    from tokenizers import Tokenizer

    text = "start " + unit * (1_000_000 // len(unit)) + "a end"
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert packing.encoder(PATH)(text) == want


def test_longest_run():
    assert [packing.longest_run(x) for x in ("", "a", "ab c", " \n\t x", "é é", "a" * 7 + " " * 9)] == [0, 1, 2, 4, 2, 9]


def test_ids_of_all_documents(spark):
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(PATH), packing.encoder(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    assert texts and all(encode(x) == own.encode(x, add_special_tokens=False).ids for x in texts)
