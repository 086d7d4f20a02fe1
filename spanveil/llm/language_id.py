"""Language identification by rank-order profiles.

A profile is a text's (or a language's) most frequent letter n-grams in order of frequency; n-grams come from words
with a blank on either side. A document is given the language whose profile is the least out of place: the sum, over
the document's n-grams, of the difference of ranks, or of the profile's length for those that it lacks.

An n-gram is a number, 16 bits for each of its up to four characters (of characters beyond these, the low 16 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches

NO_LANGUAGE = "und"
LONGEST = 4
LENGTH = 400
#: n-grams that a worker gathers before it sums them up.
GATHERED = 1_000_000
#: Parts of a language whose n-grams are ranked apart; the profile comes from their best.
RANK_PARTS = 16
BLANK = 0x20

_SYMBOLS: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """Of each code point: itself, in 16 bits, if it is a letter, else a blank."""
    if not _SYMBOLS:
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        own = (np.arange(0x110000) & 0xFFFF).astype(np.uint16)
        own[own == 0] = 1
        own[own == BLANK] = 1
        _SYMBOLS.append(np.where(letters, own, np.uint16(BLANK)))
    return _SYMBOLS[0]


def grams(raw: bytes | None) -> np.ndarray:
    """The n-grams of a text, one for each occurrence; none without letters."""
    if not raw:
        return np.zeros(0, np.uint64)
    text = f" {raw.decode('utf-8', 'replace').lower()} "
    s = symbols()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    blank = s == BLANK
    keep = np.ones(len(s), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    s, blank = s[keep].astype(np.uint64), blank[keep]
    if len(s) < 3:
        return np.zeros(0, np.uint64)
    out = [s[~blank]]
    code, inside = s, np.ones(len(s), bool)
    for n in range(2, LONGEST + 1):
        if len(s) < n:
            break
        code = code[:-1] << np.uint64(16) | s[n - 1 :]
        if n > 2:  # no blank but at the ends
            inside = inside[:-1] & ~blank[n - 2 : len(s) - 1]
        else:
            inside = inside[:-1]
        out.append(code[inside])
    return np.concatenate(out)


def counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, sorted, and how often each occurs."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    if weights is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    if weights is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(weights, first)


def count_grams(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, n-grams, counts); summed up whenever GATHERED n-grams of a language have come, so memory follows the number of different ones."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    held: dict[str, int] = {}

    def settle(lang: str) -> None:
        codes, n = counted(np.concatenate(waiting.pop(lang)))
        held[lang] = 0
        if lang in sums:
            had, m = sums[lang]
            codes, n = counted(np.concatenate([had, codes]), np.concatenate([m, n]))
        sums[lang] = codes, n

    for lang, raw in rows:
        got = grams(raw)
        waiting.setdefault(lang, []).append(got)
        held[lang] = held.get(lang, 0) + len(got)
        if held[lang] >= GATHERED:
            settle(lang)
        if len(sums.get(lang, ((),))[0]) > GATHERED:
            yield lang, *sums.pop(lang)
    for lang in list(waiting):
        settle(lang)
    for lang, (codes, n) in sums.items():
        yield lang, codes, n


def fit(docs: DataFrame, lang: Column, text: Column, length: int = LENGTH) -> dict[str, list[int]]:
    """Each language's profile from all rows whose language and text aren't null. Counts are summed over the whole input; `length` n-grams a language come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((a, b.as_py()) for x in batches for a, b in zip(x.column(0).to_pylist(), x.column(1), strict=True))
        for name, codes, n in count_grams(rows):
            for at in range(0, len(codes), 100_000):
                part = codes[at : at + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(n[at : at + 100_000].astype(np.int64))], ["lang", "gram", "n"])

    given = docs.select(lang.cast("string").alias("lang"), text.cast("binary").alias("text")).where("lang is not null and text is not null")
    counts = map_batches(given, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # first the most frequent of each of a language's parts, so that no task ranks all n-grams of one
    parts = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(RANK_PARTS)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= length)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in few.select("lang", "gram", "n").withColumn("rank", rank).where(F.col("rank") <= length).orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


class Identifier:
    """Language profiles, looked up together."""

    def __init__(self, profiles: dict[str, list[int]], length: int = LENGTH):
        self.langs = sorted(profiles)
        self.length = length
        own = [np.array(profiles[x], np.int64).view(np.uint64) for x in self.langs]
        self.known = np.unique(np.concatenate([*own, np.array([0], np.uint64)]))
        self.place = np.full((len(own), len(self.known)), length, np.int64)
        for i, codes in enumerate(own):
            self.place[i, np.searchsorted(self.known, codes)] = np.arange(len(codes))

    def predict(self, raw: bytes | None) -> tuple[str, float]:
        """The language and 1 less the distance as a share of the largest possible; no language and 0 without letters."""
        codes, n = counted(grams(raw))
        if not len(codes) or not self.langs:
            return NO_LANGUAGE, 0.0
        if len(codes) > self.length:  # codes are sorted, so a stable sort settles ties by code
            least = np.partition(n, -self.length)[-self.length]
            some = n >= least
            codes, n = codes[some], n[some]
        top = codes[np.argsort(-n, kind="stable")[: self.length]]
        at = np.searchsorted(self.known, top)
        at[at == len(self.known)] = 0
        there = np.where(self.known[at] == top, self.place[:, at], self.length)
        away = np.where(there == self.length, self.length, np.abs(there - np.arange(len(top)))).sum(1)
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (self.length * len(top))


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: Column, keep: list[Column], length: int = LENGTH) -> DataFrame:
    """The `keep` columns, lang_pred and score, a row for each input row.

    Null texts and texts without letters are "und" with score 0, as everything is when no profile was learned. Equal
    distances go to the language that sorts first. A word of any length counts whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x length n-grams of up to 4 letters
    given = docs.select(F.struct(*keep).alias("kept"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(shared.value, length)
        for batch in batches:
            got = [own.predict(x.as_py()) for x in batch.column(1)]
            cols = [batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["kept", "lang_pred", "score"])

    kept = given.schema["kept"].dataType.simpleString()
    return map_batches(given, run, f"kept {kept}, lang_pred string, score double").select("kept.*", "lang_pred", "score")
