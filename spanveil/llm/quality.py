"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and so have some pairs of features. The tables are learned by
cyclic boosting: feature by feature, again and again with a small step, a tree of at most three leaves is fitted to
what the model still misses; then the pairs that explain most of the rest get trees of four quadrants. A score is the
sum of the bins' values, put through a logistic function.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Labelled rows that the model is fitted on at most (those whose ids' hashes are the smallest).
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
SENTENCE_END = re.compile(rb"[.!?](?:\s|$)")

FEATURES = (
    "log_words", "word_length", "long_words", "short_words", "upper", "digits", "punctuation", "symbols", "spaces", "wide", "distinct_words",
    "top_word", "same_as_before", "distinct_pairs", "capitalised", "marked_words", "lines", "line_length", "same_lines", "sentence_ends", "packed", "bars", "slashes",
)

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_POINT = np.array([chr(b) in ".,;:!?'\"()-" for b in range(256)])
_WIDE = np.arange(256) >= 128
_OTHER = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _POINT | _WIDE)


def features(raw: bytes | None) -> list[float]:
    """Of a whole text, in the order of FEATURES. A null text is an empty one."""
    raw = raw or b""
    n = max(1, len(raw))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counted = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    pairs = set(zip(words, words[1:], strict=False))
    upper = int(by[_UPPER].sum())
    return [
        float(np.log1p(len(words))),
        float(lengths.mean()) if len(words) else 0.0,
        float((lengths > 14).sum()) / k,
        float((lengths < 3).sum()) / k,
        upper / max(1, upper + int(by[_LOWER].sum())),
        float(by[_DIGIT].sum()) / n,
        float(by[_POINT].sum()) / n,
        float(by[_OTHER].sum()) / n,
        float(by[_SPACE].sum()) / n,
        float(by[_WIDE].sum()) / n,
        len(counted) / k,
        max(counted.values(), default=0) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k,
        len(pairs) / max(1, len(words) - 1),
        sum(map(bytes.istitle, words)) / k,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / k,
        float(np.log1p(len(lines))),
        float(np.log1p(len(raw) / m)),
        1 - len(set(lines)) / m if lines else 0.0,
        len(SENTENCE_END.findall(raw)) / k,
        len(zlib.compress(raw, 1)) / n,
        float(by[124]) / k,
        float(by[47] + by[92] + by[60] + by[62] + by[123] + by[125]) / k,
    ]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return logistic(total)


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner borders of at most `bins` bins of about as many rows each."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def leaves(g: np.ndarray, h: np.ndarray, most: int = 3, least: float = 2.0, ridge: float = 1.0) -> np.ndarray:
    """Values by bin of a tree over ordered bins, grown by the split of the highest gain."""
    cuts = [0, len(g)]
    gg, hh = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    part = lambda a, b: (gg[b] - gg[a]) ** 2 / (hh[b] - hh[a] + ridge)
    while len(cuts) <= most:
        best, where = 1e-9, None
        for a, b in itertools.pairwise(cuts):
            at = np.arange(a + 1, b)
            at = at[(hh[at] - hh[a] >= least) & (hh[b] - hh[at] >= least)]
            if len(at):
                gain = part(a, at) + part(at, b) - part(a, b)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, where = float(gain[i]), int(at[i])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, b in itertools.pairwise(cuts):
        out[a:b] = (gg[b] - gg[a]) / (hh[b] - hh[a] + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four quadrants."""
    gs, hs = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not i.size:
        return 0.0, np.zeros_like(g)

    def four(s: np.ndarray) -> list[np.ndarray]:
        a, top, left, all_ = s[i, j], s[i, -1], s[-1, j], s[-1, -1]
        return [a, top - a, left - a, all_ - top - left + a]

    parts = list(zip(four(gs), four(hs), strict=True))
    gain = sum(a**2 / (b + ridge) for a, b in parts)
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [float(a[at] / (b[at] + ridge)) for a, b in parts]
    ci, cj = int(i[at]), int(j[at])
    out = np.empty_like(g)
    out[:ci, :cj], out[:ci, cj:], out[ci:, :cj], out[ci:, cj:] = value
    return float(gain[at] - gs[-1, -1] ** 2 / (hs[-1, -1] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, step: float = 0.1, pairs: int = 8, patience: int = 25, seed: int = 0) -> Model:
    """The model; a tenth of the rows tells when to stop. Without rows, or with one label only, the score is that label's share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    edges = [edges_of(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    coarse_edges = [edges_of(x[:, j], PAIR_BINS) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], coarse_edges, [], float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    apart = np.random.default_rng(seed).random(len(y)) < 0.1
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse_edges)]
    total = np.full(len(y), model.start)
    use = np.flatnonzero(~apart)

    def loss() -> float:
        p = np.clip(logistic(total[apart]), 1e-9, 1 - 1e-9)
        return float(-np.mean(np.where(y[apart] == 1, np.log(p), np.log(1 - p)))) if apart.any() else 0.0

    def boost(kinds: list, tables: list[np.ndarray], where: list, grow) -> None:
        nonlocal total
        best, best_at, kept, kept_total = loss(), 0, [t.copy() for t in tables], total.copy()
        for r in range(rounds):
            for j in range(len(kinds)):
                p = logistic(total[use])
                size = tables[j].size
                at = where[j][use]
                g = np.bincount(at, y[use] - p, size).reshape(tables[j].shape)
                h = np.bincount(at, p * (1 - p), size).reshape(tables[j].shape)
                change = step * grow(g, h)
                tables[j] += change
                total += change.ravel()[where[j]]
            now = loss()
            if now < best - 1e-6:
                best, best_at, kept, kept_total = now, r, [t.copy() for t in tables], total.copy()
            elif r - best_at >= patience:
                break
        for t, k in zip(tables, kept, strict=True):
            t[...] = k
        total = kept_total

    boost(edges, model.tables, bins, leaves)
    p = logistic(total[use])
    gains = []
    for a, b in itertools.combinations(range(x.shape[1]), 2):
        shape = (len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)
        at = coarse[a][use] * shape[1] + coarse[b][use]
        g = np.bincount(at, y[use] - p, shape[0] * shape[1]).reshape(shape)
        h = np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)
        gains.append((quadrants(g, h)[0], a, b))
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)) for a, b in model.pairs]
    flat = [coarse[a] * t.shape[1] + coarse[b] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True)]
    boost(model.pairs, model.pair_tables, flat, lambda g, h: quadrants(g, h)[1])
    return model


def feature_rows(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """The `keep` columns and `features`, an array of doubles; null texts count as empty."""
    given = docs.select(F.struct(*keep).alias("kept"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x.as_py()) for x in batch.column(1)], pa.list_(pa.float64()))], ["kept", "features"])

    kind = given.schema["kept"].dataType.simpleString()
    return map_batches(given, run, f"kept {kind}, features array<double>").select("kept.*", "features")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fitted on the labelled rows, at most `sample_rows` of them (a documented bound; which ones is settled by a hash of the id).

    Null labels and labels of no document don't count; a label given twice counts once, an id with both labels once for
    each; of several rows of one id, that whose features' hash is the least is the document.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    sample = F.broadcast(own.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows))  # at most sample_rows rows of 12 bytes
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(sample, "id")
    made = feature_rows(picked, [F.col("id"), F.col("label")], F.col("text"))
    rows = made.groupBy("id", "label").agg(F.min_by("features", F.xxhash64("features")).alias("features")).collect()  # at most sample_rows rows of 23 numbers
    rows.sort(key=lambda r: (r.id, r.label, r.features))
    x = np.array([r.features for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.label for r in rows], float))


def score(docs: DataFrame, model: Model, keep: list[Column], text: Column) -> DataFrame:
    """The `keep` columns and `score`, 0 to 1, of each row; null and empty texts have the features of an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of some 32 values
    given = docs.select(F.struct(*keep).alias("kept"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.array([features(v.as_py()) for v in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["kept", "score"])

    kind = given.schema["kept"].dataType.simpleString()
    return map_batches(given, run, f"kept {kind}, score double").select("kept.*", "score")
