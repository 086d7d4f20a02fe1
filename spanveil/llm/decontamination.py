"""Benchmark decontamination: a broadcast set of the test items' word n-grams, scanned over the training text.

Texts are bytes here: A-Z are lower-cased, words are runs of a-z, 0-9 and bytes of other characters. A window is `n`
consecutive words of an item; an item of fewer words is one window of its own length. A document's words become
numbers of the benchmark's vocabulary, a rolling hash over them picks candidate places, and each candidate is
verified against the numbers themselves.

A benchmark is broadcast in parts of bounded bytes. A batch of documents meets one part after another while it is
held, so that the text is read once however many parts there are, and a worker holds one part at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
N = 8
#: Bytes of benchmark text in a part. Its windows take about ten times as much, and its different words 100 bytes each.
PART_BYTES = 8 << 20


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix, and which of them each row is."""
    order = np.lexsort(rows.T[::-1])
    lined = rows[order]
    new = np.concatenate(([True], (lined[1:] != lined[:-1]).any(1)))
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return lined[new], which


class Sized:
    """Windows of one length: their hashes in order, the numbers of their words, and the items that each is in."""

    def __init__(self, rows: np.ndarray, items: np.ndarray, factor: np.ndarray):
        windows, which = distinct_rows(rows)
        with np.errstate(over="ignore"):
            h = (windows.astype(np.uint64) * factor[: windows.shape[1]]).sum(1, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.windows = h[order], windows[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs, _ = distinct_rows(np.stack([place[which], items], 1))
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
        self.items = pairs[:, 1].astype(np.int32)
        #: how many windows share a hash at most
        self.alike = int(np.diff(np.flatnonzero(np.concatenate(([True], self.hashes[1:] != self.hashes[:-1], [True])))).max())

    def found(self, ids: np.ndarray, gaps: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document's words where a window begins, and which window."""
        size = self.windows.shape[1]
        m = len(ids) - size + 1
        at = np.flatnonzero(gaps[size : size + m] == gaps[:m]) if m > 0 else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), np.uint64)
            for j in range(size):
                h += ids[at + j].astype(np.uint64) * factor[j]
        low = np.searchsorted(self.hashes, h)
        places, windows = [], []
        for k in range(self.alike):
            near = np.minimum(low + k, len(self.hashes) - 1)
            same = np.flatnonzero(self.hashes[near] == h)
            same = same[(low[same] + k) < len(self.hashes)]
            true = same[(ids[at[same][:, None] + np.arange(size)] == self.windows[near[same]]).all(1)]
            places.append(at[true])
            windows.append(near[true])
        return np.concatenate(places), np.concatenate(windows)


class Windows:
    """The windows of some test items, by length, as arrays."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.n = n
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocab: dict[bytes, int] = {}
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in WORD.findall(text.lower())], np.int32)
            if size := min(n, len(ids)):
                parts.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(ids, size), number[name]))
        self.factor = np.random.default_rng(7).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        self.sets = {size: Sized(np.concatenate([r for r, _ in own]), np.concatenate([np.full(len(r), i) for r, i in own]), self.factor) for size, own in parts.items()}

    def hits(self, words: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, numbers of items) of the windows of each length that occur."""
        look = self.vocab.get
        ids = np.fromiter((look(w, 0) for w in words), np.int32, len(words))
        if not ids.any():
            return []
        gaps = np.concatenate(([0], np.cumsum(ids == 0)))
        out = []
        for size, own in self.sets.items():
            at, which = own.found(ids, gaps, self.factor)
            if len(at):
                which = np.unique(which)
                out.append((size, at, np.unique(np.concatenate([own.items[own.starts[w] : own.starts[w + 1]] for w in which.tolist()]))))
        return out


class Marks:
    """What the parts of a benchmark have found in one document so far."""

    def __init__(self):
        self.ends = None
        self.full: set[str] = set()
        self.items: set[str] = set()

    def add(self, n_words: int, n: int, names: list[str], hits: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        for size, at, items in hits:
            if self.ends is None:
                self.ends = np.zeros(n_words + 1, np.int64)
            np.add.at(self.ends, at, 1)
            np.add.at(self.ends, at + size, -1)
            own = {names[i] for i in items.tolist()}
            self.items |= own
            if size == n:
                self.full |= own

    def covered(self) -> np.ndarray | None:
        """Whether each word is hit; None without hits."""
        return None if self.ends is None else np.cumsum(self.ends[:-1]) > 0


def item_parts(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The test items in parts of bounded size, one after another. One item must fit a part."""
    sized = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text")).where("item is not null and text is not null")
    total = sized.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).head()[0]
    n = max(1, -(-int(total) // part_bytes))
    n = n if n == 1 else 2 * n  # twice as many, as a hash deals unevenly
    part = F.pmod(F.xxhash64("item"), F.lit(n))
    for i in range(n):
        yield sorted({(r.item, bytes(r.text)) for r in sized.where(part == i).collect()})


def _one_at_a_time(shared: list) -> Iterator[Windows]:
    """The broadcast parts; of several, a worker lets go of each before it takes the next."""
    for part in shared:
        yield part.value
        if len(shared) > 1:
            vars(part).pop("_value", None)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_cols: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = N,
    part_bytes: int = PART_BYTES,
    carry_text: bool = False,
) -> DataFrame:
    """One row per input row: id_cols, n_words, n_hit, n_full, items (sorted strings), and with carry_text the text without its hit words (clean_text).

    n_full counts the items that have a full window of `n` words there. A word inside any occurrence of a window is
    hit. Null and empty texts have no words, and no hits; null items or item texts are no items; items of equal text
    count each, items of equal id are one; an empty benchmark hits nothing; repeated rows are scanned each for itself.
    Texts may be of any length, and the input may have columns of any name.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(Windows(items, n)) for items in item_parts(benchmark, item_col, item_text_col, part_bytes)]
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in id_cols)).alias("kept"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [Marks() for _ in range(len(batch))]
            n_words = [0] * len(batch)
            for windows in _one_at_a_time(shared):
                for i, raw in enumerate(batch.column(1)):
                    raw = raw.as_py()
                    words = WORD.findall(raw.lower()) if raw else []
                    n_words[i] = len(words)
                    marks[i].add(len(words), n, windows.names, windows.hits(words))
            covered = [m.covered() for m in marks]
            n_hit = [0 if c is None else int(c.sum()) for c in covered]
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(m.full) for m in marks], pa.int64()), pa.array([sorted(m.items) for m in marks], pa.list_(pa.string()))]
            names = ["kept", "n_words", "n_hit", "n_full", "items"]
            if carry_text:
                cols.append(pa.array([without(raw.as_py(), c) for raw, c in zip(batch.column(1), covered, strict=True)], pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = given.schema["kept"].dataType.simpleString()
    made = map_batches(given, run, f"kept {kind}, n_words long, n_hit long, n_full long, items array<string>" + ", clean_text string" * carry_text)
    return made.select(*(F.col(f"kept.`{c}`") for c in id_cols), "n_words", "n_hit", "n_full", "items", *["clean_text"] * carry_text)


def without(raw: bytes | None, mark: np.ndarray | None) -> str | None:
    """The text with each run of hit words cut out, along with what stands between those words."""
    if raw is None:
        return None
    if mark is None:
        return raw.decode("utf-8", "replace")
    out, at, end = [], 0, None
    for i, m in enumerate(WORD.finditer(raw.lower())):
        if mark[i]:
            if end is None:
                out.append(raw[at : m.start()])
            end = m.end()
        elif end is not None:
            at, end = end, None
    out.append(raw[end if end is not None else at :])
    return b"".join(out).decode("utf-8", "replace")


def digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", least_items: int = 1, n: int = N, **more) -> DataFrame:
    """`docs` without contaminated documents (mode "documents") or with the hit words cut out of them (mode "spans").

    A document is contaminated if at least `least_items` items have a full window of `n` words in it: an item of a
    few everyday words is no leak by itself. All of the input's columns come back, under their names.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode: {mode}")
    given = docs.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("text"))
    marked = scan(given, benchmark, ["row"], n=n, carry_text=mode == "spans", **more)
    if mode == "documents":
        return marked.where(F.col("n_full") < least_items).select("row.*")
    cut = F.when(F.col("n_full") >= least_items, F.col("clean_text")).otherwise(F.col(f"row.`{text_col}`"))
    return marked.select(*(cut.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
