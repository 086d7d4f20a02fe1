"""Packing into fixed windows by best-fit decreasing.

Every document becomes its token ids and an end id. Overlong documents are first cut into full windows; what remains
of each is placed, longest first, into the tightest open window that still holds it. A segment tree indexed by
remaining capacity finds that window.

Each task packs its own input split in blocks of a bounded number of remainders, so there is no shuffle, memory
doesn't grow with the input, and a task that is run again gives the same pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

WINDOW = 2048
END_ID = 1
BLOCK = 65536
#: Bytes without a border between white space and the rest, from which on a text goes to the library that needs no stack or square time for them.
LONG_RUN = 20_000
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class BestFit:
    """Open windows by remaining capacity; the segment tree marks which capacities have an open window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, name: int) -> None:
        self.open.setdefault(capacity, []).append(name)
        node = capacity + self.size
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least `need`, removed from the tree."""
        tree, node = self.tree, need + self.size
        while not tree[node]:
            while node & 1:  # a right child: what lies to its right is its parent's right
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node + (not tree[2 * node])
        capacity = node - self.size
        names = self.open[capacity]
        name = names.pop()
        if not names:
            tree[node] = 0
            node >>= 1
            while node and not (tree[2 * node] or tree[2 * node + 1]):
                tree[node] = 0
                node >>= 1
        return capacity, name


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: each item's window and its offset there, and the number of windows."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = BestFit(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            capacity, name = window, n
            n += 1
        else:
            capacity, name = found
        where[i], offset[i] = name, window - capacity
        if capacity > need:
            tree.add(capacity - need, name)
    return where, offset, n


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_ENCODERS: dict = {}
_WHITE = np.array([9 <= b <= 13 or b == 32 for b in range(256)])


def longest_run(text: str) -> int:
    """Bytes of the longest stretch of only ASCII white space, or of none."""
    white = _WHITE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    return int(np.diff(np.flatnonzero(white[1:] != white[:-1]), prepend=-1, append=len(white) - 1).max()) if len(white) else 0


def encoder(path: str, special_as_text: bool = False):
    """text -> ids of the tokenizer file at `path`, with no special tokens added.

    A byte-level BPE whose ids follow the order of its merges is run by the faster of the two libraries that give
    the same ids, unless a text has runs of LONG_RUN bytes; any other file by `tokenizers` itself. Added tokens that stand in a text are matched as that
    library does by default, or are ordinary text if `special_as_text`.
    """
    key = (path, special_as_text)
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = special_as_text
        fast = _fast(path, special_as_text)
        probe = "One  two\n\n3 été, it's ñandú\t<x> 日本 12345 a_b !?… "
        slow = lambda text: own.encode(text, add_special_tokens=False).ids
        alike = fast and fast(probe) == slow(probe)
        _ENCODERS[key] = (lambda text: slow(text) if len(text) >= LONG_RUN // 4 and longest_run(text) >= LONG_RUN else fast(text)) if alike else slow
    return _ENCODERS[key]


def _fast(path: str, special_as_text: bool):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or model.get("type") not in (None, "BPE") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        return None
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", []) if not (special_as_text and x.get("special"))}
    chars = byte_of_char()
    try:
        named = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if token not in named}
    except KeyError:
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if made != sorted(made):
        return None
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    if not added:
        return enc.encode_ordinary
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(m in text for m in added):
            return own.encode(text, add_special_tokens=False).ids
        return enc.encode_ordinary(text)

    return encode


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    block: int = BLOCK,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null text counts as an empty one and gives its end id alone; a null id stays null; repeated rows are packed
    each for itself; an empty table gives no rows. Columns besides id and text are not read, so their names can't
    clash. Sequence ids are unique over the whole result, not gapless; offsets within a sequence are gapless.
    `block` bounds the remainders held at a time.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        full: list[tuple] = []
        rest: list[tuple] = []
        ids_of: list[bytes] = []
        made = 0
        kind = None

        def rows(pieces: list[tuple], ids: list) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            arrays = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        full_ids: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if not rest:
                return
            where, offset, n = place(np.fromiter((r[2] for r in rest), np.int64, len(rest)), window)
            pieces = [(*r, base + made + w, o) for r, w, o in zip(rest, where.tolist(), offset.tolist(), strict=True)]
            made += n
            yield rows(pieces, list(ids_of))
            rest.clear()
            ids_of.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            for name, text in zip(names, batch.column(1), strict=True):
                raw = text.as_py()
                got = encode(raw.decode("utf-8", "replace")) if raw else []
                ids = np.empty(len(got) + 1, "<u4")
                ids[:-1] = got
                ids[-1] = end_id
                n = len(ids)
                cut = n - n % window
                for start in range(0, cut, window):
                    piece = ids[start : start + window]
                    full.append((name, start, window, zlib.crc32(piece), n, base + made, 0))
                    made += 1
                    if with_ids:
                        full_ids.append(piece.astype(np.int32))
                if cut < n:
                    piece = ids[cut:]
                    rest.append((name, cut, n - cut, zlib.crc32(piece), n))
                    if with_ids:
                        ids_of.append(piece.astype(np.int32))
                if len(full) >= 4096:
                    yield rows(full, full_ids)
                    full.clear()
                    full_ids.clear()
                if len(rest) >= block:
                    yield from flush()
        if full:
            yield rows(full, full_ids)
        yield from flush()

    given = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text_bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {PIECES}" + ", ids array<int>" * with_ids
    return map_batches(given, run, schema)
