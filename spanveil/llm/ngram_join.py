"""N-gram Jaccard self-join over a token-group matrix, exact.

Documents are sets of word n-grams (64-bit hashes). Equal sets are one node. The join works in three steps.

1. Which documents can be similar at all. Sizes fall into bands such that only sets of the same or of neighbouring
   bands can link. Between two such sets there is a largest possible difference H; when the tokens are dealt by a hash
   into H + 1 + e parts, at least e + 1 parts are equal in both. A set's parts (but for at most e small ones, which say
   little) become signatures. A set that doesn't share enough signatures with others links with none, and leaves; of
   the rest, sets that share one are in the same candidate component. No link is lost. What a batch holds twice is
   counted and linked where it is, so that a hot signature costs a row per batch and not one per document.
2. Token-group matrix. Within a candidate component the sets are put into groups of similar ones, and each group's
   union of tokens is stored. A query's overlap with the union bounds its overlap with every set in the group; only
   groups whose bound reaches the threshold are opened, and only sets that aren't connected with the query yet are
   compared in full.
3. Candidate components that are too large for a task are first cut by further signatures. What stays large are real
   groups of near copies: they are dealt into blocks, each with a few leaders of the whole component, and those that
   this doesn't connect with its main part are queries against all members, block by block, by way of the matrix again.
   Queries are written once, and whoever holds a block reads them from the shared folder, so disk doesn't grow with the
   number of blocks times that of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, new_path, written
from .components import components, forest

U = np.uint64
#: A signature row: name and band in 8 bytes, the signature and a mark in 5.
ROW = 13
SIGN_BITS, NAME_BITS, BAND_BITS = 39, 48, 16
BAND = U((1 << BAND_BITS) - 1)
#: Tokens that a text can have at most: a binary value has under 2 GB.
MOST_TOKENS = 1 << 31
#: Sets and tokens in one unit of work; a larger candidate component is cut.
UNIT_SETS, UNIT_TOKENS = 2048, 1 << 20
GROUP = 32
#: Signature rows that a task takes; bounds the partition count of their shuffle from below.
TASK_ROWS = 1 << 20
#: Bytes of candidates' keys that are broadcast at most; beyond it the texts are dealt to their keys.
BROADCAST_BYTES = 64 << 20
#: Tokens that a task of the last steps takes.
TASK_TOKENS = 1 << 22
REFINEMENTS, LEADERS = 2, 4
#: Words whose hashes a worker keeps.
KEPT_WORDS = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (constants of the public splitmix64 generator)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


_WORDS = WordHashes()


def tokens(raw: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct n-gram hashes of a whole text; with fewer words, the whole sequence is one. Without words, none."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(_WORDS.__getitem__, words), U, len(words))
    m = min(n, len(words))
    out = np.full(len(words) - m + 1, m, U)
    for j in range(m):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[j : len(h) - m + 1 + j])
    return np.unique(out)


def name_of(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    got = xxhash.xxh3_128_intdigest(own.tobytes())
    return (got >> 64) - (1 << 63), (got & (1 << 64) - 1) - (1 << 63)


class Bands:
    """Size bands and part counts for links where of * |A & B| >= near * |A | B|, near below of."""

    def __init__(self, near: int, of: int):
        self.near, self.of = near, of
        starts = [1]
        while starts[-1] < MOST_TOKENS and len(starts) < 1 << BAND_BITS:
            starts.append(max(starts[-1] + 1, starts[-1] * of // near + 1))
        if starts[-1] < MOST_TOKENS:
            raise ValueError(f"{near} / {of} is too close to 1: more than {1 << BAND_BITS} size bands; equality (near = of) is allowed")
        self.starts = np.array([*starts, starts[-1] * of // near + 1, (starts[-1] * of // near + 1) * of // near + 1])

    def parts(self, band: int) -> tuple[int, int, int]:
        """(parts, skipped, need): of so many parts, a set's `skipped` smallest ones don't count, and linked sets of this band, or of this and the next one, are equal in `need` of the others at least."""
        a, b = int(self.starts[band + 2]) - 1, int(self.starts[band + 1]) - 1
        most = (a + b) * (self.of - self.near) // (self.of + self.near)
        spare = (most + 1) // 2 if most >= 8 else 0
        return most + 1 + spare, spare // 2, spare - spare // 2 + 1

    def needs(self) -> list[int]:
        return [self.parts(b)[2] for b in range(len(self.starts) - 2)]

    def signatures(self, own: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a set's parts, and the band of each."""
        band = int(np.searchsorted(self.starts, len(own), "right")) - 1
        out, bands = [], []
        for b in (band, band - 1) if band else (band,):
            k, skipped, _ = self.parts(b)
            salt = (seed * 0x9E3779B97F4A7C15 + b * 0xD1B54A32D192ED03 + 1) % (1 << 64)
            part = (mix(own ^ U(salt)) % U(k)).astype(np.int64)
            n = np.bincount(part, minlength=k)
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(n)
            sums = np.zeros(k, U)
            sums[at] = np.add.reduceat(mix(own + U(salt))[order], np.concatenate(([0], np.cumsum(n[at])[:-1])))
            sign = mix(sums + mix(np.arange(k, dtype=U) + U(salt)))
            if skipped:  # what is smaller than the (skipped + 1)th smallest; equal parts are of one size, so both sets skip alike
                sign = sign[n >= np.partition(n, skipped)[skipped]]
            out.append(sign)
            bands.append(np.full(len(sign), b, U))
        return np.concatenate(out), np.concatenate(bands)


def link_sets(sets: list[np.ndarray], near: int, of: int, query: np.ndarray | None = None, group: int = GROUP) -> np.ndarray:
    """The root (an index) of each set: sets that links connect have the same. With `query`, only links of these sets count."""
    m = len(sets)
    root = np.arange(m)
    size = np.fromiter(map(len, sets), np.int64, m)
    flat = np.concatenate(sets)
    _, ids, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[ids] > 1
    owner = np.repeat(np.arange(m), size)[shared]
    ids = ids[shared]
    _, ids = np.unique(ids, return_inverse=True)
    left = np.bincount(owner, minlength=m)
    # what only one set has can't be in an overlap: with too little left, a set links with nothing
    some = np.flatnonzero(left * of >= size * near)
    if len(some) < 2:
        return root
    ends = np.cumsum(left)
    own = [ids[ends[i] - left[i] : ends[i]] for i in range(m)]
    first = np.array([sets[i][0] for i in some])
    some = some[np.lexsort((size[some], first))]
    lined = np.concatenate([own[i] for i in some])
    starts = np.concatenate(([0], np.cumsum(left[some])[:-1]))
    wide = len(times)
    asks = np.ones(len(some), bool) if query is None else query[some]
    for g in range(0, len(some), group):
        inside = some[g : g + group]
        union = np.zeros(wide, bool)
        union[np.concatenate([own[i] for i in inside])] = True
        bound = np.add.reduceat(union[lined], starts, dtype=np.int64)
        opens = asks & (bound * (near + of) >= near * (size[some] + size[inside].min()))
        if query is None:
            opens[:g] = False  # these groups have asked this one's sets already
        found = np.flatnonzero(opens)
        if not len(found):
            continue
        for k, s in enumerate(inside.tolist()):
            at = found[(root[some[found]] != root[s]) & ((found > g + k) if query is None else True)]
            if not len(at):
                continue
            mark = np.zeros(wide, bool)
            mark[own[s]] = True
            asked = some[at]
            over = np.add.reduceat(mark[np.concatenate([own[i] for i in asked])], np.concatenate(([0], np.cumsum(left[asked])[:-1])), dtype=np.int64)
            for q in asked[over * (near + of) >= near * (size[asked] + size[s])].tolist():
                a, b = sorted((int(root[q]), int(root[s])))
                if a != b:
                    root[root == b] = a
    return root


def _longs(*cols) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == U else c) for c in cols]


DEALT = "part int, kind int, packed binary"
ROWS, COUNTS, LINKS = 0, 1, 2


def _packed(sign: np.ndarray, band: np.ndarray, which: np.ndarray, names: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A batch's signatures, dealt to `parts` by the signature, 13 bytes each; what several sets of the batch share is a single row.

    A row is name and band (8 bytes), and 39 bits of the signature with a mark of those that the batch itself has more
    than once (5 bytes). Fewer bits can make strangers candidates, and are checked later; they can't part what belongs
    together. The further holders of a signature are counted here, and linked with the first.
    """
    order = np.argsort(sign, kind="stable")
    sign, band, which = sign[order], band[order], which[order]
    new = np.concatenate(([True], sign[1:] != sign[:-1]))
    runs = np.diff(np.append(np.flatnonzero(new), len(sign)))
    hub = np.repeat(which[new], runs)
    key = names[which] << U(BAND_BITS) | band
    part = (sign >> U(40)) % U(parts)
    mine = sign[new] % U(1 << SIGN_BITS) << U(1) | (runs > 1).astype(U)
    rows = np.empty((len(mine), ROW), np.uint8)
    rows[:, :8] = key[new].view(np.uint8).reshape(-1, 8)
    rows[:, 8:] = mine.view(np.uint8).reshape(-1, 8)[:, :5]
    to = part[new].astype(np.int64)
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    ends = np.append(starts[1:], len(to))
    out = [(int(to[a]), ROWS, rows[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    if not new.all():
        keys, n = np.unique(key[~new], return_counts=True)
        links = np.unique(np.stack([names[which[~new]], names[hub[~new]]], 1), axis=0)
        home = int(sign[0] % U(parts))
        out += [(home, COUNTS, np.stack([keys, n.astype(U)], 1).tobytes()), (home, LINKS, links.tobytes())]
    for a in range(0, len(out), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 64], strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "kind", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The signature rows, counts and links of one partition."""
    held: dict[int, list[bytes]] = {ROWS: [], COUNTS: [], LINKS: []}
    for batch in batches:
        for kind, packed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            held[kind].append(packed.as_py())
    return b"".join(held[ROWS]), *(np.frombuffer(b"".join(held[k]), U).reshape(-1, 2) for k in (COUNTS, LINKS))


def _met(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of one partition of signatures: how many of them each name and band shares, dealt by the name; and what they connect."""
    raw, counts, links = _unpacked(batches)
    raw = np.frombuffer(raw, np.uint8).reshape(-1, ROW)
    key = np.ascontiguousarray(raw[:, :8]).view(U)[:, 0]
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw[:, 8:]
    sign = wide.view(U)[:, 0]
    del raw, wide
    order = np.lexsort((key, sign >> U(1)))
    key, sign = key[order], sign[order]
    mark, sign = (sign & U(1)).astype(bool), sign >> U(1)
    if len(key):
        new = np.concatenate(([True], sign[1:] != sign[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(sign)))
        differs = np.concatenate(([True], key[1:] != key[:-1])) | new
        names = np.add.reduceat(differs.astype(np.int64), start)
        marked = np.logical_or.reduceat(mark, start)
        shared = np.repeat((names > 1) | marked, size) & differs
        keys, n = np.unique(key[shared], return_counts=True)
        counts = np.concatenate([counts, np.stack([keys, n.astype(U)], 1)])
        hub = key[np.repeat(start, size)]
        apart = differs & (key >> U(BAND_BITS) != hub >> U(BAND_BITS))
        links = np.concatenate([links, np.stack([key[apart] >> U(BAND_BITS), hub[apart] >> U(BAND_BITS)], 1)])
    out = []
    for kind, pairs, by in ((COUNTS, counts, counts[:, 0] >> U(BAND_BITS)), (LINKS, (found := forest(links)), found[:, 0])):
        to = (mix(by) % U(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        pairs, to = pairs[order], to[order]
        ends = np.searchsorted(to, np.arange(parts + 1))
        out += [(i, kind, pairs[ends[i] : ends[i + 1]].tobytes()) for i in range(parts) if ends[i] < ends[i + 1]]
    for a in range(0, len(out), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 64], strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "kind", "packed"])


def _enough(batches: Iterator[pa.RecordBatch], needs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(name, null) of names that share enough signatures in a band, and links (u, v): those that have come as a forest, at most one for each name."""
    _, counts, links = _unpacked(batches)
    links = forest(links)
    key, at = np.unique(counts[:, 0], return_inverse=True)
    total = np.bincount(at, counts[:, 1].astype(np.int64), len(key)) if len(key) else np.zeros(0)
    names = np.unique(key[total >= needs[(key & BAND).astype(np.int64)]] >> U(BAND_BITS)).view(np.int64)
    for a in range(0, len(names), 100_000):
        part = names[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.int64())], ["u", "v"])
    for a in range(0, len(links), 100_000):
        yield pa.RecordBatch.from_arrays(_longs(*links[a : a + 100_000].T), ["u", "v"])


def _part_count(spark, n_tokens: int, bands: Bands) -> int:
    """Partitions of the dealt signatures, of about TASK_ROWS each."""
    share = 3.5 * (bands.of - bands.near) / bands.of  # a set has about three signatures for each token that may differ
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_tokens * share) // TASK_ROWS + 1)


def _candidates(dealt: DataFrame, bands: Bands, parts: int) -> tuple[DataFrame, DataFrame]:
    """(name) of the sets that share enough signatures to link with any other, and (node, component) of names by shared signatures."""
    needs = np.array(bands.needs())
    met = map_batches(dealt.repartition(parts, "part"), lambda batches: _met(batches, parts), DEALT)
    found = written(map_batches(met.repartition(parts, "part"), lambda batches: _enough(batches, needs), "u long, v long"), "ngram-met")
    return found.where("v is null").select(F.col("u").alias("name")).distinct(), components(found.where("v is not null"))


def short_name(name_b: Column) -> Column:
    """What stands for a set among signatures. Two sets of one short name can only make more candidates, and no link is found by it."""
    return name_b.bitwiseAND(F.lit((1 << NAME_BITS) - 1))


def set_rows(docs: DataFrame, doc: Column, text: Column, n: int) -> DataFrame:
    """id, text_hash, n, and name_a, name_b (null for an empty set) of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [], []
            for raw in batch.column(2):
                own = tokens(raw.as_py(), n)
                sizes.append(len(own))
                names.append(name_of(own) if len(own) else (None, None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1))], ["id", "text_hash", "n", "name_a", "name_b"])

    return map_batches(docs.select(doc.alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")), run, "id long, text_hash long, n long, name_a long, name_b long")


def _doc_signatures(docs: DataFrame, text: Column, n: int, bands: Bands, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[int, int], int] = {}
        signs: list[np.ndarray] = []
        of_band: list[np.ndarray] = []
        held = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            if signs:
                which = np.repeat(np.arange(len(signs)), [len(x) for x in signs])
                yield from _packed(np.concatenate(signs), np.concatenate(of_band), which, np.fromiter((b % (1 << NAME_BITS) for _, b in names), U, len(names)), parts)
            names.clear()
            signs.clear()
            of_band.clear()

        for batch in batches:
            for raw in batch.column(0):
                own = tokens(raw.as_py(), n)
                if len(own) and (name := name_of(own)) not in names:
                    names[name] = len(names)
                    sign, band = bands.signatures(own, 0)
                    signs.append(sign)
                    of_band.append(band)
                    held += len(sign)
                    if held >= TASK_ROWS // 2:
                        yield from dealt()
                        held = 0
        yield from dealt()

    return map_batches(docs.select(text.alias("text")), run, DEALT)


def _candidate_sets(docs: DataFrame, doc: Column, text: Column, n: int, wanted: DataFrame) -> DataFrame:
    """node, comp, n, tokens (bytes) of the candidates in `wanted` (node, id, text_hash, name_a, name_b, comp), from a row that has such a text."""
    given = docs.select(doc.alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    own = _few(wanted.select(F.col("id").alias("of"), F.col("text_hash").alias("hash"), "node", "comp", "name_a", "name_b"))
    met = given.join(own, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of a task; those of several tasks meet in a unit
        for batch in batches:
            out: list[tuple] = []
            nodes, comps, a, b = (batch.column(i).to_pylist() for i in range(1, 5))
            for i, raw in enumerate(batch.column(0)):
                if nodes[i] not in seen and name_of(own := tokens(raw.as_py(), n)) == (a[i], b[i]):
                    seen.add(nodes[i])
                    out.append((nodes[i], comps[i], len(own), own.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["node", "comp", "n", "tokens"])

    return map_batches(met.select("text", "node", "comp", "name_a", "name_b"), run, "node long, comp long, n long, tokens binary")


def _asking(folder: str, comp: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Nodes and tokens of the sets that ask a component, file by file."""
    store, base = pafs.FileSystem.from_uri(folder)
    found = store.get_file_info(pafs.FileSelector(f"{base}/comp={comp}", allow_not_found=True, recursive=True))
    for path in sorted(x.path for x in found if x.path.endswith(".parquet")):
        with store.open_input_file(path) as file:
            rows = pq.ParquetFile(file).read(["node", "tokens"])
        yield rows["node"].to_pylist(), rows["tokens"].to_pylist()


def _resolve_units(rows: DataFrame, total: int, near: int, of: int, keys: list[str], asking: str | None = None) -> DataFrame:
    """u, v: star edges of what links connect within each unit (rows that agree in `keys`, `total` tokens in all), by the token-group matrix. With `asking`, a folder of sets by component (the first key), only links between these and each unit count."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_TOKENS + 1)
    dealt = rows.select(*keys, "node", "tokens").repartition(parts, *keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, sets = None, [], []

        def linked(nodes: list[int], sets: list[np.ndarray], query: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                name = np.array(nodes, np.int64)
                root = name[link_sets(sets, near, of, query)]
                apart = root != name
                if apart.any():
                    yield pa.RecordBatch.from_arrays(_longs(name[apart], root[apart]), ["u", "v"])

        def done() -> Iterator[pa.RecordBatch]:
            if not asking:
                yield from linked(nodes, sets)
            elif nodes:
                held = set(nodes)
                for asks, tokens_of in _asking(asking, unit[0]):
                    guests = {x: np.frombuffer(t, U) for x, t in zip(asks, tokens_of, strict=True) if x not in held}
                    both = [*nodes, *guests]
                    yield from linked(both, [*sets, *guests.values()], np.isin(both, asks))

        for batch in batches:
            k = len(keys)
            key = list(zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True))
            own = batch.column(k).to_pylist()
            for i, raw in enumerate(batch.column(k + 1)):
                if key[i] != unit:
                    yield from done()
                    unit, nodes, sets = key[i], [], []
                if nodes and nodes[-1] == own[i]:  # a node is a set: the same tokens again
                    continue
                nodes.append(own[i])
                sets.append(np.frombuffer(raw.as_py(), U))
        yield from done()

    return map_batches(dealt, run, "u long, v long")


def _split(sets: DataFrame) -> tuple[DataFrame, int, DataFrame, DataFrame, int]:
    """Rows of components that fit a unit and their tokens, rows of those that don't, the sizes of the latter and their tokens."""
    sizes = written(sets.groupBy("comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")), "ngram-sizes")
    is_large = (F.col("members") > UNIT_SETS) | (F.col("total") > UNIT_TOKENS)
    large = sizes.where(is_large)
    small_tokens, large_tokens = (int(x) for x in sizes.agg(*(F.coalesce(F.sum(F.when(c, F.col("total"))), F.lit(0)) for c in (~is_large, is_large))).head())
    names = large.select("comp")
    return sets.join(names, "comp", "left_anti"), small_tokens, sets.join(names, "comp", "left_semi"), large, large_tokens


def _refined(large: DataFrame, bands: Bands, seed: int, n_tokens: int) -> DataFrame:
    """The sets with finer candidate components: a link has to share enough signatures of this seed within its component, too."""
    parts = _part_count(large.sparkSession, n_tokens, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                both = [bands.signatures(np.frombuffer(t.as_py(), U), seed) for t in some.column(2)]
                salts = np.array(some.column(1).to_pylist(), np.int64).view(U)
                which = np.repeat(np.arange(len(both)), [len(x) for x, _ in both])
                sign = mix(np.concatenate([x for x, _ in both]) + mix(salts)[which])
                yield from _packed(sign, np.concatenate([x for _, x in both]), which, np.array(some.column(0).to_pylist(), np.int64).view(U), parts)

    named = large.withColumn("name", short_name(F.xxhash64("node")))
    enough, found = _candidates(map_batches(named.select("name", "comp", "tokens"), run, DEALT), bands, parts)
    finer = written(enough.join(found.select(F.col("node").alias("name"), F.col("component").alias("finer")), "name"), "ngram-finer")
    kept = named.join(_few(finer), "name")
    return written(kept.select("node", F.xxhash64("comp", "finer").alias("comp"), "n", "tokens"), "ngram-sets")


def _few(keys: DataFrame) -> DataFrame:
    """Written rows of a few numbers each, broadcast if their count says that they are small, so that the tokens they are joined with stay where they are."""
    return F.broadcast(keys) if keys.count() * 64 <= BROADCAST_BYTES else keys


def _shape(sizes: DataFrame, members: str, total: str, name: str) -> DataFrame:
    """comp and, as `name`, how many blocks of a unit's size its sets make."""
    return sizes.select("comp", F.greatest(F.ceil(F.col(members) / UNIT_SETS), F.ceil(F.col(total) / UNIT_TOKENS)).cast("int").alias(name))


def _dealt(n: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")


def _leader_links(large: DataFrame, sizes: DataFrame, total: int, near: int, of: int) -> DataFrame:
    """u, v: links within each block of a large component, and of every member with a few leaders, who stand in all of its blocks."""
    shape = _shape(sizes, "members", "total", "blocks")
    placed = large.select("node", "comp", "tokens").join(shape, "comp")
    h = F.xxhash64("node")
    picked = written(large.groupBy("comp", F.pmod(h, F.lit(LEADERS)).alias("slot")).agg(F.min_by("node", h).alias("node")).select("node"), "ngram-leaders")
    leaders = large.select("node", "comp", "tokens").join(_few(picked), "node", "left_semi").join(shape, "comp")
    members = placed.select("comp", _dealt("blocks", 1).alias("block"), "node", "tokens")
    guests = leaders.select("comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "tokens")
    return written(_resolve_units(members.unionByName(guests), total, near, of, ["comp", "block"]), "ngram-links")


def _block_links(large: DataFrame, sizes: DataFrame, total: int, links: DataFrame, near: int, of: int) -> DataFrame:
    """u, v: what the sets that aren't in their component's main part yet link with; each is a query against all of its component, block by block."""
    found = components(links)
    placed = large.join(found, "node", "left").select("node", "comp", "n", F.coalesce("component", "node").alias("root"))
    mains = placed.groupBy("comp", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("comp").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    rest = written(placed.join(mains, "comp").where("root <> main").select("node", "comp", "n"), "ngram-rest")
    asking = written(rest.groupBy("comp").agg(F.count(F.lit(1)).alias("asks"), F.sum("n").alias("ask_tokens")), "ngram-rest")
    both = sizes.join(asking, "comp")
    shape = written(_shape(both, "members", "total", "blocks").join(_shape(both, "asks", "ask_tokens", "chunks"), "comp"), "ngram-rest")
    asks = large.join(_few(rest.select("node")), "node").join(_few(shape), "comp").select("comp", _dealt("chunks", 2).alias("chunk"), "node", "tokens")
    folder = new_path(large.sparkSession, "ngram-asks")
    asks.repartition("comp", "chunk").write.partitionBy("comp", "chunk").parquet(folder)
    members = large.join(_few(shape), "comp").select("comp", _dealt("blocks", 1).alias("block"), "node", "tokens")
    return written(_resolve_units(members, total, near, of, ["comp", "block"], folder), "ngram-links")


def _set_links(docs: DataFrame, doc: Column, text: Column, n: int, near: int, of: int, classes: DataFrame, n_tokens: int) -> DataFrame:
    """u, v: edges between the nodes of different sets that links connect."""
    bands = Bands(near, of)
    parts = _part_count(docs.sparkSession, n_tokens, bands)
    enough, found = _candidates(_doc_signatures(docs, text, n, bands, parts), bands, parts)
    named = classes.withColumn("name", short_name(F.col("name_b"))).join(enough, "name").join(found.select(F.col("node").alias("name"), F.col("component").alias("comp")), "name")
    wanted = written(named.select("node", "id", "text_hash", "name_a", "name_b", "comp"), "ngram-wanted")
    candidates = written(_candidate_sets(docs, doc, text, n, wanted), "ngram-sets")

    small, few, large, sizes, left = _split(candidates)
    links = written(_resolve_units(small, few, near, of, ["comp"]), "ngram-links")
    for seed in range(1, REFINEMENTS + 1):
        if not left:
            break
        small, few, large, sizes, left = _split(_refined(large, bands, seed, left))
        links = links.unionByName(written(_resolve_units(small, few, near, of, ["comp"]), "ngram-links"))
    if left:
        large = written(large, "ngram-sets")
        by_leader = _leader_links(large, sizes, left, near, of)
        links = links.unionByName(by_leader).unionByName(_block_links(large, sizes, left, by_leader, near, of))
    return links


def link_components(docs: DataFrame, n: int = 5, near: int = 80, of: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for each input row.

    Two documents link if of * intersection >= near * union of their n-gram sets; component_id is the smallest id that
    links reach, the document's own included. Texts without words (null, empty) have empty sets and link with nothing.
    Rows of one id are one document: what any of its texts links with, all of its rows are in a component with. A row
    without an id is a document of its own that hands links on; its component is the smallest id that it reaches, or
    null. Repeated rows come back as often as they came; an empty table gives no rows. Texts may be of any length.
    Columns besides id and text don't matter. near / of is over a half; near = of asks for equal sets; between 0.999
    and 1 a ValueError says that there would be too many size bands.
    """
    if not 0 < near <= of or 2 * near < of:
        raise ValueError("near / of has to be over a half and at most 1")
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary")
    sets = written(set_rows(docs, doc, text, n), "ngram-names")
    # a node is a set; its row is found again by the least id and, as an id may have several texts, by the text's hash
    hash_of_least = F.coalesce(F.min_by("text_hash", "id"), F.min("text_hash"))
    classes = sets.where("n > 0").groupBy("name_a", "name_b").agg(F.min("id").alias("id"), hash_of_least.alias("text_hash"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    # ids of several sets connect these
    of_set = F.xxhash64("name_a", "name_b")
    several = written(sets.where("id is not null").groupBy("id").agg(F.min(of_set).alias("a"), F.max(of_set).alias("b")).where("a <> b").select("id"), "ngram-several")
    mixed = bool(several.head(1))

    edges = classes.sparkSession.createDataFrame([], "u long, v long")
    if near < of:
        edges = _set_links(docs, doc, text, n, near, of, classes, int(sets.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]))
    if mixed:
        theirs = written(sets.join(several, "id", "left_semi").where("n > 0").select("id", "name_a", "name_b").distinct().join(classes.select("name_a", "name_b", "node"), ["name_a", "name_b"]).select("id", "node"), "ngram-several")
        edges = edges.unionByName(theirs.join(theirs.groupBy("id").agg(F.min("node").alias("v")), "id").select(F.col("node").alias("u"), "v"))
    roots = written(components(edges), "ngram-roots")

    # a component's smallest id; what has one set, one row and no link is its own
    tied = classes.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).where("rows > 1 or component is not null")
    least = tied.groupBy("root").agg(F.min("id").alias("least"))
    lowest = tied.select("name_a", "name_b", "root").join(least, "root").select("name_a", "name_b", "least")
    marked = sets.join(lowest, ["name_a", "name_b"], "left").select("id", "n", F.least("id", "least").alias("component_id"))
    if mixed:  # an id's rows without words go where the others go
        whole = marked.join(several, "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("whole"))
        marked = marked.join(whole, "id", "left").select("id", "n", F.coalesce("whole", "component_id").alias("component_id"))
    return marked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
