"""URL filters by a cascade of Bloom filters.

Rules are keys, host and path together. Level 1 encodes the listed keys; level 2 those keys of the corpus that level 1
takes for listed but aren't; level 3 the listed keys that level 2 takes for such; and so on until a level has no false
positive. As the levels are made over every key that the corpus can ask for, the answer for these is exact: a key is
listed if the first level that lacks it is an even one. Judging the corpus then joins nothing.

Keys are dealt to shards by a hash, so many that each level of a shard's cascade stays within a bound; the corpus is
judged by one shard's cascades after another. Lists of any length are judged in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, map_batches, written

#: Bits per key and hashes at level 1, and at the further levels, which hold few keys.
FIRST, FURTHER = (12, 8), (6, 4)
#: Bits of one level that are broadcast at once (32 MB, on average over the shards); a longer list makes more shards.
MOST_BITS = 1 << 28
#: Bits that one task sets together.
CHUNK = 1 << 20
LOWER = str.maketrans(UPPER, UPPER.lower())


def parse(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    path_end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    slash = rest.find("/", 0, path_end)
    if slash < 0:
        return rest[:path_end].translate(LOWER), ""
    return rest[:slash].translate(LOWER), rest[slash:path_end]


@dataclass(frozen=True)
class Shape:
    """Which labels a rule's host has and how long its path is: only such keys need be asked for."""

    labels: tuple[int, ...]
    lengths: tuple[int, ...]

    def keys(self, host: str, path: str) -> list[str]:
        """The url's keys, longest first; of equally long ones, that with the longer host first."""
        if not host:
            return []
        at = len(host)
        hosts = []
        for n in range(1, self.labels[-1] + 1 if self.labels else 0):
            at = host.rfind(".", 0, at)
            if n in self.labels:
                hosts.append(host[at + 1 :])
            if at < 0:
                break
        found = [(h + path[:n], len(h)) for h in hosts for n in self.lengths if n <= len(path)]
        return [k for k, _ in sorted(found, key=lambda x: (-len(x[0]), -x[1]))]


def positions(keys: list[str], seed: int, bits: int, hashes: int) -> np.ndarray:
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass"), seed) for k in keys), "<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        at = h[:, :1] + np.arange(hashes, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))
    return at % np.uint64(bits)


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    hashes: int
    table: bytes

    def has(self, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at = positions(keys, self.seed, self.bits, self.hashes)
        table = np.frombuffer(self.table, np.uint8)
        return ((table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def listed(levels: list[Level], keys: list[str]) -> np.ndarray:
    """Whether each key is listed; exact for keys of the universe that the levels were made over."""
    out = np.zeros(len(keys), bool)
    open_ = np.arange(len(keys))
    for i, level in enumerate(levels):
        hit = level.has([keys[j] for j in open_.tolist()])
        out[open_[~hit]] = i % 2 == 1
        open_ = open_[hit]
    out[open_] = len(levels) % 2 == 1
    return out


def level_of(keys: DataFrame, n: int, seed: int, per_key: int, hashes: int) -> Level:
    """A Bloom filter of the column `key`, its bits set chunk by chunk on the executors."""
    bits = max(64, -(-n * per_key // 8) * 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = np.unique(positions(batch.column(0).to_pylist(), seed, bits, hashes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // CHUNK), pa.array(at % CHUNK)], ["chunk", "at"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(CHUNK, np.uint8)
        own[rows["at"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "bytes": [np.packbits(own, bitorder="little").tobytes()]})

    dealt = map_batches(keys.select("key"), deal, "chunk long, at long")
    table = bytearray(-(-bits // CHUNK) * CHUNK // 8)
    for r in dealt.groupBy("chunk").applyInPandas(fill, "chunk long, bytes binary").collect():  # bits / 8 bytes, bounded by the number of shards
        table[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = r.bytes
    return Level(seed, bits, hashes, bytes(table[: bits // 8]))


def build(wanted: DataFrame, universe: DataFrame) -> list[Level]:
    """The cascade that tells the keys of `wanted` from the rest of `universe` (both: column key)."""
    inside = written(wanted.select("key").distinct(), "cascade")
    outside = written(universe.select("key").distinct().join(inside, "key", "left_anti"), "cascade")
    levels: list[Level] = []
    while n := inside.count():
        per_key, hashes = FURTHER if levels else FIRST
        level = level_of(inside, n, 0x9E37 + len(levels), per_key, hashes)
        shared = inside.sparkSession.sparkContext.broadcast(level)

        def wrong(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(shared.value.has(batch.column(0).to_pylist())))

        levels.append(level)
        inside, outside = written(map_batches(outside, wrong, "key string"), "cascade"), inside
    return levels


def shard_of(key: str, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"), 0x5348) % shards


def dealt(keys: DataFrame, shards: int) -> DataFrame:
    """The keys with their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shard_of(k, shards) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32())], ["key", "shard"])

    return map_batches(keys.select("key"), run, "key string, shard int")


def candidates(pages: DataFrame, shape: Shape) -> DataFrame:
    """Every different key that the urls (column url) ask for: the universe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for u in batch.column(0).to_pylist() for k in shape.keys(*parse(u))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["key"])

    return map_batches(pages.select("url"), run, "key string").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, keep: list[str], url_col: str = "url", default: str = "allow", most_bits: int = MOST_BITS) -> DataFrame:
    """The `keep` columns, host, path, rule and verdict of each row.

    `rules`: (verdict, rule) pairs or a table with these columns; verdict allow or block, rule a host and a path prefix.
    A rule fits its host and all subdomains if the path starts with the rule's; the longest that fits decides, and
    `default` where none does. Null urls and those without :// have an empty host and path, and no rule; urls of any
    length are parsed whole, and repeated rows are judged each. A rule given with both verdicts, a null one or another
    verdict is an error; no rules or an empty table are fine. `keep` may have columns of any name.
    """
    spark = pages.sparkSession
    given_rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, rule string")
    listed_rules = written(given_rules.select("verdict", F.col("rule").alias("key")).distinct(), "cascade")
    bad = listed_rules.where("verdict is null or verdict not in ('allow', 'block') or key is null").head(1)
    if bad or listed_rules.groupBy("key").count().where("count > 1").head(1):
        raise ValueError("each rule has one verdict, allow or block")
    cut = F.instr("key", "/")
    host = F.when(cut > 0, F.substring("key", F.lit(1), cut - 1)).otherwise(F.col("key"))
    measured = listed_rules.select((F.size(F.split(host, "[.]", -1))).alias("labels"), (F.char_length("key") - F.char_length(host)).alias("length"))
    # the different numbers of labels, and of characters of a path, of all rules: sets of small integers
    shape = Shape(*(tuple(sorted(r[0] for r in measured.select(c).distinct().collect())) for c in ("labels", "length")))
    given = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(f"`{url_col}`").alias("url"))
    counts = {r.verdict: r["count"] for r in listed_rules.groupBy("verdict").count().collect()}
    shards = max(1, -(-max(counts.values(), default=0) * FIRST[0] // most_bits))
    universe = written(dealt(candidates(given, shape), shards), "cascade")
    own_rules = written(dealt(listed_rules, shards).join(listed_rules, "key"), "cascade")

    best = "struct<at:int,key:string,verdict:string>"
    rows = given.withColumn("best", F.lit(None).cast(best))
    kind = given.schema["kept"].dataType.simpleString()
    for shard in range(shards):
        cascades = {v: build(own_rules.where((F.col("shard") == shard) & (F.col("verdict") == v)), universe.where(F.col("shard") == shard)) for v in ("allow", "block")}
        shared = spark.sparkContext.broadcast(cascades)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, shard=shard) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                keys = [shape.keys(*parse(u)) for u in batch.column(1).to_pylist()]
                flat = sorted({k for own in keys for k in own if shards == 1 or shard_of(k, shards) == shard})
                verdict_of = {}
                for verdict, levels in known.items():
                    verdict_of |= {k: verdict for k, yes in zip(flat, listed(levels, flat).tolist(), strict=True) if yes}
                found = []
                for own, had in zip(keys, batch.column(2).to_pylist(), strict=True):
                    at = next((i for i, k in enumerate(own) if k in verdict_of), None)
                    found.append(had if at is None or had and had["at"] < at else {"at": at, "key": own[at], "verdict": verdict_of[own[at]]})
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.struct([("at", pa.int32()), ("key", pa.string()), ("verdict", pa.string())]))], ["kept", "url", "best"])

        rows = map_batches(rows, run, f"kept {kind}, url string, best {best}")
        if shard < shards - 1:
            rows = written(rows, "cascade")
    return rows.select(*(F.col(f"kept.`{c}`") for c in keep), *_host_and_path(F.col("url")), F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _host_and_path(url: Column) -> tuple[Column, Column]:
    """What parse() gives, as columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")
