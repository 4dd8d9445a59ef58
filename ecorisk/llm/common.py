"""What the training-data operators share: written tables, blocks, joins that stand hot keys, and words."""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk.storage import materialize, shared_dir

__all__ = ["materialize", "shared_dir"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text and rows that one block (a group worked on in memory by one Python task) should hold.
BLOCK_BYTES = 16 << 20
#: Ids that select rows are broadcast up to this number (some 50 MB); beyond it both sides are dealt out by id.
BROADCAST_IDS = 1_000_000
#: A key is hot if it has more than one of HOT of all rows: fewer than HOT keys can be.
HOT = 1000
#: Bytes of text that are split into words at a time, so that word lists stay small.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows and bytes of text that go to Python in one batch. Texts take several times their bytes there, and buffers
#: outside the heap on the JVM's side.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Makes this session hand texts to Python in small batches, unless it says smaller ones already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        number, unit = now.rstrip("kmg"), now[len(now.rstrip("kmg")) :]
        value = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
        if not 0 < value <= most:
            spark.conf.set(key, str(most))


def blocks_for(docs: DataFrame, block_bytes: int = BLOCK_BYTES, row_bytes: int = 64) -> int:
    """How many blocks the rows of docs (text, ...) are dealt into, so that a block fits in a task's memory at any size: by
    the bytes of their texts, which are counted, and `row_bytes` for each row."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + row_bytes)).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / block_bytes))


def _selected(rows: DataFrame, ids: DataFrame, keys: list[str], how: str) -> DataFrame:
    named = materialize(ids.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct())
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(F.broadcast(named) if named.count() <= BROADCAST_IDS // len(keys) ** 2 else named, same, how)


def among(rows: DataFrame, ids: DataFrame, keys: tuple = ("doc_id",)) -> DataFrame:
    """rows whose keys are among ids', null being a key like any other. Other rows stay where they are, unless ids are too
    many to broadcast."""
    return _selected(rows, ids, list(keys), "left_semi")


def without(rows: DataFrame, ids: DataFrame, keys: tuple = ("doc_id",)) -> DataFrame:
    """rows whose keys are not among ids'."""
    return _selected(rows, ids, list(keys), "left_anti")


def join_each(rows: DataFrame, per_key: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with per_key, a table with one row per key, `n` of which is about the number of rows that have the key.

    Hot keys, fewer than HOT whatever the data, are broadcast, so that none of them gathers in one task.
    """
    total = per_key.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = materialize(per_key.where(F.col(n) * HOT > total))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.where(F.col(n) * HOT <= total), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept away from fitting: crc32 of the id as text, modulo 3, is 1. A null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def bounded_rows(ids: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows, the same ones whatever the partitioning: those whose id hashes lowest."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last) of consecutive runs of rows of about `limit` bytes each."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def texts_of(column, as_bytes: bool = False) -> list:
    """The texts of an Arrow string column as str or UTF-8 bytes; null counts as empty."""
    empty = b"" if as_bytes else ""
    return [empty if x is None else x for x in (column.cast(pa.binary()) if as_bytes else column).to_pylist()]


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    if seed:
        return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
    return np.fromiter(map(digest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that each bit of the result depends on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def rolling(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes, in order; shorter input gives an empty array."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(odd_multipliers(width, seed)):
        out += h[k : k + n] * m
    return mix(out)


def flat_words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, one after another; number of words of each text)."""
    parts, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    for a, b in slices([len(t) for t in texts]):
        split = [(t.lower() if lower else t).split() for t in texts[a:b]]
        counts[a:b] = [len(x) for x in split]
        parts.append(word_hashes([w for x in split for w in x]))
    return np.concatenate(parts), counts


def as_rows(columns: dict[str, list], schema: str) -> pa.Table:
    """An Arrow table of a Spark schema with long, int, string, binary and boolean columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def cut_by(keys: np.ndarray, n: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of ascending `bits`-bit keys, where n buckets split the key range evenly."""
    width = np.uint64(((1 << bits) + n - 1) // n)
    bucket = (keys // width).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[i]), int(i), int(j)) for i, j in zip(at, [*at[1:], len(keys)], strict=True)] if len(keys) else []


_KEPT: dict = {}


def worker_cache(key, make):
    """What `make` gives, kept by this Python worker until it needs something else: one thing at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Gives what this worker keeps, and memory that its allocators hold on to, back to the machine."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """Has every executor's JVM collect its garbage and give free heap back to the machine, for the Python workers beside
    it: a heap that earlier work has filled is otherwise held for good. As many tasks as there are cores reach them all
    while they are idle; where some are busy or one is missed, nothing but memory is at stake."""
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))).collect()
