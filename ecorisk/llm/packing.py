"""Packing: Karmarkar-Karp multiway differencing deals pieces of documents to near-equal windows.

Documents are cut into full windows and a rest. The rests of `GROUP` documents that one task reads in a row are packed
together: each rest starts as a partial partition of k windows; the two partitions of the largest spread are merged, the
fullest windows of one with the emptiest of the other, until one is left. k is the least number that the total allows
and rises whenever a window exceeds its capacity. Nothing is shuffled, and memory holds one group's lengths.

Null text counts as empty (one end id). Repeated rows are packed as documents of their own. An empty table gives an empty
result, extra columns are ignored, equal lengths are taken in the order read. Numbers of sequences are unique but not
dense: (partition, running number). How documents fall together depends on how the input is split into tasks: each run is a
valid packing, and a caller that reads the result more than once writes it first, as the pipeline does.
"""

from __future__ import annotations

import heapq
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ecorisk.llm.common import small_batches, table, texts_of
from ecorisk.llm.tokens import encoder

CAPACITY, GROUP, END = 2048, 256, 1
VOCABULARY = "byte_bpe_50k.json"


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of `lengths` in each of `windows` windows of near-equal sums, by multiway differencing.

    A partial partition keeps only its windows that hold something, above the least sum: (sum, items), fullest first;
    the others are empty, and all sums are relative to the emptiest.
    """
    heap = [(-n, i, [(n, (i,))]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    serial = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - windows  # windows that get something from both: a's emptiest with b's fullest
        if over > 0:
            both = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
            merged = sorted([*a[: len(a) - over], *b[: len(b) - over], *both], key=itemgetter(0), reverse=True)
        else:
            merged = sorted([*a, *b], key=itemgetter(0), reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    return [_flat(x[1]) for x in heap[0][2]] if heap else []


def _flat(items) -> list[int]:
    out, todo = [], [items]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(reversed(x))
        else:
            out.append(x)
    return out


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of indices, each sum at most `capacity`; no length may be above it."""
    windows = max(1, -(-sum(lengths) // capacity)) if lengths else 0
    while lengths:
        dealt = differencing(lengths, windows)
        if max(sum(lengths[i] for i in w) for w in dealt) <= capacity:
            return dealt
        windows += 1
    return []


SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, group: int = GROUP, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32 bits; null without `with_ids`), ids_crc32,
    doc_tokens, sequence_id, offset. A sequence is the pieces with its id by offset, padded to `capacity`."""

    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        tok = encoder(path, "space")
        rests: list[tuple] = []

        def row(doc, start, ids, total, sequence, offset):
            raw = ids.astype("<u4").tobytes()
            return doc, start, len(ids), raw if with_ids else None, zlib.crc32(raw), total, sequence, offset

        def record(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4], strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        def windows():
            nonlocal serial, rests
            rows = []
            for w in pack_lengths([len(x[2]) for x in rests], capacity):
                offset = 0
                for i in w:
                    rows.append(row(*rests[i], serial, offset))
                    offset += len(rests[i][2])
                serial += 1
            rests = []
            return rows

        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tok.encode(texts_of(batch.column("text")), end), strict=True):
                full = len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    rows.append(row(doc, start, ids[start : start + capacity], len(ids), serial, 0))
                    serial += 1
                if full < len(ids):
                    rests.append((doc, full, ids[full:].copy(), len(ids)))
                if len(rests) >= group:
                    rows += windows()
                if len(rows) >= 1000:
                    yield record(rows)
                    rows = []
            if rows:
                yield record(rows)
        if rests:
            yield record(windows())

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of all docs without their ids."""
    return pack(docs, path or public_tokenizers.path(VOCABULARY), with_ids=False).drop("ids")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
