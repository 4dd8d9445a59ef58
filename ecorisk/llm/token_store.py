"""Token-ID output: raw id payloads in shards, with a minimal perfect hash index from document keys to offsets.

A shard is two files. `.ids` is nothing but ids, little-endian, 16 bits where the vocabulary fits, else 32. `.idx` is a
JSON line, filled up to HEAD bytes, that names the places of the parts after it: `keys` (64 bits, ascending, null ones
first), `starts` (64 bits, one more than documents), the bits of the hash's levels with the number of set bits before each
BLOCK of them, and `slots`: for each key the number of its first document, how many documents have it, and a fingerprint
(32 bits each). A key's shard is found among the shards' first keys, its slot from a few bytes of each level, of which
there are few; the fingerprint tells absent keys. So a key costs a constant number of short reads, whatever the shard holds.

Documents stand in ascending doc_id order within and across shards. Null text is encoded as empty: the end id alone.
Repeated keys keep a payload each, the index leads to all of them. Null keys can be read in order but not by key. An empty
table gives no shards and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ecorisk.llm.common import blocks_for, materialize, mix, shared_dir, table, texts_of
from ecorisk.llm.files import open_file, written
from ecorisk.llm.tokens import encoder

VOCABULARY, END = "word_bpe_49k.json", 2
#: Slots per key of a level of the hash: the more, the fewer levels.
LOAD = 2.0
#: Bytes of text that a shard should hold. Shards are written and read as streams, so that they can be large.
SHARD_BYTES = 128 << 20


def _seeded(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) + mix(np.array([seed + 1], np.uint64)))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: in each level the keys that have a slot to themselves are settled."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            slots = _seeded(keys, len(levels)) % np.uint64(max(1, int(LOAD * len(keys))))
            alone = np.bincount(slots.astype(np.int64), minlength=max(1, int(LOAD * len(keys)))) == 1
            levels.append(alone)
            keys = keys[~alone[slots.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level settles it (the key was not in the build)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_seeded(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_seeded(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


HEAD, BLOCK = 4096, 512
_SLOT = np.dtype([("number", "<u4"), ("documents", "<u4"), ("print", "<u4")])


def write_index(out, keys: list[int | None], starts: np.ndarray, width: int) -> None:
    nulls = sum(k is None for k in keys)
    ids = np.array([0 if k is None else k for k in keys], "<i8")
    distinct, first, n = np.unique(ids[nulls:], return_index=True, return_counts=True)
    perfect = PerfectHash.build(distinct.astype(np.uint64))
    slots = np.zeros(len(distinct), _SLOT)
    at = perfect.slots(distinct.astype(np.uint64))
    slots["number"][at], slots["documents"][at], slots["print"][at] = first + nulls, n, fingerprints(distinct.astype(np.uint64))
    parts = {"keys": ids, "starts": starts.astype("<i8"), "slots": slots}
    for k, bits in enumerate(perfect.levels):
        parts[f"rank{k}"] = (perfect.before[k] + np.concatenate([[0], np.cumsum(np.add.reduceat(bits, np.arange(0, len(bits), BLOCK)))[:-1]])).astype("<u4")
        parts[f"bits{k}"] = np.packbits(bits)
    places, end = {}, HEAD
    for name, part in parts.items():
        places[name] = [end, part.nbytes]
        end += part.nbytes
    head = json.dumps({"documents": len(ids), "nulls": nulls, "keys": len(distinct), "width": width, "levels": [len(x) for x in perfect.levels], "places": places}).encode()
    if len(head) >= HEAD:
        raise ValueError("the index has too many levels for its head")
    out.write(head.ljust(HEAD - 1) + b"\n")
    for part in parts.values():
        out.write(part.tobytes())


class Shard:
    """A shard opened for reading by short reads of the parts that a question needs; `uri` is without the suffixes."""

    def __init__(self, uri: str):
        self.uri = uri
        self.index, self.payload = open_file(uri + ".idx"), open_file(uri + ".ids")
        self.head = json.loads(self._read(self.index, 0, HEAD))
        self.dtype = f"<u{self.head['width']}"

    @staticmethod
    def _read(file, at: int, n: int) -> bytes:
        file.seek(at)
        data = file.read(n)
        if len(data) < n:
            raise ValueError("the shard is cut off")
        return data

    def part(self, name: str, dtype, first: int = 0, n: int | None = None) -> np.ndarray:
        """n values of a part from the first on, or all of them."""
        at, size = self.head["places"][name]
        width = np.dtype(dtype).itemsize
        n = size // width - first if n is None else min(n, size // width - first)
        return np.frombuffer(self._read(self.index, at + first * width, n * width), dtype)

    def slot(self, key: int) -> int:
        """Slot of a key, -1 where no level settles it: of each level looked at, one block of bits and its rank are read."""
        k = np.array([key], np.int64).astype(np.uint64)
        for level, n in enumerate(self.head["levels"]):
            at = int(_seeded(k, level)[0] % np.uint64(n))
            bits = np.unpackbits(self.part(f"bits{level}", "u1", at // BLOCK * (BLOCK // 8), BLOCK // 8))
            if bits[at % BLOCK]:
                return int(self.part(f"rank{level}", "<u4", at // BLOCK, 1)[0]) + int(bits[: at % BLOCK].sum())
        return -1

    def find(self, key: int) -> tuple[int, int] | None:
        """(number of the first document with this key, how many have it), None if there is none."""
        slot = self.slot(key)
        if slot < 0:
            return None
        number, documents, mark = self.part("slots", _SLOT, slot, 1)[0]
        return (int(number), int(documents)) if mark == fingerprints(np.array([key], np.int64).astype(np.uint64))[0] else None

    def find_all(self, keys: np.ndarray) -> np.ndarray:
        """Entries (number, documents, print) of many keys, from the whole index read once; absent keys are left out."""
        u = keys.astype(np.int64).astype(np.uint64)
        perfect = PerfectHash([np.unpackbits(self.part(f"bits{k}", "u1"), count=n).astype(bool) for k, n in enumerate(self.head["levels"])])
        at = perfect.slots(u)
        entries = self.part("slots", _SLOT)[at[at >= 0]]
        return entries[entries["print"] == fingerprints(u[at >= 0])]

    def ids(self, number: int, documents: int = 1) -> list[np.ndarray]:
        """The ids of consecutive documents, from one read."""
        edges = self.part("starts", "<i8", number, documents + 1)
        w = self.head["width"]
        raw = self._read(self.payload, int(edges[0]) * w, int(edges[-1] - edges[0]) * w)
        return np.split(np.frombuffer(raw, self.dtype), edges[1:-1] - edges[0])

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this key."""
        found = self.find(key)
        return self.ids(*found) if found else []


def write(docs: DataFrame, path: str, end: int = END, folder: str | None = None) -> DataFrame:
    """Writes all docs (doc_id, text) as shards; returns (shard, uri, documents, nulls, first_key, tokens), where shards
    are numbered in the order of their keys, no two of which have a key in common."""
    folder = folder or shared_dir(docs.sparkSession)

    def run(batches):
        shard = TaskContext.get().partitionId()
        uri, keys, lengths, width, out = f"{folder}/shard-{shard:06d}", [], [], 4, None
        tok = encoder(path, "words")
        width = 2 if max(tok.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        with written(uri + ".ids") as out:
            for batch in batches:
                keys += batch.column("doc_id").to_pylist()
                for ids in tok.encode(texts_of(batch.column("text")), end):
                    lengths.append(len(ids))
                    out.write(ids.astype(f"<u{width}").tobytes())
        with written(uri + ".idx") as out:
            write_index(out, keys, np.concatenate([[0], np.cumsum(lengths)]), width)
        nulls = sum(k is None for k in keys)
        first = pa.array([keys[nulls] if nulls < len(keys) else None], pa.int64())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "documents": [len(keys)], "nulls": [nulls], "first_key": first, "tokens": [int(sum(lengths))]})

    rows = docs.select("doc_id", "text").repartitionByRange(blocks_for(docs, SHARD_BYTES), "doc_id").sortWithinPartitions("doc_id")
    return materialize(rows.mapInArrow(run, "shard long, uri string, documents long, nulls long, first_key long, tokens long")).where("documents > 0")


LOOKED_UP = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of payload read at a time where documents that are asked for stand side by side.
READ_BYTES = 8 << 20


def _described(shard: Shard, base: int, numbers: np.ndarray):
    """Batches of LOOKED_UP rows of the documents with these ascending numbers; side by side ones share a read."""
    starts, keys, nulls = shard.part("starts", "<i8"), shard.part("keys", "<i8"), shard.head["nulls"]
    first = 0
    while first < len(numbers):
        last = first + 1
        while last < len(numbers) and numbers[last] == numbers[last - 1] + 1 and (starts[numbers[last] + 1] - starts[numbers[first]]) * shard.head["width"] <= READ_BYTES:
            last += 1
        some = numbers[first:last]
        ids = shard.ids(int(some[0]), len(some))
        crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        docs = pa.array(keys[some], pa.int64(), mask=some < nulls)
        yield pa.RecordBatch.from_arrays([docs, pa.array(base + starts[some]), pa.array([len(x) for x in ids], pa.int64()), pa.array(crcs, pa.int64())], names=[f.split()[0] for f in LOOKED_UP.split(", ")])
        first = last


def _manifest(shards: DataFrame) -> list[tuple]:
    """(uri, first key, nulls, ids of all shards before it) in order: one small row for each shard of SHARD_BYTES."""
    out, before = [], 0
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):
        out.append((r["uri"], r["first_key"], r["nulls"], before))
        before += r["tokens"]
    return out


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of the documents with the keys in `keys`
    (doc_id), by way of each shard's hash. Keys go to the shard whose range they are in; those that it lacks give nothing."""
    listed = [x for x in _manifest(shards) if x[1] is not None]
    if not listed:
        return keys.sparkSession.createDataFrame([], LOOKED_UP)
    firsts = np.array([x[1] for x in listed], np.int64)

    def deal(batches):
        for batch in batches:
            at = np.searchsorted(firsts, batch.column("doc_id").to_numpy(zero_copy_only=False), "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(at)], ["doc_id", "place"]).filter(pa.array(at >= 0))

    def answer(t: pa.Table) -> pa.Table:
        uri, _, _, base = listed[t.column("place")[0].as_py()]
        shard = Shard(uri)
        found = shard.find_all(t.column("doc_id").to_numpy())
        numbers = np.sort(np.repeat(found["number"].astype(np.int64) - (np.cumsum(found["documents"], dtype=np.int64) - found["documents"]), found["documents"]) + np.arange(int(found["documents"].sum())))
        batches = list(_described(shard, base, numbers))
        return pa.Table.from_batches(batches) if batches else pa.table([pa.array([], pa.int64())] * 4, names=[f.split()[0] for f in LOOKED_UP.split(", ")])

    asked = keys.where("doc_id IS NOT NULL").select("doc_id").distinct()
    return asked.mapInArrow(deal, "doc_id long, place long").groupBy("place").applyInArrow(answer, LOOKED_UP)


def unnamed(shards: DataFrame) -> DataFrame:
    """The same of the documents without a key, which stand first."""
    listed = [(uri, nulls, base) for uri, _, nulls, base in _manifest(shards) if nulls]

    def run(batches):
        for uri, nulls, base in (x for b in batches for x in zip(*[c.to_pylist() for c in b.columns], strict=True)):
            yield from _described(Shard(uri), base, np.arange(nulls))

    files = shards.sparkSession.createDataFrame(listed, "uri string, nulls long, base long").repartition(max(1, len(listed)))
    return files.mapInArrow(run, LOOKED_UP)


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and writes all docs, then looks every one of them up."""
    shards = write(docs, path or public_tokenizers.path(VOCABULARY))
    return lookup(shards, docs).unionByName(unnamed(shards))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))
