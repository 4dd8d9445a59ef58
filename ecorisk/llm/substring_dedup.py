"""Substring dedup by difference-cover anchors.

Words at positions whose remainder by PERIOD is in COVER start an anchor of WINDOW - PERIOD + 1 words. Any two remainders
differ by a difference of two cover members, so two equal windows, wherever they start, hold a pair of equal anchors at
the same place. So only anchors, three of seven positions, are compared over the corpus; where one is shared, the windows
around it are, by 96-bit hashes, with the smallest doc_id that has them.

Texts are dealt to blocks by content. A block sends its distinct anchors (48 bits: they only choose what is looked at)
to buckets of the hash range, gets back those that other blocks have too, sends the windows around them with its smallest
doc_id, and gets back those that start in a smaller one elsewhere. No list of a window's documents is ever made. Equal
texts meet once: all but the smallest doc_id of them lose all words if they have a window at all.

Null text has no words. A null doc_id ranks above all others. Rows that repeat a doc_id don't remove each other's words.
Texts below WINDOW words are left as they are (words joined by single spaces). Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk.llm.common import as_rows, blocks_for, cut_by, flat_words, join_each, materialize, release, rolling, table, texts_of

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
LAST_ID = (1 << 63) - 1
POSTED = "bucket long, block long, data binary"
ANSWER = "block long, data binary"
RESULT = "digest string, first_id long, n_words long, n_removed long, kept binary"


def _as_bytes(anchors: np.ndarray) -> bytes:
    return anchors.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _as_anchors(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_ENTRY = np.dtype([("hi", "<u8"), ("lo", "<u4"), ("doc", "<i8")])


class _Block:
    """The distinct texts of a block by ascending doc_id, as one run of word hashes."""

    def __init__(self, t: pa.Table):
        best: dict[str, tuple[int, int]] = {}
        for i, (d, doc) in enumerate(zip(t.column("digest").to_pylist(), t.column("doc_id").to_pylist(), strict=True)):
            if d not in best or doc < best[d][0]:
                best[d] = doc, i
        order = sorted((doc, i, d) for d, (doc, i) in best.items())
        self.docs, self.digests = np.array([x[0] for x in order], np.int64), [x[2] for x in order]
        self.texts = texts_of(t.column("text").combine_chunks().take(pa.array([x[1] for x in order], pa.int64())), as_bytes=True)
        self.words, self.counts = flat_words(self.texts, lower=False)
        self.starts = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.docs)), self.counts)
        self.place = np.arange(len(self.words)) - self.starts[self.doc]
        self.left = self.counts[self.doc] - self.place  # words from here to the text's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, 48-bit anchors), of texts that have a window."""
        width = WINDOW - PERIOD + 1
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= width) & (self.counts[self.doc] >= WINDOW))
        return at, rolling(self.words, width, 1)[at] & np.uint64((1 << 48) - 1)

    def windows_at(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the anchors at these positions."""
        hit = np.zeros(len(self.words) + PERIOD + 1, np.int64)
        hit[anchors + 1] = 1
        hit = np.cumsum(hit)
        near = hit[PERIOD : PERIOD + len(self.words)] > hit[: len(self.words)]
        return np.flatnonzero(near & (self.left >= WINDOW))

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), _ENTRY)
        out["hi"] = rolling(self.words, WINDOW, 2)[starts] if len(starts) else 0
        out["lo"] = (rolling(self.words, WINDOW, 3)[starts] >> np.uint64(32)) if len(starts) else 0
        out["doc"] = self.docs[self.doc[starts]]
        return out


def _firsts(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by (hash, doc), and in that order the smallest doc of each one's hash."""
    order = np.lexsort((entries["doc"], entries["lo"], entries["hi"]))
    e = entries[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["hi"][1:] != e["hi"][:-1]) | (e["lo"][1:] != e["lo"][:-1])
    return order, e["doc"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(e) else np.empty(0, np.int64)


def deduped(docs: DataFrame) -> DataFrame:
    """Per distinct text: digest, first_id (its smallest doc_id), n_words, n_removed, kept (its kept words, UTF-8)."""
    given = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    given = given.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    blocks = blocks_for(docs)

    def deal(batches):
        release()
        seen: dict[str, int] = {}
        for batch in batches:
            ids, digests, kept = batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), []
            for i, (doc, d) in enumerate(zip(ids, digests, strict=True)):
                if doc < seen.get(d, LAST_ID + 1):
                    seen[d] = doc
                    kept.append(i)
            some = batch.take(pa.array(kept, pa.int64()))
            block = [int(digests[i][:12], 16) % blocks for i in kept]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *some.columns], ["block", *some.schema.names])

    dealt = given.mapInArrow(deal, "block long, doc_id long, text string, digest string")

    def post_anchors(t: pa.Table) -> pa.Table:
        own = np.unique(_Block(t).anchors()[1])
        cuts = cut_by(own, blocks, 48)
        return as_rows({"bucket": [c[0] for c in cuts], "block": [t.column("block")[0].as_py()] * len(cuts), "data": [_as_bytes(own[a:b]) for _, a, b in cuts]}, POSTED)

    def shared_anchors(t: pa.Table) -> pa.Table:
        parts = [_as_anchors(x) for x in t.column("data").to_pylist()]
        keys, block = np.concatenate(parts), np.repeat(np.array(t.column("block").to_pylist()), [len(p) for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, block = keys[order], block[order]
        same = keys[1:] == keys[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        return _answers(block[twice], keys[twice], _as_bytes)

    def post_windows(_, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t) or not len(answers):
            return as_rows({"bucket": [], "block": [], "data": []}, POSTED)
        b = _Block(t)
        at, keys = b.anchors()
        shared = np.concatenate([_as_anchors(x) for x in answers.column("data").to_pylist()])
        found = b.hashes(b.windows_at(at[np.isin(keys, shared)]))
        order, least = _firsts(found)
        e = found[order]
        first = np.ones(len(e), bool)
        first[1:] = (e["hi"][1:] != e["hi"][:-1]) | (e["lo"][1:] != e["lo"][:-1])
        e = e[first]
        cuts = cut_by(e["hi"], blocks)
        return as_rows({"bucket": [c[0] for c in cuts], "block": [t.column("block")[0].as_py()] * len(cuts), "data": [e[x:y].tobytes() for _, x, y in cuts]}, POSTED)

    def earlier_windows(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, _ENTRY) for x in t.column("data").to_pylist()]
        e, block = np.concatenate(parts), np.repeat(np.array(t.column("block").to_pylist()), [len(p) for p in parts])
        order, least = _firsts(e)
        e, block = e[order].copy(), block[order]
        late = e["doc"] > least
        e["doc"] = least
        return _answers(block[late], e[late], lambda x: x.tobytes())

    def remove(_, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return as_rows({k.split()[0]: [] for k in RESULT.split(", ")}, RESULT)
        b = _Block(t)
        at, keys = b.anchors()
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else np.empty(0, bool)
        starts = b.windows_at(at[order][twice])
        earlier = np.empty(0, _ENTRY)
        if len(answers):
            earlier = np.concatenate([np.frombuffer(x, _ENTRY) for x in answers.column("data").to_pylist()])
            if len(b.words) >= WINDOW:
                hit = np.flatnonzero(np.isin(rolling(b.words, WINDOW, 2), earlier["hi"]))
                starts = np.union1d(starts, hit[b.left[hit] >= WINDOW])
        own = b.hashes(starts)
        every = np.concatenate([own, earlier])
        order, least = _firsts(every)
        late = np.zeros(len(every), bool)
        late[order] = every["doc"][order] > least
        gone = starts[late[: len(own)]]
        edge = np.zeros(len(b.words) + WINDOW + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        covered = np.cumsum(edge)[: len(b.words)] > 0
        kept, removed = [], []
        for i, text in enumerate(b.texts):
            out = covered[b.starts[i] : b.starts[i] + b.counts[i]]
            removed.append(int(out.sum()))
            kept.append(b" ".join([w for w, x in zip(text.split(), out.tolist(), strict=True) if not x] if removed[-1] else text.split()))
        return as_rows({"digest": b.digests, "first_id": b.docs.tolist(), "n_words": b.counts.tolist(), "n_removed": removed, "kept": kept}, RESULT)

    by_block = dealt.groupBy("block")
    shared = by_block.applyInArrow(post_anchors, POSTED).groupBy("bucket").applyInArrow(shared_anchors, ANSWER)
    posted = by_block.cogroup(shared.groupBy("block")).applyInArrow(post_windows, POSTED)
    earlier = posted.groupBy("bucket").applyInArrow(earlier_windows, ANSWER)
    return by_block.cogroup(earlier.groupBy("block")).applyInArrow(remove, RESULT)


def _answers(block: np.ndarray, values: np.ndarray, pack) -> pa.Table:
    """One row for each block with what it gets."""
    order = np.argsort(block, kind="stable")
    block, values = block[order], values[order]
    at = np.flatnonzero(np.diff(block, prepend=-1))
    return as_rows({"block": block[at].tolist(), "data": [pack(v) for v in np.split(values, at[1:])] if len(at) else []}, ANSWER)


def substring_dedup(docs: DataFrame, kept: Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept text, or `kept`, an expression over the binary column
    kept, computed before rows are dealt out again."""
    value = (F.decode("kept", "UTF-8") if kept is None else kept).alias("kept_text")
    none = F.decode(F.lit(b""), "UTF-8") if kept is None else F.sha2(F.lit(b""), 256)
    found = materialize(deduped(docs).select("digest", "first_id", "n_words", "n_removed", value))
    ids = materialize(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")))
    sizes = ids.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    small = materialize(found.select("digest", "first_id", "n_words").join(sizes, "digest"))
    # copies, of which one text may have any number, meet numbers only; its words meet its first document
    rows = materialize(join_each(ids, small, "digest", "copies").withColumn("copy", (F.coalesce("doc_id", F.lit(LAST_ID)) != F.col("first_id")) & (F.col("n_words") >= WINDOW)))
    copies = rows.where("copy").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), none.alias("kept_text"))
    short = rows.where(f"NOT copy AND n_words < {WINDOW}").drop("n_words")
    first = rows.where(f"NOT copy AND n_words >= {WINDOW}").drop("n_words")
    shorts = found.where(f"n_words < {WINDOW}").drop("first_id").join(small.select("digest", "copies"), "digest")
    out = copies
    for some in (join_each(short.select("doc_id", "digest"), shorts, "digest", "copies"), first.select("doc_id", "digest").join(found, "digest")):
        out = out.unionByName(some.select("doc_id", "n_words", "n_removed", "kept_text"))
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), F.sha2("kept", 256)).withColumnRenamed("kept_text", "kept_sha256")
