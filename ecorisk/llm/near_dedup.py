"""MinHash near-dedup by a signature-coordinate inverted join.

Documents are posted under each (coordinate, value) of their MinHash signature. Lists are counted; a document's values
are ordered rarest first, and only a prefix of them is looked into: two documents that agree on MATCHES of COORDINATES
values share one among the first COORDINATES - MATCHES + 1 of both. Documents with fewer shared values are left out. Pairs
are retained from MATCHES agreeing coordinates on and then confirmed on full shingle sets.

Lists are counted in two rounds, so that little is sent: first each block of documents announces 32 bits of each of its
values and is told which occur twice, then it posts those of the documents that have MATCHES such values.

First each document meets the smallest document of each of its lists, which joins most copies to one component; lists of
one component are then skipped. Documents of the others meet in parts bounded by rows and by shingles: signatures tell
who has a partner in another component, full sets of those are compared, and a task returns no more links than join the
components it saw. At similarity 0.75, the least that links, a pair misses the match threshold with a probability of
about one in a million.

Words are the runs between ASCII white space, A-Z lower-cased; a text of fewer than five words is one shingle, one
without words or null has none and links with nothing. Documents of equal sets count as one until the end. Rows with a
null doc_id link with nothing, have no component and are kept. Rows that repeat a doc_id with other texts are linked by
definition, and what is near to them is told by the greatest of the texts. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk.llm.common import among, as_rows, blocks_for, cut_by, flat_words, join_each, materialize, mix, odd_multipliers, release, rolling, slices, small_batches, table, texts_of, without
from ecorisk.llm.components import components

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
COORDINATES, MATCHES = 192, 114
PREFIX = COORDINATES - MATCHES + 1
#: Pairs of one document confirmed in one task; documents of one part of a list, and shingles of one part.
PAIRS, PART_ROWS, PART_SHINGLES = 512, 2048, 1 << 20
SIGNED = "doc_id long, n_shingles long, digest binary, signature binary"
_POSTED = np.dtype([("key", "<u8"), ("n", "<u4"), ("doc", "<i8")])


def shingle_sets(texts: list[bytes]):
    """The sorted distinct 64-bit shingle hashes of each text; words of about a megabyte of text are held at a time."""
    for a, b in slices([len(t) for t in texts]):
        words, counts = flat_words(texts[a:b], lower=True)
        at = 0
        for n in counts.tolist():
            own = words[at : at + n]
            at += n
            yield np.unique(rolling(own, min(WIDTH, n), 11)) if n else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of COORDINATES hash functions over a set."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    multipliers = odd_multipliers(COORDINATES, 12)[:, None]
    for k in range(0, len(shingles), 2048):
        some = ((shingles[None, k : k + 2048] * multipliers) >> np.uint64(32)).min(axis=1).astype(np.uint32)
        out = np.minimum(out, some)
    return out


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature of every document.

    A task leaves out the signature of a set that it has given for a smaller or equal doc_id already, so that a group of
    copies sends few of them; the smallest document of a set always has its signature.
    """

    def run(batches):
        release()
        given: dict[bytes, int] = {}
        for batch in batches:
            texts, ids = texts_of(batch.column("text"), as_bytes=True), batch.column("doc_id").to_pylist()
            sizes, digests, signatures = [], [], []
            for doc, own in zip(ids, shingle_sets(texts), strict=True):
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                first = digest is not None and doc is not None and (digest not in given or doc < given[digest])
                if first:
                    given[digest] = doc
                sizes.append(len(own))
                digests.append(digest)
                signatures.append(signature(own).tobytes() if first else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def _signatures(column) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<u4").reshape(len(data), COORDINATES) if data else np.empty((0, COORDINATES), np.uint32)


def _keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit name of each (coordinate, value)."""
    return mix(signatures.astype(np.uint64) | (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32))[None, :])


def _sets_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(smallest doc_id, keys) of each distinct set of a block, in the order of the sets' digests."""
    digests = np.frombuffer(b"".join(t.column("digest").to_pylist()), "<u8").reshape(-1, 2)
    ids = np.array(t.column("doc_id").to_pylist(), np.int64)
    order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (digests[order][1:] != digests[order][:-1]).any(axis=1)
    order = order[new]
    return ids[order], _keys(_signatures(t.column("signature").combine_chunks().take(pa.array(order))))


def _short(keys: np.ndarray, bucket: int, buckets: int) -> bytes:
    """32 bits of each of a bucket's ascending keys, highest bytes first: these hardly take any room when compressed."""
    width = ((1 << 64) + buckets - 1) // buckets
    left = (keys - np.uint64(bucket * width)) >> np.uint64(max(0, width.bit_length() - 32))
    return np.ascontiguousarray(np.minimum(left, np.uint64(0xFFFFFFFF)).astype(">u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _long(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(">u4").ravel().astype(np.uint32)


def _merged(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, then doc; index of each one's list; the lists: key, total, least doc)."""
    order = np.lexsort((entries["doc"], entries["key"]))
    e = entries[order]
    first = np.flatnonzero(np.diff(e["key"], prepend=~e["key"][:1]) != 0) if len(e) else np.empty(0, np.int64)
    lists = e[first].copy()
    if len(e):
        lists["n"] = np.minimum(np.add.reduceat(e["n"].astype(np.int64), first), 0xFFFFFFFF)
    index = np.repeat(np.arange(len(first)), np.diff([*first, len(e)]))
    return order, index, lists


def postings(every: DataFrame, blocks: int) -> DataFrame:
    """(key, doc, n, hub) of the prefix of each distinct set that shares at least MATCHES values: lists of two and more only.

    A block of documents sends each of its values once, with a count and its smallest document, so that no list's
    members meet in one task. Values of documents that share fewer than MATCHES aren't posted: they have no partner.
    """
    posted, answer, out = "bucket long, block long, data binary", "block long, bucket long, data binary", "key long, doc long, n long, hub long"

    def announce(t: pa.Table) -> pa.Table:
        keys = np.unique(_sets_of(t)[1])
        cuts = cut_by(keys, blocks)
        return as_rows({"bucket": [c[0] for c in cuts], "block": [t.column("block")[0].as_py()] * len(cuts), "data": [_short(keys[a:b], k, blocks) for k, a, b in cuts]}, posted)

    def repeated(t: pa.Table) -> pa.Table:
        parts = [_long(x) for x in t.column("data").to_pylist()]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        marks = np.split(twice, np.cumsum([len(p) for p in parts])[:-1])
        return as_rows({"block": t.column("block").to_pylist(), "bucket": t.column("bucket").to_pylist(), "data": [np.packbits(m).tobytes() for m in marks]}, answer)

    def post(_, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return as_rows({"bucket": [], "block": [], "data": []}, posted)
        ids, keys = _sets_of(t)
        distinct, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        shared, at = n > 1, at.reshape(keys.shape)
        marks = dict(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))
        for k, a, b in cut_by(distinct, blocks):
            shared[a:b] |= np.unpackbits(np.frombuffer(marks[k], np.uint8), count=b - a).astype(bool)
        shared = shared[at]
        shared &= (shared.sum(axis=1) >= MATCHES)[:, None]
        e = np.zeros(int(shared.sum()), _POSTED)
        e["key"], e["n"], e["doc"] = keys[shared], 1, np.repeat(ids, shared.sum(axis=1))
        lists = _merged(e)[2]
        cuts = cut_by(lists["key"], blocks)
        return as_rows({"bucket": [c[0] for c in cuts], "block": [t.column("block")[0].as_py()] * len(cuts), "data": [lists[a:b].tobytes() for _, a, b in cuts]}, posted)

    def count(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, _POSTED) for x in t.column("data").to_pylist()]
        e, block = np.concatenate(parts), np.repeat(np.array(t.column("block").to_pylist()), [len(p) for p in parts])
        order, index, lists = _merged(e)
        told, block = lists[index], block[order]
        told, block = told[told["n"] > 1], block[told["n"] > 1]
        order = np.argsort(block, kind="stable")
        told, block = told[order], block[order]
        at = np.flatnonzero(np.diff(block, prepend=-1))
        return as_rows({"block": block[at].tolist(), "bucket": [0] * len(at), "data": [x.tobytes() for x in np.split(told, at[1:])] if len(at) else []}, answer)

    def choose(_, t: pa.Table, answers: pa.Table) -> pa.Table:
        empty = as_rows({"key": [], "doc": [], "n": [], "hub": []}, out)
        if not len(t) or not len(answers):
            return empty
        lists = np.concatenate([np.frombuffer(x, _POSTED) for x in answers.column("data").to_pylist()])
        lists = lists[np.argsort(lists["key"])]
        ids, keys = _sets_of(t)
        at = np.minimum(np.searchsorted(lists["key"], keys), len(lists) - 1)
        n = np.where(lists["key"][at] == keys, lists["n"][at], 1)
        rows = np.flatnonzero((n > 1).sum(axis=1) >= MATCHES)
        if not len(rows):
            return empty
        keys, at, n, ids = keys[rows], at[rows], n[rows], ids[rows]
        prefix = np.lexsort((keys, n), axis=1)[:, :PREFIX]
        keys, at, n = [np.take_along_axis(x, prefix, axis=1) for x in (keys, at, n)]
        doc = np.repeat(ids, PREFIX).reshape(n.shape)
        shared = n > 1
        return as_rows({"key": keys[shared].astype(np.int64).tolist(), "doc": doc[shared].tolist(), "n": n[shared].tolist(), "hub": lists["doc"][at[shared]].tolist()}, out)

    # blocks are dealt out by digest, so that a set's copies meet in one
    dealt = every.where("signature IS NOT NULL").select(F.pmod(F.xxhash64("digest"), F.lit(blocks)).alias("block"), "doc_id", "digest", "signature")
    by_block = dealt.groupBy("block")
    marked = by_block.applyInArrow(announce, posted).groupBy("bucket").applyInArrow(repeated, answer)
    told = by_block.cogroup(marked.groupBy("block")).applyInArrow(post, posted).groupBy("bucket").applyInArrow(count, answer)
    return by_block.cogroup(told.groupBy("block")).applyInArrow(choose, out)


def _signed(every: DataFrame, ids: DataFrame) -> DataFrame:
    return among(every.where("signature IS NOT NULL").select("doc_id", "signature"), ids)


def matching(pairs: DataFrame, every: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree on MATCHES coordinates."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    signed = _signed(every, ids)
    of = [signed.select(F.col("doc_id").alias(c), F.col("signature").alias(f"sign_{c}")) for c in "ab"]

    def run(batches):
        for batch in batches:
            agree = (_signatures(batch.column("sign_a")) == _signatures(batch.column("sign_b"))).sum(axis=1) >= MATCHES
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(agree))

    return pairs.join(of[0], "a").join(of[1], "b").mapInArrow(run, "a long, b long").distinct()


def _texts(places: DataFrame, docs: DataFrame) -> DataFrame:
    """places (place, doc_id) with each document's text; of rows that repeat an id, one."""
    texts = among(docs.select("doc_id", "text"), places)
    return places.join(texts.groupBy("doc_id").agg(F.max("text").alias("text")), "doc_id")


def _sets(found: pa.Table) -> dict[int, np.ndarray]:
    """The shingle set of each document of (doc_id, text)."""
    if not len(found):
        return {}
    return dict(zip(found.column("doc_id").to_pylist(), shingle_sets(texts_of(found.column("text").combine_chunks(), as_bytes=True)), strict=True))


def confirmed(pairs: DataFrame, docs: DataFrame, blocks: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. A document's pairs are dealt out PAIRS at a time."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("parts"))
    dealt = pairs.join(sizes, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    dealt = materialize(dealt.select("a", "b", "part", F.pmod(F.xxhash64("b", "part"), F.lit(4 * blocks)).alias("block")))
    needed = _texts(dealt.select(F.col("block").alias("place"), F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)

    def compare(_, found: pa.Table, named: pa.Table) -> pa.Table:
        sets, out_a, out_b = _sets(found), [], []
        for a, b in zip(named.column("a").to_pylist(), named.column("b").to_pylist(), strict=True):
            x, y = sets[a], sets[b]
            if DENOMINATOR * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
                continue
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if DENOMINATOR * common >= NUMERATOR * (len(both) - common):
                out_a.append(a)
                out_b.append(b)
        return as_rows({"a": out_a, "b": out_b}, "a long, b long")

    return needed.groupBy("place").cogroup(dealt.select("a", "b", "block").groupBy("block")).applyInArrow(compare, "a long, b long")


_MEETING = "block long, hub long, i int, j int, doc long, component long, part int"


def _meetings(t: pa.Table):
    """Of the rows of a block: (rows that meet, their documents, components, parts, whether one part meets itself)."""
    cols = {c: np.array(t.column(c).to_pylist(), np.int64) for c in ("hub", "i", "j", "doc", "component", "part")}
    order = np.lexsort((cols["doc"], cols["j"], cols["i"], cols["hub"]))
    name = np.stack([cols[c][order] for c in ("hub", "i", "j")])
    for rows in np.split(order, np.flatnonzero((np.diff(name, axis=1) != 0).any(axis=0)) + 1):
        if len(rows):
            yield rows, cols["doc"][rows], cols["component"][rows], cols["part"][rows], cols["i"][rows[0]] == cols["j"][rows[0]]


def _others(k: int, component: np.ndarray, part: np.ndarray, alone: bool) -> np.ndarray:
    """The documents after the k-th that are of other components and, where two parts meet, of the other part."""
    return np.flatnonzero((component[k + 1 :] != component[k]) & (alone | (part[k + 1 :] != part[k]))) + k + 1


def across(posted: DataFrame, labels: DataFrame, every: DataFrame, blocks: int) -> DataFrame:
    """The documents (and where they meet) that agree on MATCHES coordinates with one of another component, found in lists
    of several components.

    Lists with the same smallest document are looked through together, so that a signature is dealt out once for most of
    a document's lists. Such a group is cut into parts, any two of which meet; how many documents and shingles a part has
    is bounded, and so are the rows that a meeting returns, however many of its pairs agree.
    """
    of = posted.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("key", "hub", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = of.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    sizes = every.where("signature IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg(F.max("n_shingles").alias("n_shingles"))
    left = materialize(of.join(mixed, "key").select("hub", "doc", "component").distinct().join(sizes, "doc"))
    parts = left.groupBy("hub").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PART_ROWS, F.sum("n_shingles") / PART_SHINGLES)).cast("int").alias("parts"))
    left = left.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("hub", "doc", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(4 * blocks)))
    dealt = dealt.join(_signed(every, left.select(F.col("doc").alias("doc_id"))).withColumnRenamed("doc_id", "doc"), "doc")

    def compare(t: pa.Table) -> pa.Table:
        signs, kept = _signatures(t.column("signature")), []
        for rows, _, component, part, alone in _meetings(t):
            own, agrees = signs[rows], np.zeros(len(rows), bool)
            for k in range(len(rows) - 1):
                other = _others(k, component, part, alone)
                hit = other[(own[other] == own[k]).sum(axis=1) >= MATCHES] if len(other) else other
                agrees[hit] = True
                agrees[k] |= len(hit) > 0
            kept.append(rows[agrees])
        return t.take(pa.array(np.concatenate(kept))).select([x.split()[0] for x in _MEETING.split(", ")])

    return dealt.groupBy("block").applyInArrow(compare, _MEETING).distinct()


def joined(meeting: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join components whose documents meet and are similar enough: full sets are compared.

    A document's shingles are counted against all others of the meeting at once. Components that a meeting has joined
    are one from then on, so that it returns fewer links than it has documents.
    """
    needed = _texts(meeting.select(F.col("block").alias("place"), F.col("doc").alias("doc_id")).distinct(), docs)

    def compare(_, found: pa.Table, t: pa.Table) -> pa.Table:
        sets, out_a, out_b = _sets(found), [], []
        for _, doc, component, part, alone in _meetings(t) if len(t) else ():
            own, component = [sets[d] for d in doc.tolist()], component.copy()
            counts = np.array([len(x) for x in own])
            shingles, owner = np.concatenate(own), np.repeat(np.arange(len(own)), counts)
            order = np.argsort(shingles, kind="stable")
            shingles, owner = shingles[order], owner[order]
            for k, x in enumerate(own):
                other = _others(k, component, part, alone)
                if not len(other):
                    continue
                first, last = np.searchsorted(shingles, x, "left"), np.searchsorted(shingles, x, "right")
                n = last - first
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                common = np.bincount(owner[at], minlength=len(own))[other]
                for y in other[DENOMINATOR * common >= NUMERATOR * (counts[other] + len(x) - common)].tolist():
                    if component[y] != component[k]:
                        component[component == component[y]] = component[k]
                        out_a.append(int(doc[k]))
                        out_b.append(int(doc[y]))
        return as_rows({"a": out_a, "b": out_b}, "a long, b long")

    return needed.groupBy("place").cogroup(meeting.groupBy("block")).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    small_batches(docs.sparkSession)
    every = materialize(sign(docs))
    blocks = blocks_for(docs, row_bytes=8 * COORDINATES)
    posted = materialize(postings(every, blocks))

    hubs = materialize(posted.where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct())
    tried = materialize(matching(hubs, every))
    links = materialize(confirmed(tried, docs, blocks))
    labels = components(links)
    meeting = materialize(across(posted, labels, every, blocks))
    links = links.union(joined(meeting, docs))
    # rows that repeat a doc_id with another text tie the sets they have
    full = every.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    first = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    own = materialize(join_each(full.select("doc_id", "n_shingles", "digest"), first, "digest", "copies").select("doc_id", "n_shingles", "first_id", "copies"))
    tied = own.groupBy("doc_id").agg(F.min("first_id").alias("a"), F.max("first_id").alias("b")).where("a < b").select("a", "b")
    labels = components(links.union(tied))
    sized = labels.join(first.groupBy("first_id").agg(F.max("copies").alias("copies")), labels["node"] == F.col("first_id"))
    moved = materialize(sized.where("component <> first_id").select("first_id", F.col("component").alias("component_id"), "copies"))
    tied_rows = join_each(among(own, moved, ("first_id",)).drop("copies"), moved, "first_id", "copies").select("doc_id", "n_shingles", "component_id")
    others = without(own, moved, ("first_id",)).select("doc_id", "n_shingles", F.col("first_id").alias("component_id"))
    alone = every.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return tied_rows.union(others).union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with the first document of each component, all columns kept."""
    return without(docs, near_duplicates(docs).where("NOT kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
