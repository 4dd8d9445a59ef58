"""WARC archives through a chunked record table: no payload is held whole, digests are carried from chunk to chunk.

A record is rows (record id, chunk number, bytes). The writer streams them into gzip members, one for each record; the
reader streams archives back into such rows, each with the payload's length and SHA-1 up to its end.

Of records with equal payloads of at least `MIN_BYTES` bytes, the one with the largest page_id is a response, the others
are revisits of it without payload; smaller ones are all responses. A null payload counts as empty, a null url is written
as urn:unknown. A null page_id ranks below all others. Repeated rows are records of their own, of which equal large ones
with the largest page_id are all responses. Extra columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk.llm.common import BROADCAST_IDS, HOT, materialize, shared_dir, table
from ecorisk.llm.files import stream, written

MIN_BYTES = 1000
CHUNK_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"


def plan(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Per row of pages (page_id, url, html): length and digest of its payload and the page it refers to, if any."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    sized = pages.select("page_id", "url", payload.alias("payload"))
    sized = sized.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = sized.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    copies = materialize(large.where("n > 1"))
    if copies.count() <= BROADCAST_IDS // 4:  # payloads stay where they are
        known = sized.join(F.broadcast(copies.drop("n")), "payload_digest", "left")
    else:
        total = copies.agg(F.sum("n")).first()[0]
        hot = copies.where(F.col("n") * HOT > total).select(F.col("payload_digest").alias("_hot"), F.col("last").alias("_hot_last"))
        cold = copies.where(F.col("n") * HOT <= total).select(F.col("payload_digest").alias("_cold"), "last")
        first = sized.join(F.broadcast(hot), F.col("payload_digest") == F.col("_hot"), "left")
        # rows that need no second look get a key of their own, so that they don't gather anywhere
        key = F.when(F.col("_hot").isNull() & (F.col("payload_bytes") >= min_bytes), F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
        known = first.withColumn("_key", key).join(cold, F.col("_key") == F.col("_cold"), "left").withColumn("last", F.coalesce("_hot_last", "last"))
        known = known.select(*sized.columns, "last")
    copied = F.when((F.col("payload_bytes") >= min_bytes) & F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))
    return known.withColumn("refers_to", copied).drop("last")


def chunks(planned: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The record table: one row for each chunk of a response, one row without bytes for each revisit."""
    last = F.when(F.col("refers_to").isNull(), F.floor((F.greatest("payload_bytes", F.lit(1)) - 1) / chunk_bytes)).otherwise(0).cast("int")
    each = planned.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    data = F.when(F.col("refers_to").isNull(), F.col("payload").substr(F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return each.select("page_id", "url", "chunk", data.alias("data"), "payload_bytes", "payload_digest", "refers_to")


def _record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _header(page_id, url, length: int, digest: str, refers_to) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:unknown")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() if refers_to is None else b""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(length))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (length if refers_to is None else 0)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def write(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes record rows (a record's chunks stand together, in order) as archives; returns (uri, records)."""
    folder = folder or shared_dir(rows.sparkSession)

    def run(batches):
        uri, records, gz = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, None
        with written(uri) as out:
            for batch in batches:
                for r in zip(*[batch.column(c).to_pylist() for c in ("chunk", "data", "page_id", "url", "payload_bytes", "payload_digest", "refers_to")], strict=True):
                    if r[0] == 0:
                        if gz:
                            out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                        gz, records = zlib.compressobj(1, zlib.DEFLATED, 31), records + 1
                        out.write(gz.compress(_header(*r[2:])))
                    out.write(gz.compress(r[1]))
            if gz:
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [records]})

    return materialize(rows.mapInArrow(run, "uri string, records long")).where("records > 0")


class _Unpacked:
    """Bytes of all gzip members of a stream, as asked for."""

    def __init__(self, source, piece: int = 1 << 16):
        self.source, self.piece, self.have, self.gz, self.raw = source, piece, bytearray(), zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.gz.eof:
            self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
        self.raw = self.raw or self.source.read(self.piece)
        if not self.raw:
            return False
        self.have += self.gz.decompress(self.raw, self.piece * 4)
        self.raw = self.gz.unconsumed_tail if not self.gz.eof else b""
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark))
            if not self.more():
                return b""
        out = bytes(self.have[: found + len(mark)])
        del self.have[: found + len(mark)]
        return out

    def up_to(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def records(source, chunk_bytes: int = CHUNK_BYTES):
    """(fields, chunk number, bytes, payload length so far, SHA-1 so far, last) of each chunk of each record in a stream."""
    f = _Unpacked(source)
    while True:
        head = f.until(b"\r\n\r\n")
        if not head:
            if f.have:
                raise ValueError("the archive is cut off within a header")
            return
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if x)
        left = int(fields["Content-Length"])
        if fields["WARC-Type"] == "response" and left:
            left -= len(f.until(b"\r\n\r\n"))
        digest, seen, k = hashlib.sha1(), 0, 0
        while True:
            data = f.up_to(min(left, chunk_bytes))
            if len(data) < min(left, chunk_bytes):
                raise ValueError(f"{fields['WARC-Record-ID']} is cut off")
            left, seen = left - len(data), seen + len(data)
            digest.update(data)
            yield fields, k, data, seen, digest, not left
            k += 1
            if not left:
                break
        f.up_to(4)


READ = "page_id long, record_type string, refers_to long, chunk long, data binary, seen_bytes long, seen_digest string, last boolean, payload_bytes long, payload_digest string"


def read(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The record table of the archives listed in `archives` (uri, records): chunks with running lengths and digests.

    payload_bytes and payload_digest are those of the full payload: read for responses, as recorded for revisits; both
    are set in a record's last chunk. A response whose bytes differ from what its header says is an error, and so
    is an archive with more or fewer records than were written.
    """
    spark, names = archives.sparkSession, [x.split()[0] for x in READ.split(", ")]
    listed = [(r["uri"], r["records"]) for r in archives.select("uri", "records").collect()]  # one short row for each archive
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]

    def page(text):
        own = text and text.rstrip(">").rpartition(":")[2]
        return None if own in (None, "null") else int(own)

    def run(batches):
        for uri, count in (x for b in batches for x in zip(b.column("uri").to_pylist(), b.column("records").to_pylist(), strict=True)):
            rows, held, ended = [], 0, 0
            with stream(uri) as source:
                for fields, k, data, seen, digest, last in records(source):
                    revisit = fields["WARC-Type"] == "revisit"
                    stated = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    full = (stated if revisit else (seen, digest.hexdigest())) if last else (None, None)
                    if last and full != stated:
                        raise ValueError(f"{fields['WARC-Record-ID']} in {uri} isn't what its header says")
                    rows.append((page(fields["WARC-Record-ID"]), fields["WARC-Type"], page(fields.get("WARC-Refers-To")), k, data if with_data else None, seen, digest.hexdigest(), last, *full))
                    held += len(data) if with_data else 200
                    ended += last
                    if held > CHUNK_BYTES * 4:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
            if ended != count:
                raise ValueError(f"{uri} has {ended} records, not {count}")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.createDataFrame(listed, "uri string, records long").repartition(max(1, len(listed))).mapInArrow(run, READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes every page, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    back = read(write(chunks(plan(pages))), with_data=False).where("last")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM m
"""
