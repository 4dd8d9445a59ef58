"""Exact dedup: a persistent digest index, bucketed and sorted by hash, deduplicates new data by a sort-merge anti-join.

Only DataFrame operations. Null text counts as empty; texts are equal when identical after lower-casing A-Z. Repeated
rows are rows of the same group like any other. A null doc_id ranks below all others. Extra columns are ignored. An
empty table gives an empty result and leaves the index as it is.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk.llm.common import ascii_lower, join_each, materialize, table, without

#: Texts of the first run that a bucket of a new index should hold.
BUCKET_ROWS = 500_000


class DigestIndex:
    """A table of the digests seen, bucketed and sorted by digest, in the session's warehouse, so that later runs with the
    same name go on with it.

    Its rows are (digest, keep_id, group_size): one for each text when it is first seen, and one without keep_id for each
    later run that brought more copies of it. `read` sums them up, which shuffles nothing.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets

    def _append(self, rows: DataFrame) -> None:
        dealt = rows.repartition(self.buckets, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def _open(self, rows: int) -> None:
        """Makes the table where there is none, with buckets by the number of rows that come first."""
        if self.spark.catalog.tableExists(self.name):
            spec = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(spec["data_type"])
        else:
            self.buckets = self.buckets or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BUCKET_ROWS))
            self._append(self.spark.createDataFrame([], "digest string, keep_id long, group_size long"))

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size), one row per distinct text seen."""
        return self.spark.table(self.name).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def dedup(self, digests: DataFrame) -> DataFrame:
        """Appends the groups of `digests` (doc_id, digest) that the index lacks, and the sizes of those that it has; returns
        each row with its group. `digests` should be a written table, as it is read several times.

        Of rows new to the index the largest doc_id stays. A text that the index already held keeps the id it was
        indexed with, so that none of the new rows stays.
        """
        self._open(digests.count())
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.spark.table(self.name).select("digest")
        fresh = groups.hint("merge").join(known, "digest", "left_anti")
        more = groups.hint("merge").join(known, "digest", "left_semi").select("digest", F.lit(None).cast("long").alias("keep_id"), "group_size")
        self._append(materialize(fresh.unionByName(more)))
        return join_each(digests, self.read(), "digest", "group_size")


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole normalised text."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("digest"))


def _grouped(digests: DataFrame, index: DigestIndex | None) -> DataFrame:
    """digests with their groups, written; without an index one is made for the purpose and dropped again."""
    own = index or DigestIndex(digests.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    found = own.dedup(digests).select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    if index:
        return found
    found = materialize(found)
    own.drop()
    return found


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _grouped(materialize(text_digests(docs)), index).withColumnRenamed("digest", "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept; of rows with the same id and text one stays."""
    digests = materialize(text_digests(docs))
    found = _grouped(digests, index)
    # rows go, so that what is dealt out or broadcast are the copies alone
    gone = found.where("NOT kept").select("doc_id", F.col("digest").alias("_text"))
    own = docs.withColumn("_text", F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256))
    out = without(own, gone, ("doc_id", "_text"))
    if digests.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "_text"])
    return out.select(docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
