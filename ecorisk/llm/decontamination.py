"""Benchmark decontamination by spaced seeds.

Each mask picks six of eight consecutive words and ignores the others. A window of WINDOW words in which at most
SUBSTITUTIONS differ from a benchmark item's, wherever they are, holds the words of one of the masks unchanged at some
offset. Hashes of the masked words of documents and items are joined, and around each hit the words on both sides are
compared: a document is contaminated by an item if a window that holds the hit differs in at most SUBSTITUTIONS words. Of
items of 8 to 12 words the whole text must be found unchanged. An item of fewer words is no evidence within a longer
text; it contaminates the documents that are that text and nothing else.

Words are runs of letters and digits, lower-cased, so that punctuation and layout don't matter. Only DataFrame operations
run. Null texts have no words. Repeated rows of a doc_id count as one document, rows with a null doc_id too; items
likewise. Extra columns are ignored; if either table is empty nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk.llm.common import among, materialize, table, without

MASKS, SPAN = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7)), 8
WINDOW, SUBSTITUTIONS = 13, 2
#: Texts of fewer than SPAN words; a longer text is left after its first words.
FEW = rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++){{1,{SPAN - 1}}}+[^\p{{L}}\p{{N}}]*+$"
#: Seeds (four numbers, some 64 bytes in memory) are broadcast up to this number; beyond it both sides are dealt out by seed.
BROADCAST_SEEDS = 500_000


def words(text: Column) -> Column:
    """64-bit hashes of a text's words."""
    split = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(split, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame) -> DataFrame:
    """rows (w, n, ...) once for each place and mask: at (first word of the seed, from 0) and seed."""
    placed = rows.where(F.col("n") >= SPAN).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - SPAN)))
    seeds = [F.xxhash64(F.lit(k), *[F.col("w")[F.col("at") + p] for p in mask]) for k, mask in enumerate(MASKS)]
    return placed.withColumn("seed", F.explode(F.array(*seeds)))


def _around(w: Column, at: Column, n: Column) -> tuple[Column, Column]:
    """(words within a window's reach of the seed, how many of them stand before it)."""
    before = F.least(at, F.lit(WINDOW - SPAN))
    return F.slice(w, at - before + 1, F.least(n - at + before, before + WINDOW)), before


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, w, n) of each distinct item text."""
    return benchmark.where("text IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).distinct().withColumn("n", F.size("w"))


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, item_at) of items (item, w, n): each place of each of them."""
    return _seeds(items).select("seed", "item", F.col("at").alias("item_at"))


def _whole(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_places, matched) of documents that are one of the items (item_id, w, n) and nothing else."""
    texts = docs.where(F.lower("text").rlike(FEW)).select("doc_id", words(F.col("text")).alias("w")).withColumn("whole", F.xxhash64("w"))
    named = items.select("item_id", F.xxhash64("w").alias("whole"), F.col("w").alias("item_w"))
    same = texts.join(named, "whole").where(F.col("w") == F.col("item_w"))
    return same.select("doc_id", "item_id", F.lit(1).cast("long").alias("n_places"), F.size("w").cast("long").alias("matched")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_places (alignments), matched (most equal words of a window)."""
    # a number of its own for each item text, as item ids can repeat
    items = materialize(_items(benchmark).withColumn("item", F.monotonically_increasing_id()))
    seeds_ = materialize(item_seeds(items))
    if seeds_.count() <= BROADCAST_SEEDS:
        seeds_ = F.broadcast(seeds_)
    texts = docs.where("text IS NOT NULL").select("doc_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))

    def seeds(i: Column) -> Column:
        return F.array(*[F.struct(i.alias("at"), F.xxhash64(F.lit(k), *[F.col("w")[i + p] for p in mask]).alias("seed")) for k, mask in enumerate(MASKS)])

    # rows of seeds carry no words: a long text's words beside each of its places would be the square of its length
    placed = texts.where(F.col("n") >= SPAN).select("doc_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - SPAN), seeds))).alias("s"))
    hits = materialize(placed.select("doc_id", "s.at", "s.seed").join(seeds_, "seed").drop("seed").distinct())
    some = among(docs.where("text IS NOT NULL").select("doc_id", "text"), hits).select(F.col("doc_id").alias("own_id"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    item_around, item_before = _around(F.col("w"), F.col("item_at"), F.col("n"))
    hits = hits.join(items.select("item", "item_id", "w", "n"), "item")
    hits = hits.select("doc_id", "at", "item_id", F.col("n").alias("item_n"), "item_at", item_around.alias("item_words"), item_before.alias("item_before"))
    around, before = _around(F.col("w"), F.col("at"), F.col("n"))
    hits = hits.join(some, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("at") + SPAN <= F.col("n")))
    hits = hits.select("doc_id", "item_id", "item_n", "at", "item_at", "item_words", "item_before", around.alias("doc_words"), before.alias("doc_before"))
    # both cut to the same stretch, `skip` words of which stand before the seed
    skip = F.least("doc_before", "item_before")
    of_doc = F.slice("doc_words", F.col("doc_before") - skip + 1, F.lit(2 * WINDOW))
    of_item = F.slice("item_words", F.col("item_before") - skip + 1, F.lit(2 * WINDOW))
    hits = hits.select("doc_id", "item_id", "item_n", (F.col("at") - F.col("item_at")).alias("shift"), of_doc.alias("d"), of_item.alias("i"))
    length = F.least(F.size("d"), F.size("i"))
    same = F.zip_with(F.slice("d", F.lit(1), length), F.slice("i", F.lit(1), length), lambda x, y: (x == y).cast("int"))
    hits = hits.select("doc_id", "item_id", "shift", "item_n", same.alias("same")).withColumn("m", F.size("same"))
    size = F.least("item_n", F.lit(WINDOW))

    def total(start: Column) -> Column:
        return F.aggregate(F.slice("same", start + 1, size), F.lit(0), lambda a, x: a + x)

    best = F.when(F.col("m") >= size, F.array_max(F.transform(F.sequence(F.lit(0), F.col("m") - size), total)))
    least = F.when(F.col("item_n") >= WINDOW, WINDOW - SUBSTITUTIONS).otherwise(F.col("item_n"))
    found = hits.select("doc_id", "item_id", "shift", best.alias("matched"), least.alias("least")).where("matched >= least")
    places = found.groupBy("doc_id", "item_id", "shift").agg(F.max("matched").alias("matched"))
    near = places.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_places"), F.max("matched").cast("long").alias("matched"))
    short = items.where((F.col("n") > 0) & (F.col("n") < SPAN))
    return near.unionByName(_whole(docs, short)) if short.limit(1).count() else near


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, all columns kept."""
    return without(docs, contaminated(docs, benchmark))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
