"""Language ID: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix is broadcast; texts are scored in batches, as a sum over the rows of their distinct n-grams
weighted by counts, kept per distinct word. Null texts and texts without a letter are `und` with score 0, empty tables
give empty results, ties go to the language that sorts first, repeated rows are scored alike, extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ecorisk.llm.common import held_out, materialize, slices, table, texts_of
from ecorisk.llm.subwords import ngram_features, word_table

BUCKETS, ORDERS, SMOOTHING = 1 << 15, range(1, 4), 0.5
#: Bound of the labelled rows of each language that the model is fitted on.
TRAIN_ROWS = 1000
#: Their ids are broadcast up to this number: some 30 MB.
BROADCAST_IDS = 1_000_000
#: A word character that is neither a decimal digit nor the underscore: a letter, or another number such as a fraction.
MAYBE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether the whole text has a character of a letter category."""
    return any(unicodedata.category(m[0])[0] == "L" for m in MAYBE.finditer(text))


def fit(train: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities per bucket and language) from (doc_id, text, lang); at most `rows` rows of each
    language are read, so that none is left out.

    Counting runs on the executors; the driver gets one vector of BUCKETS counts for each task and language.
    """
    known = train.where("text IS NOT NULL AND lang IS NOT NULL")
    lowest = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(lowest)).where(F.col("rank") <= rows)
    ids = materialize(ids.select("doc_id", "lang"))
    texts = known.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc_id", "lang"], "left_semi")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), texts_of(batch.column("text"))
            for a, b in slices([len(t) for t in texts], 1 << 18):
                by: dict[str, list[str]] = {}
                for lang, t in zip(langs[a:b], texts[a:b], strict=True):
                    by.setdefault(lang, []).extend(t.lower().split())
                for lang, words in by.items():
                    if words:
                        got = np.bincount(ngram_features(words, ORDERS, BUCKETS, False)[1], minlength=BUCKETS)
                        sums[lang] = sums.get(lang, 0) + got
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "counts": [x.astype("<i8").tobytes() for x in sums.values()]})

    total: dict[str, np.ndarray] = {}
    for r in texts.select("lang", "text").mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], "<i8")
    langs = sorted(total)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    counts = np.stack([total[x] for x in langs], axis=1) + SMOOTHING
    return langs, np.log(counts / counts.sum(axis=0))


def predict(docs: DataFrame, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score (posterior of lang_pred under equal priors) of every row of docs (doc_id, text)."""
    model, key = docs.sparkSession.sparkContext.broadcast(log_p), uuid.uuid4().hex

    def score(batches):
        matrix = model.value

        def words_rows(words):
            word, bucket = ngram_features(words, ORDERS, BUCKETS, False)
            return np.add.reduceat(matrix[bucket], np.searchsorted(word, np.arange(len(words))))

        words = word_table(key, words_rows, len(langs))
        for batch in batches:
            texts = texts_of(batch.column("text"))
            named = np.array([bool(langs) and has_letter(t) for t in texts], bool)
            pred, prob = np.full(len(texts), "und", object), np.zeros(len(texts))
            if named.any():
                sums, _ = words.sums([t for t, x in zip(texts, named, strict=True) if x])
                best = sums.argmax(axis=1)
                pred[named] = np.array(langs, object)[best]
                prob[named] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(prob)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document; learns from rows that are not held out."""
    langs, log_p = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), train_rows)
    return predict(docs, langs, log_p).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
