"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams and of the word itself, a text's vector the
mean of its words', so a misspelling that was never seen shares most vectors with the word it distorts. Null and empty
texts have the zero vector and so the score of the bias. Without labels of both kinds every score is 0. Repeated rows
score alike, extra columns are ignored, an empty table gives an empty result.

Executors turn the labelled texts into sparse bags; the driver is sent the counts of the buckets by class, then of each
bag the trained buckets alone, so that it holds numbers bounded by TRAIN_ROWS and never a text. Of labelled rows that
repeat a doc_id one text is learned from.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk.llm.common import bounded_rows, held_out, materialize, small_batches, table, texts_of
from ecorisk.llm.subwords import ngram_features, word_table

BUCKETS, ORDERS, DIM = 1 << 18, range(3, 6), 8
#: Bound of the labelled rows of each class that the model is fitted on.
TRAIN_ROWS = 2000
#: Buckets whose presence in toxic and other training texts differs by so many standard errors are trained; the vectors
#: of the others stay zero, else rare n-grams would learn single texts by heart. At least LEAST_KEPT are trained.
SIGNIFICANCE, LEAST_KEPT = 5.0, 200
#: Texts are means of many words; this brings their vectors to the size of one word's.
SCALE = 50.0
THRESHOLD = 0.7
#: Tasks that count buckets, each of which sends the driver two vectors of BUCKETS numbers.
TASKS = 8


@dataclass
class Model:
    used: np.ndarray  # trained buckets, ascending; the vectors of all others are zero
    embeddings: np.ndarray  # len(used) x DIM
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def bucket_logits(self) -> np.ndarray:
        """What the vector of each trained bucket adds to the toxic logit less the other one."""
        return SCALE * (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0]))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ascending; the share that each has in the mean of the whole text's words)."""
    split = text.lower().split()
    if not split:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    words, counts = np.unique(np.array(split, object), return_counts=True)
    word, bucket = ngram_features(list(words), ORDERS, BUCKETS, True)
    share = (counts / counts.sum() / np.bincount(word, minlength=len(words)))[word]
    own, at = np.unique(bucket, return_inverse=True)
    return own.astype(np.int32), np.bincount(at, weights=share).astype(np.float32)


def telling(presence: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Mask over the buckets: those that tell the classes apart. presence: texts of each class that hold a bucket (2 x
    buckets), totals: texts of each class."""
    p = (presence.sum(axis=0) + 1) / (totals.sum() + 2)
    rates = presence / totals[:, None]
    z = np.abs((rates[1] - rates[0]) / np.sqrt(p * (1 - p) * (1 / totals).sum()))
    return z >= min(SIGNIFICANCE, np.partition(z, -LEAST_KEPT)[-LEAST_KEPT])


def train(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, labels: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Embeddings and softmax fitted together by full-batch Adam on the class-weighted cross entropy.

    (row, bucket, weight) are the entries of the texts' bags, labels the texts' classes, both of which must occur.
    """
    labels, n = np.asarray(labels, float), len(labels)
    used, col = np.unique(bucket, return_inverse=True)
    weight = np.asarray(weight, float) * SCALE
    rng = np.random.default_rng(0)
    e, w, b = rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    side = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, b)]
    onehot = np.stack([1 - labels, labels], axis=1)
    for step in range(1, steps + 1):
        vectors = e @ w
        z = np.stack([np.bincount(row, weights=weight * vectors[col, k], minlength=n) for k in (0, 1)], axis=1) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - onehot) * side[:, None]
        back = np.stack([np.bincount(col, weights=weight * d[row, k], minlength=len(used)) for k in (0, 1)], axis=1)
        grads = (back @ w.T + decay * e, e.T @ back + decay * w, d.sum(axis=0))
        for x, g, m in zip((e, w, b), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Model(used, e, w, b)


def bags(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic, buckets, weights) of at most `rows` labelled texts of each class, none of them held out, written
    as a table. A row needs a label of 0 or 1; labels that contradict each other count as 1."""
    small_batches(docs.sparkSession)
    marked = labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    chosen = [bounded_rows(marked.where(F.col("toxic") == k).select("doc_id", "toxic"), rows) for k in (0, 1)]
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    one = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))

    def run(batches):
        for batch in batches:
            got = [bag(t) for t in texts_of(batch.column("text"))]
            data = [pa.array([x[k].tobytes() for x in got], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), *data], ["doc_id", "toxic", "buckets", "weights"])

    return materialize(one.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, buckets binary, weights binary"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """The model of at most `rows` labelled rows of each class; None without rows of both."""
    bagged = bags(docs, labels, rows).coalesce(TASKS)

    def count(batches):
        presence, totals = np.zeros((2, BUCKETS), np.int32), [0, 0]
        for batch in batches:
            for toxic, buckets in zip(batch.column("toxic").to_pylist(), batch.column("buckets").to_pylist(), strict=True):
                presence[toxic, np.frombuffer(buckets, np.int32)] += 1
                totals[toxic] += 1
        yield pa.RecordBatch.from_pydict({"toxic": pa.array([0, 1], pa.int32()), "texts": totals, "presence": [x.tobytes() for x in presence]})

    presence, totals = np.zeros((2, BUCKETS), np.int32), np.zeros(2)
    for r in bagged.select("toxic", "buckets").mapInArrow(count, "toxic int, texts long, presence binary").toLocalIterator():
        presence[r["toxic"]] += np.frombuffer(r["presence"], np.int32)
        totals[r["toxic"]] += r["texts"]
    if not totals.all():
        return None
    kept = np.packbits(telling(presence, totals)).tobytes()

    def cut(batches):
        mask = np.unpackbits(np.frombuffer(kept, np.uint8), count=BUCKETS).astype(bool)
        for batch in batches:
            pairs = [(np.frombuffer(b, np.int32), np.frombuffer(w, np.float32)) for b, w in zip(batch.column("buckets").to_pylist(), batch.column("weights").to_pylist(), strict=True)]
            data = [pa.array([p[k][mask[p[0]]].tobytes() for p in pairs], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *data], ["doc_id", "toxic", "buckets", "weights"])

    got = sorted(((r["doc_id"], r["toxic"], r["buckets"], r["weights"]) for r in bagged.mapInArrow(cut, bagged.schema).toLocalIterator()), key=lambda x: x[0])
    buckets = [np.frombuffer(x[2], np.int32) for x in got]
    row = np.repeat(np.arange(len(got)), [len(x) for x in buckets])
    return train(row, np.concatenate(buckets), np.concatenate([np.frombuffer(x[3], np.float32) for x in got]), np.array([x[1] for x in got]))


def _scorer(model: Model):
    """texts -> scores, to be called on executors; it carries the trained buckets' logits with it, some KB."""
    used, logits, bias, key = model.used, model.bucket_logits(), float(model.bias[1] - model.bias[0]), uuid.uuid4().hex

    def of_words(words):
        full = np.zeros(BUCKETS)
        full[used] = logits
        word, bucket = ngram_features(words, ORDERS, BUCKETS, True)
        return (np.bincount(word, weights=full[bucket]) / np.bincount(word))[:, None]

    def scores(texts: list[str]) -> np.ndarray:
        sums, n = word_table(key, of_words, 1).sums(texts)
        return 1 / (1 + np.exp(-np.clip(sums[:, 0] / np.maximum(n, 1) + bias, -500, 500)))

    return scores


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs (doc_id, text)."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    scores = _scorer(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts_of(batch.column("text"))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on) per document."""
    scored = score(docs, fit(docs, labels, train_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the rows predicted toxic, all columns kept; nothing is shuffled."""
    model = fit(docs, labels, train_rows)
    if model is None:
        return docs
    scores = _scorer(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(texts_of(batch.column("text"))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
