"""Document quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words and a few shape features is shared by all grades; ordered
thresholds cut its score: P(grade <= k) = sigmoid(threshold_k - score). A document is kept if
its tail probability P(grade = best) reaches ``KEEP``.

Grades from labels: 0 toxic, 1 poor quality, 2 neither. The model is fitted on a bounded sample
of labelled documents (whole texts); every document is scored over its whole text.

Defined cases: null and wordless texts have no words and are scored on shape alone; labels that
are null throughout train nothing; of several labels of a document the lowest grade counts;
without labels every document is kept; rows repeat as they are; an empty table gives an empty
result; extra columns are dropped by ``score`` and kept by ``good_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgraph.llm.bytescan import LOWER, Chunk, chunks, span_hashes

#: Bound of the training sample, in labelled documents.
SAMPLE = 6000
BUCKETS = 1 << 18
GRADES = 3
KEEP = 0.5
#: Words in fewer training documents than this carry no weight.
SEEN_IN = 8
STEPS, RATE, SHRINK = 300, 0.05, 1e-3
#: Bytes of a word's beginning that are features beside the word.
BEGINNINGS = (4, 5)
SHAPES = 6


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of words and their beginnings in each text, their offsets, and the shape features (texts x SHAPES)."""
    data = LOWER[chunk.data]
    starts, ends, of_text = chunk.words(data)
    prefix = chunk.prefix(data)
    hashes = span_hashes(prefix, starts, ends)
    text = np.repeat(np.arange(chunk.n), np.diff(of_text))
    # Words, and their beginnings, which inflected forms share.
    begun = [span_hashes(prefix, starts, np.minimum(ends, starts + n)) * np.uint64(2 * n + 1) for n in BEGINNINGS]
    bucket = (np.concatenate([hashes, *begun]) >> np.uint64(46)).astype(np.int64)
    pair = np.unique(np.tile(text, 1 + len(BEGINNINGS)) * BUCKETS + bucket)
    offsets = np.searchsorted(pair, np.arange(chunk.n + 1) * BUCKETS)
    words = np.maximum(np.diff(of_text), 1)
    raw = chunk.data
    size = np.maximum(np.diff(chunk.offsets), 1)
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[chunk.offsets])
    distinct = np.diff(np.searchsorted(np.unique(text * BUCKETS + bucket[: len(text)]), np.arange(chunk.n + 1) * BUCKETS))
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    letters = ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    repeats = np.diff(np.concatenate(([0], np.cumsum(again)))[of_text])
    shape = np.stack([
        count((raw >= 65) & (raw <= 90)) / size, count(~letters & ~space) / size, repeats / words,
        distinct / words, np.log1p(words) / 8, np.ones(chunk.n)], axis=1)
    return pair % BUCKETS, offsets, shape


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            bucket, offsets, shape = features(chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade").slice(chunk.first, chunk.n),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(bucket.astype(np.int32))),
                 pa.FixedSizeListArray.from_arrays(pa.array(shape.reshape(-1)), SHAPES).cast(pa.list_(pa.float64()))],
                ["grade", "buckets", "shape"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(grade: np.ndarray, bucket: np.ndarray, offsets: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word weights, shape weights and thresholds by gradient steps on the cumulative-link likelihood.

    Thresholds are the first one plus positive gaps, so they stay ordered.
    """
    n = len(grade)
    common = np.bincount(bucket, minlength=BUCKETS) >= SEEN_IN
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    held = common[bucket]
    place = np.cumsum(common, dtype=np.int32) - 1
    row, bucket = row[held], place[bucket[held]]
    words, shapes, cut = np.zeros(int(common.sum())), np.zeros(SHAPES), np.array([-1.0, 0.0])
    # Rare grades weigh as much as the common one's square root allows.
    share = np.bincount(grade, minlength=GRADES) / n
    weight = 1 / np.sqrt(np.maximum(share[grade], 1e-3))
    weight /= weight.sum()
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (words, shapes, cut)]
    for step in range(1, STEPS + 1):
        score = np.bincount(row, words[bucket], n) + shape @ shapes
        threshold = np.concatenate(([-np.inf], np.cumsum(np.concatenate((cut[:1], np.exp(cut[1:])))), [np.inf]))
        high, low = sigmoid(threshold[grade + 1] - score), sigmoid(threshold[grade] - score)
        high[grade == GRADES - 1], low[grade == 0] = 1.0, 0.0
        likely = np.maximum(high - low, 1e-12)
        d_high, d_low = weight * high * (1 - high) / likely, weight * low * (1 - low) / likely
        d_score = d_high - d_low
        at = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            at[k] = d_low[grade == k + 1].sum() - d_high[grade == k].sum()
        d_cut = np.append(at.sum(), np.exp(cut[1:]) * at[1:][::-1].cumsum()[::-1])
        grads = (np.bincount(bucket, d_score[row], len(words)) + SHRINK * words, shape.T @ d_score, d_cut)
        for x, g, (m, v) in zip((words, shapes, cut), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    every = np.zeros(BUCKETS, np.float32)
    every[common] = words
    return every, shapes, np.cumsum(np.concatenate((cut[:1], np.exp(cut[1:]))))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grade, bucket, sizes, shape = [], [], [], []
    for batch in batches:
        lists = batch.column("buckets")
        grade.append(batch.column("grade").to_numpy())
        bucket.append(lists.flatten().to_numpy())
        sizes.append(lists.value_lengths().to_numpy())
        shape.append(batch.column("shape").flatten().to_numpy().reshape(-1, SHAPES))
    if not grade:
        return
    made = fit(np.concatenate(grade).astype(np.int64), np.concatenate(bucket),
               np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.concatenate(shape))
    yield pa.RecordBatch.from_arrays(
        [pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in made], ["words", "shapes", "cuts"])


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels (doc_id, quality, toxic)."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 2)
    return labels.select("doc_id", grade.alias("grade")).filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("grade").alias("grade"))


def _drawn_features(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(grade, buckets, shape) of the drawn documents, made in all tasks; only these rows meet in one partition, in a fixed order."""
    rated = grades(labels).join(docs.select("doc_id").distinct(), "doc_id")
    # At most `sample` rows.
    drawn = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "grade")
    return texts.mapInArrow(_feature_rows, "grade int, buckets array<int>, shape array<double>").repartition(1).sortWithinPartitions(
        "grade", "buckets", "shape")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The model, fitted in one task on the ``sample`` labelled documents with the smallest hashes of doc_id.

    Labels without a document do not count towards the sample. None without labelled documents.
    """
    made = _drawn_features(docs, labels, sample).mapInArrow(_fitted, "words binary, shapes binary, cuts binary").collect()
    return tuple(np.frombuffer(bytes(x)) for x in made[0]) if made else None


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    words, shapes, cuts = model
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            bucket, offsets, shape = features(chunk)
            sums = np.concatenate(([0.0], np.cumsum(words[bucket])))[offsets]
            score = np.diff(sums) + shape @ shapes
            below = sigmoid(cuts[None, :] - score[:, None])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first, chunk.n), pa.array(score),
                 pa.array((1 - below).sum(axis=1)), pa.array(1 - below[:, -1])],
                ["doc_id", "score", "expected_grade", "tail_probability"])


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score, expected_grade, tail_probability, kept) for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        sure = F.lit(1.0)
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(GRADES - 1.0).alias("expected_grade"),
                           sure.alias("tail_probability"), F.lit(True).alias("kept"))
    scored = docs.select("doc_id", "text").mapInArrow(
        lambda b: _scored(b, model), f"doc_id {kind}, score double, expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= KEEP)


def _kept(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scored = pa.Table.from_batches(_scored([batch], model)) if batch.num_rows else None
        yield batch.filter(pa.array(scored["tail_probability"].to_numpy() >= KEEP)) if scored is not None else batch


def good_documents(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return docs if model is None else docs.mapInArrow(lambda b: _kept(b, model), docs.schema)
