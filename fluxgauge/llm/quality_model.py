"""A supervised subword embedding classifier for document quality.

A document is the average of learned vectors of its features: its words and the character n-grams
in them, hashed into buckets. A softmax over the average gives the class. Vectors and output are
trained by numpy stochastic gradient descent on a bounded sample of labelled rows.

The output is linear in the average, so that scoring needs one number per bucket and class: it
looks features up and averages, without touching vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.tables import public_id
from fluxgauge.llm.text import SEGMENT, SPACE, buffer, lists, mix, slices, split_words

#: Most labelled rows the model is fitted on, those with the smallest hash: the bound of the sample.
SAMPLE = 4000
BUCKETS = 1 << 16
SIZES = (3, 4)
DIM = 16


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and of every character n-gram inside words, and its document."""
    data, offsets = buffer(column)
    words = split_words(data, offsets)
    found = [((words.hash >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)]
    owner = [words.document().astype(np.int32)]
    for a in range(0, len(data), SEGMENT):
        part = data[a : a + SEGMENT + max(SIZES) - 1].astype(np.uint64)
        blank = SPACE[part.astype(np.uint8)]
        edge = offsets[(offsets > a) & (offsets < a + len(part))] - a
        for size in SIZES:
            n = min(len(part) - size + 1, SEGMENT)
            if n <= 0:
                continue
            gram = np.zeros(n, np.uint64)
            inside = np.ones(n, bool)
            for k in range(size):
                gram |= part[k : k + n] << np.uint64(8 * k)
                inside &= ~blank[k : k + n]
                if k:
                    # The border of two documents lies before byte k of the n-gram.
                    cut = edge - k
                    inside[cut[(cut >= 0) & (cut < n)]] = False
            at = np.flatnonzero(inside)
            gram = gram[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size * 0x632BE59BD9B4E019 % 2**64)
            found.append((mix(gram) % np.uint64(buckets)).astype(np.int32))
            owner.append((np.searchsorted(offsets, at + a, side="right") - 1).astype(np.int32))
    return np.concatenate(found), np.concatenate(owner)


def bag_of_features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(label, bucket array, count array)`` per row of ``docs(text, label)``."""

    def run(batches):
        for batch in slices(batches, "text"):
            found, owner = features(batch.column("text"), buckets)
            pair, times = np.unique(owner.astype(np.int64) * buckets + found, return_counts=True)
            counts = np.bincount(pair // buckets, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"),
                    lists((pair % buckets).astype(np.int32), counts, pa.int32()),
                    lists(times.astype(np.int32), counts, pa.int32()),
                ],
                ["label", "bucket", "times"],
            )

    return docs.select("text", "label").mapInArrow(run, "label int, bucket array<int>, times array<int>")


class Embedding:
    """Vectors of buckets and a softmax output over their weighted average."""

    def __init__(self, buckets: int = BUCKETS, dim: int = DIM, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.output = np.zeros((2, dim), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.5, seed: int = 6):
        """Stochastic gradient descent, one document at a time, with a falling rate."""
        rng = np.random.default_rng(seed)
        steps, done = epochs * len(bags), 0
        for _ in range(epochs):
            for k in rng.permutation(len(bags)):
                label, bucket, times = bags[k]
                if not len(bucket):
                    done += 1
                    continue
                share = (times / times.sum()).astype(np.float32)
                own = self.vectors[bucket]
                hidden = share @ own
                logits = self.output @ hidden + self.bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[label] -= 1.0
                now = np.float32(rate * (1 - done / steps))
                back = self.output.T @ p
                self.output -= now * np.outer(p, hidden)
                self.bias -= now * 0.1 * p
                # Every feature has its share of the average; scaled so that frequent ones move.
                self.vectors[bucket] = own - now * np.minimum(share * 100, 1)[:, None] * back[None, :]
                done += 1
        return self

    def weights(self) -> tuple[np.ndarray, float]:
        """Per bucket its logit for class 1 over class 0, and the constant."""
        difference = self.output[1] - self.output[0]
        return (self.vectors @ difference).astype(np.float32), float(self.bias[1] - self.bias[0])


def sampled(docs: DataFrame, labels: DataFrame, label: str, train, sample: int) -> DataFrame:
    """``(text, label)`` of at most ``sample`` labelled rows for which ``train`` holds.

    The sample is those with the smallest hash of the id; its ids, bounded by ``sample``, are
    broadcast, so that only its texts are shuffled. Of an id on many rows the text with the smallest
    hash is taken, and copies are left out before the shuffle.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train)
        .dropDuplicates(["doc_id"])
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text")).alias("row"))
    return one.select("doc_id", "row.text", "label")


def fitted(docs: DataFrame, labels: DataFrame, train, sample: int = SAMPLE, buckets: int = BUCKETS) -> Embedding:
    """A model of ``labels.quality``; without labelled rows it scores everything one half."""
    rows = bag_of_features(sampled(docs, labels, "quality", train, sample), buckets).toArrow()
    bags = [
        (label, bucket.values.to_numpy(), times.values.to_numpy())
        for label, bucket, times in zip(rows["label"].to_pylist(), rows["bucket"], rows["times"])
    ]
    return Embedding(buckets).fit(sorted(bags, key=lambda b: (b[0], len(b[1]), int(b[1].sum()) if len(b[1]) else 0)))


def scored(docs: DataFrame, model: Embedding, buckets: int = BUCKETS) -> DataFrame:
    """``(id, score)`` for every row of ``docs(id, text)``: the probability of class 1.

    Texts without features, null ones included, get the score of the constant alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights())

    def run(batches):
        weight, bias = shared.value
        for batch in slices(batches, "text"):
            found, owner = features(batch.column("text"), buckets)
            total = np.bincount(owner, weights=weight[found], minlength=batch.num_rows)
            number = np.maximum(np.bincount(owner, minlength=batch.num_rows), 1)
            score = 1 / (1 + np.exp(-np.clip(total / number + bias, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], ["id", "score"])

    return docs.select("id", "text").mapInArrow(run, "id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """``doc_id, held_out, score, predicted``; ``held_out`` is a condition on ``doc_id``.

    Rows without an id are never in the sample and are scored like all others.
    """
    from fluxgauge.llm.tables import keyed

    model = fitted(docs, labels, ~held_out)
    return (
        scored(keyed(docs), model)
        .select(public_id("id").alias("doc_id"), "score")
        .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
