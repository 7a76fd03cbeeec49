"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct 32-bit hashes of its words, word pairs and pairs with one word between; a word is a run
of letters and digits, case folded. Learning goes over labelled texts one at a time with per-coordinate rates; the L1 term
keeps only the features that carry weight, so the model is a short sorted table that is broadcast inside a closure.

Learning reads a bounded sample of labelled rows (`rows`, taken by a hash of doc_id); scoring covers every row and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import AT_SYMBOL, chunks, hashed_words, in_fold, materialize, mix, ship, table, utf8

_U64 = np.uint64
FOLDS = 5


def features_of(words: np.ndarray) -> np.ndarray:
    """Distinct features of a run of word hashes."""
    return np.unique(occurrences(words)[0])


def occurrences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, pairs and skip pairs; for each the place of its last word and how many words it reaches back."""
    n = words.size
    pair = mix(words[:-1] * _U64(3) + words[1:] * _U64(5) + _U64(1))
    skip = mix(words[:-2] * _U64(7) + words[2:] * _U64(11) + _U64(2))
    found = (np.concatenate([words, pair, skip]) >> _U64(32)).astype(np.uint32)
    back = np.repeat([0, 1, 2], [n, pair.size, skip.size])
    return found, np.concatenate([np.arange(n), np.arange(1, 1 + pair.size), np.arange(2, 2 + skip.size)]), back


@dataclass
class Model:
    features: np.ndarray  #: sorted hashes with a weight
    weights: np.ndarray
    bias: float

    def filter(self) -> np.ndarray:
        """A table of 2^20 bits that drops nearly all features before the search."""
        bits = np.zeros(1 << 20, bool)
        bits[self.features >> 12] = True
        return bits


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 6, seed: int = 7) -> Model:
    """FTRL-proximal over rows of distinct features.

    A feature's gradients are below 1, so one of k rows stays within k * epochs; where that is at most `l1` its weight is 0 at every
    step, and it is left out without changing anything.
    """
    if not rows:
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0)
    every = np.concatenate(rows)
    every.sort()
    least = int(l1 // epochs) + 1
    known = np.unique(every[least - 1 :][every[least - 1 :] == every[: every.size - least + 1]])
    del every
    parts = []
    for row in rows:
        at = np.searchsorted(known, row).astype(np.int32)
        at = at[: np.searchsorted(row, known[-1], side="right")] if known.size else at[:0]
        parts.append(at[known[at] == row[: at.size]])
    z, n = np.zeros(known.size), np.zeros(known.size)
    zb = nb = 0.0
    rate = min(0.999, max(0.001, float(labels.mean())))
    prior = float(np.log(rate / (1 - rate)))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = parts[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            bias = prior - zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-max(-35.0, min(35.0, w.sum() + bias))))
            g = p - labels[i]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - step * w
            n[at] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * (bias - prior)
            nb += g * g
    held = np.flatnonzero(np.abs(z) > l1)
    z, n = z[held], n[held]
    return Model(known[held], -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), prior - zb / ((beta + np.sqrt(nb)) / alpha))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, points: int) -> DataFrame:
    """doc_id, text, label of labelled documents outside the held-out fold, the first by a hash of doc_id.

    At most `rows` documents of at most `points` code points together, so that what is learned from is bounded in bytes as well.
    Labels that are null are left out; of repeated labels of one document the larger counts, of repeated rows the largest text.
    """
    order = F.xxhash64("doc_id"), F.col("doc_id")
    taken = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, 0))
    taken = taken.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).orderBy(*order).limit(rows)
    taken = materialize(taken, "sample")  # at most `rows` short rows, so the broadcast is bounded
    found = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "_label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    found = materialize(found.select("doc_id", "text", "_label"), "sample")
    sizes = found.select("doc_id", F.length("text").alias("n"))  # as many short rows
    within = sizes.withColumn("n", F.sum("n").over(Window.orderBy(*order))).filter(F.col("n") <= points).select("doc_id")
    return found.join(F.broadcast(within), "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 10_000, points: int = 64_000_000) -> Model:
    """Learns from at most `rows` labelled rows of at most `points` code points together; their distinct features go to the driver."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in chunks(whole):
                texts = utf8(batch.column(1).to_pylist(), lower=True)
                out = [features_of(h[o[i] : o[i + 1]]).tobytes() for a, e, h, o in hashed_words(texts, AT_SYMBOL) for i in range(e - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["doc_id", "features", "label"])

    sample = labelled_sample(docs, labels, label, rows, points)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("features", T.BinaryType()), T.StructField("label", T.IntegerType())])
    got = sorted(sample.mapInArrow(run, schema).collect(), key=lambda r: (r["doc_id"], r["features"]))
    return ftrl([np.frombuffer(r["features"], np.uint32) for r in got], np.array([float(r["label"]) for r in got]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get the bias alone. No shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        bits = model.filter()
        for whole in batches:
            for batch in chunks(whole):
                texts = utf8(batch.column(1).to_pylist(), lower=True)
                out = np.full(len(texts), model.bias)
                for first, end, hashes, offsets in hashed_words(texts, AT_SYMBOL):
                    if not hashes.size or not model.features.size:
                        continue
                    found, last, back = occurrences(hashes)
                    hit = np.flatnonzero(bits[found >> 12])
                    found, last, back = found[hit], last[hit], back[hit]
                    at = np.minimum(np.searchsorted(model.features, found), model.features.size - 1)
                    real = model.features[at] == found
                    at, last, back = at[real], last[real], back[real]
                    doc = np.searchsorted(offsets, last, side="right") - 1
                    inside = last - back >= offsets[doc]  # pairs do not reach over the end of a text
                    once = np.unique(doc[inside] * model.features.size + at[inside])
                    out[first:end] += np.bincount(once // model.features.size, model.weights[once % model.features.size], end - first)
                p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select("doc_id", "text", in_fold(F.col("doc_id"), FOLDS, 0).alias("held_out")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
