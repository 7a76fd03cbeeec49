"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of `PASSAGE` words). Each passage is encoded by statistics of its bytes and words;
a small network embeds it, gated attention gives it a weight within its document, and the weighted sum of embeddings is
scored. Only document labels are learned from. The passage weights are an output of `score` (`with_passages`).

Learning reads a bounded sample of labelled rows (`rows`, taken by a hash of doc_id); scoring covers every row and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AT_SPACE, _cuts, _segment_words, chunks, in_fold, mix, ship, table, utf8
from .toxicity import FOLDS, labelled_sample

_U64 = np.uint64
PASSAGE = 64
#: Buckets for hashed byte pairs.
PAIRS = 32


def _byte_classes() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 space, 4 line end, 5 other white, 6 beyond ASCII, 7 control; each ASCII symbol is a class of its own."""
    out = np.full(256, 7, np.int64)
    symbol = 8
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 6
        elif c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c == " ":
            out[b] = 3
        elif c == "\n":
            out[b] = 4
        elif c.isspace():
            out[b] = 5
        elif 32 < b < 127:
            out[b] = symbol
            symbol += 1
    return out


CLASSES = _byte_classes()
N_CLASSES = int(CLASSES.max()) + 1
N_FEATURES = N_CLASSES + PAIRS + 9


def encode(text: bytes) -> np.ndarray:
    """A row of features per passage; an empty text is one passage of zeros."""
    hashes, starts, sizes, heads = [], [], [], []
    base = 0
    for part in _cuts(text, 1 << 20):
        buf = np.frombuffer(part, np.uint8)
        h, at, n = _segment_words(buf, AT_SPACE)
        hashes.append(h)
        starts.append(at + base)
        sizes.append(n)
        base += len(part)
    h, at, n = (x[0] if len(x) == 1 else np.concatenate(x) for x in (hashes, starts, sizes))
    if not h.size:
        return np.zeros((1, N_FEATURES), np.float32)
    firsts = np.arange(0, h.size, PASSAGE)
    count = firsts.size
    words = np.diff(np.append(firsts, h.size)).astype(np.float64)
    buf = np.frombuffer(text, np.uint8)
    edges = at[firsts].copy()
    edges[0] = 0
    out = np.zeros((count, N_FEATURES))
    for lo in range(0, count, 512):  # parts bound the working arrays of a very long text
        hi = min(count, lo + 512)
        a, b = edges[lo], edges[hi] if hi < count else buf.size
        own = buf[a:b]
        size = np.diff(np.append(edges[lo:hi], b))
        where = np.repeat(np.arange(hi - lo), size)
        byte = CLASSES[own]
        out[lo:hi, :N_CLASSES] = np.bincount(where * N_CLASSES + byte, minlength=(hi - lo) * N_CLASSES).reshape(-1, N_CLASSES) / size[:, None]
        pair = ((own[:-1].astype(np.int64) * 31 + own[1:]) * 40503 >> 7) % PAIRS
        out[lo:hi, N_CLASSES : N_CLASSES + PAIRS] = np.bincount(where[1:] * PAIRS + pair, minlength=(hi - lo) * PAIRS).reshape(-1, PAIRS) / size[:, None]
    rest = out[:, N_CLASSES + PAIRS :]
    total = np.add.reduceat(n.astype(np.float64), firsts)
    rest[:, 0] = total / words / 10
    rest[:, 1] = np.sqrt(np.maximum(0, np.add.reduceat(n.astype(np.float64) ** 2, firsts) / words - (total / words) ** 2)) / 10
    same = np.zeros(h.size)
    same[1:] = h[1:] == h[:-1]
    rest[:, 2] = np.add.reduceat(same, firsts) / words
    passage = np.arange(h.size) // PASSAGE
    distinct = np.unique(mix(h + passage.astype(_U64) * _U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    rest[:, 3] = np.bincount(passage[distinct], minlength=count) / words
    triple = mix(h[:-2] * _U64(3) + h[1:-1] * _U64(5) + h[2:] * _U64(7)) if h.size > 2 else h
    _, back, times = np.unique(triple, return_inverse=True, return_counts=True)
    again = np.zeros(h.size)
    again[: triple.size] = times[back] > 1
    rest[:, 4] = np.add.reduceat(again, firsts) / words
    last, first = buf[at + n - 1], buf[at]
    rest[:, 5] = np.add.reduceat((CLASSES[last] >= 8).astype(np.float64), firsts) / words
    rest[:, 6] = np.add.reduceat((CLASSES[first] == 1).astype(np.float64), firsts) / words
    rest[:, 7] = np.log1p(words) / 5
    rest[:, 8] = np.log1p(h.size) / 10
    return out.astype(np.float32)


@dataclass
class Model:
    """Parameters by name; mean and scale standardise the features."""

    p: dict[str, np.ndarray]

    def attend(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """Scores of bags and weights of passages; bags[i] is the first row of bag i."""
        p = self.p
        x = np.clip((x - p["mean"]) * p["scale"], -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        of = np.repeat(np.arange(bags.size), np.diff(np.append(bags, len(x))))
        a = np.exp(e - np.maximum.reduceat(e, bags)[of])
        a /= np.add.reduceat(a, bags)[of]
        z = np.add.reduceat(a[:, None] * h, bags)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y, a, {"x": x, "h": h, "v": v, "u": u, "of": of, "z": z}


def gradients(model: Model, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss of bags by the parameters."""
    p = model.p
    y, a, k = model.attend(x, first)
    dy = (y - labels) / len(labels)
    g = {"c": k["z"].T @ dy, "d": dy.sum()}
    dz = dy[:, None] * p["c"]
    dh = a[:, None] * dz[k["of"]]
    da = (k["h"] * dz[k["of"]]).sum(1)
    de = a * (da - np.add.reduceat(a * da, first)[k["of"]])
    g["w"] = (k["v"] * k["u"]).T @ de
    dg = de[:, None] * p["w"]
    dv, du = dg * k["u"] * (1 - k["v"] ** 2), dg * k["v"] * k["u"] * (1 - k["u"])
    g["V"], g["U"] = k["h"].T @ dv, k["h"].T @ du
    dx = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - k["h"] ** 2)
    g["W"], g["b"] = k["x"].T @ dx, dx.sum(0)
    return g


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
    """Adam on the logistic loss of document labels."""
    r = np.random.default_rng(seed)
    prior = min(0.99, max(0.01, float(labels.mean()) if labels.size else 0.5))
    p = {
        "mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "W": r.normal(0, 0.15, (N_FEATURES, hidden)), "b": np.zeros(hidden),
        "V": r.normal(0, 0.3, (hidden, gate)), "U": r.normal(0, 0.3, (hidden, gate)), "w": r.normal(0, 0.3, gate), "c": r.normal(0, 0.3, hidden), "d": np.array(np.log(prior / (1 - prior))),
    }
    model = Model(p)
    if not bags:
        return model
    every = np.concatenate(bags)
    mean = every.mean(0, dtype=np.float64)
    p["mean"], p["scale"] = mean, 1 / (np.sqrt(np.maximum(0, np.einsum("ij,ij->j", every, every, dtype=np.float64) / len(every) - mean**2)) + 0.02)
    del every
    names = ["W", "b", "V", "U", "w", "c", "d"]
    m, s = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            first = np.cumsum([0] + [len(bags[i]) for i in own])[:-1]
            g = gradients(model, np.concatenate([bags[i] for i in own]), first, labels[own])
            step += 1
            now = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for name in names:
                grad = g[name] + decay * p[name] * (name != "d")
                m[name] = 0.9 * m[name] + 0.1 * grad
                s[name] = 0.999 * s[name] + 0.001 * grad**2
                p[name] = p[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 4000, points: int = 64_000_000) -> Model:
    """Learns from at most `rows` labelled rows of at most `points` code points together; all their passages go to the driver."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in chunks(whole):
                out = [encode(text).tobytes() for text in utf8(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["doc_id", "features", "label"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("features", T.BinaryType()), T.StructField("label", T.IntegerType())])
    got = sorted(labelled_sample(docs, labels, label, rows, points).mapInArrow(run, schema).collect(), key=lambda r: (r["doc_id"], r["features"]))
    return train([np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in got], np.array([float(r["label"]) for r in got]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, with_passages: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row (and weights, the attention of each passage). Null text is empty text. No shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in chunks(whole):
                bags = [encode(x) for x in utf8(batch.column(1).to_pylist())]
                first = np.cumsum([0] + [len(x) for x in bags])
                y, a, _ = model.attend(np.concatenate(bags), first[:-1])
                out = [batch.column(0), batch.column(2), pa.array(y), pa.array((y >= threshold).astype(np.int32))]
                names = ["doc_id", "held_out", "score", "predicted"]
                if with_passages:
                    out.append(pa.array([a[i:j].tolist() for i, j in zip(first, first[1:], strict=False)], pa.list_(pa.float64())))
                    names.append("weights")
                yield pa.RecordBatch.from_arrays(out, names=names)

    fields = [docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    fields += [T.StructField("weights", T.ArrayType(T.DoubleType()))] * with_passages
    return docs.select("doc_id", "text", in_fold(F.col("doc_id"), FOLDS, 0).alias("held_out")).mapInArrow(run, T.StructType(fields))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; one pass, no join and no shuffle."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in chunks(whole):
                bags = [encode(x) for x in utf8(batch.column(at).to_pylist())]
                first = np.cumsum([0] + [len(x) for x in bags])[:-1]
                yield batch.filter(pa.array(model.attend(np.concatenate(bags), first)[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep(docs, fit(docs, table(spark, sf_dir, "labels")))
