"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Each token has a fixed sparse random index vector; a token's word vector is the sum of the index vectors around it over
all documents, added up in Spark from each task's partial matrix. Tokens fall into a fixed number of hash buckets, so the
matrix has one size whatever the corpus is. A word gives two tokens: itself and its shape. A document is the mean
vector of its words and that of its shapes. The network is trained on a bounded sample of labelled rows, and its
probabilities are calibrated by a temperature chosen on labelled rows kept out of training.

Defined cases: null text is empty; an empty text is pooled to zeros and scored like any other; labelled rows without a
document, null labels and labels of held-out rows are not used; of repeated labels the least counts; with labels of one
class or none, every score is that class' share (0.5 without any); null doc_ids are scored and never held out; an empty table gives an
empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, settle, texts

BUCKETS, WIDTH, NONZERO, REACH = 1 << 14, 64, 2, 2
#: Labelled rows that training may use: those with the least hashes.
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 300, 0.02, 1e-4
#: Steps at most; the learning rate falls to zero over the steps there are, whatever the sample.
MOST_STEPS = 6_000
CUT = 0.3
CHUNK = 1 << 20


def _index() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def shape_of(word: str) -> str:
    """Upper, lower, digit and other characters as X, x, 0 and themselves, runs cut to two."""
    out = []
    for c in word:
        s = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        if out[-2:] != [s, s]:
            out.append(s)
    return "".join(out)


class Buckets(dict):
    """word -> bucket of the word * BUCKETS + bucket of its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        own = xxhash.xxh3_64_intdigest(word.lower()) % (BUCKETS * 3 // 4)
        # shapes have a quarter of the buckets to themselves
        shape = BUCKETS * 3 // 4 + xxhash.xxh3_64_intdigest(shape_of(word)) % (BUCKETS // 4)
        self[word] = both = own * BUCKETS + shape
        return both


def _tokens(batches, memory: Buckets):
    """Per chunk of documents: word buckets, shape buckets, tokens per document."""
    held, n = [], 0
    for t in batches:
        held.append(np.fromiter(map(memory.__getitem__, t.split()), np.int64))
        n += len(held[-1])
        if n >= CHUNK // 4:
            yield held
            held, n = [], 0
    if held:
        yield held


def _accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    place, sign = _index()
    total, memory = np.zeros(BUCKETS * WIDTH), Buckets()
    for batch in batches:
        for many in _tokens(batch["text"], memory):
            both = np.concatenate(many)
            owner = np.repeat(np.arange(len(many)), [len(x) for x in many])
            mixed = np.empty(2 * len(both), np.int64)
            mixed[0::2], mixed[1::2] = both // BUCKETS, both % BUCKETS
            owner = np.repeat(owner, 2)
            for by in range(1, REACH + 1):
                same = owner[by:] == owner[:-by]
                for a, b in ((mixed[:-by][same], mixed[by:][same]), (mixed[by:][same], mixed[:-by][same])):
                    for k in range(NONZERO):
                        total += np.bincount(a * WIDTH + place[b, k], sign[b, k], minlength=BUCKETS * WIDTH)
    rows = total.reshape(BUCKETS, WIDTH)
    used = np.nonzero(rows.any(axis=1))[0]
    yield pd.DataFrame({"bucket": used, "vec": pd.Series(list(rows[used].astype(np.float32)), dtype=object)})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x WIDTH, unit length. What comes to the driver is of this one size."""
    parts = texts(docs).mapInPandas(_accumulate, "bucket int, vec array<float>")
    sums = parts.groupBy("bucket").agg(*[F.sum(F.get("vec", F.lit(k)).cast("double")).alias(f"v{k}") for k in range(WIDTH)])
    rows = settle(sums, "word-vectors").toArrow().to_pandas()
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    out[rows["bucket"]] = rows.drop(columns="bucket").to_numpy()
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(batch: pd.Series, vectors: np.ndarray, memory: Buckets) -> np.ndarray:
    """One row of features per text: mean word vector, mean shape vector, their lengths, whether there are words."""
    out = []
    for many in _tokens(batch, memory):
        size = np.array([len(x) for x in many])
        both = np.concatenate(many)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        means = []
        for ids in (both // BUCKETS, both % BUCKETS):
            mean = np.zeros((len(many), WIDTH))
            if len(both):
                mean[size > 0] = np.add.reduceat(vectors[ids], first[size > 0], axis=0) / size[size > 0, None]
            means += [mean, np.linalg.norm(mean, axis=1, keepdims=True)]
        out.append(np.hstack([*means, (size > 0)[:, None], np.log1p(size)[:, None]]))
    return np.vstack(out) if out else np.zeros((0, 2 * WIDTH + 4))


class Network:
    """tanh layer, then a logistic one; standardised inputs; Adam on the cross-entropy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.shift, self.scale, self.heat = x.mean(axis=0), x.std(axis=0) + 1e-6, 1.0
        x = (x - self.shift) / self.scale
        sizes = (x.shape[1], HIDDEN, 1)
        self.w = [p for a, b in zip(sizes, sizes[1:], strict=False) for p in (rng.normal(0, a**-0.5, (a, b)), np.zeros(b))]
        m, v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        step, steps = 0, min(EPOCHS * -(-len(x) // 512), MOST_STEPS)
        while step < steps:
            order = rng.permutation(len(x))
            for at in range(0, min(len(x), 512 * (steps - step)), 512):
                part = order[at : at + 512]
                step += 1
                for k, g in enumerate(self._slopes(x[part], y[part])):
                    g = g + DECAY * self.w[k] * (self.w[k].ndim == 2)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    rate = RATE * (1 - (step - 1) / steps)
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _slopes(self, x, y):
        h = np.tanh(x @ self.w[0] + self.w[1])
        d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - y[:, None]) / len(x)
        e = (d @ self.w[2].T) * (1 - h * h)
        return x.T @ e, e.sum(axis=0), h.T @ d, d.sum(axis=0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.shift) / self.scale) @ self.w[0] + self.w[1])
        return (h @ self.w[2] + self.w[3])[:, 0]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least cross-entropy on rows the weights haven't seen."""
        z = self.logit(x)
        loss = lambda t: np.logaddexp(0, np.where(y > 0, -z, z) / t).mean()
        self.heat = min(np.geomspace(0.25, 16, 97), key=loss)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.heat, -500, 500)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def train(x: np.ndarray, y: np.ndarray):
    if len(set(y.tolist())) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    late = np.arange(len(x)) % 5 == 4
    if len(set(y[~late].tolist())) < 2:
        return Constant(float(y.mean()))
    net = Network(x[~late], y[~late])
    net.calibrate(x[late], y[late])
    return net


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, cut: float = CUT) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    held = lambda c: F.coalesce(fold_of(F.col(c), folds) == 0, F.lit(False))
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    known = labels.filter("doc_id is not null and quality is not null").filter(~held("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(MOST_LABELLED).select(F.col("doc_id").alias("labelled"), "quality", "h")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Buckets()
        for batch in batches:
            yield pd.DataFrame({"h": batch["h"], "quality": batch["quality"], "x": pd.Series(list(pooled(batch["text"], vectors.value, memory)), dtype=object)})

    rows = texts(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("text", "h", F.col("quality").cast("int").alias("quality"))
    rows = rows.groupBy("h", "quality").agg(F.min("text").alias("text"))  # one row of a repeated id, so the sample's bound holds
    got = rows.mapInPandas(features, "h long, quality int, x array<double>").toArrow().to_pandas()
    got["key"] = [np.asarray(x).tobytes() for x in got["x"]]
    got = got.sort_values(["h", "key"])
    net = train(np.vstack(got["x"]) if len(got) else np.zeros((0, 1)), got["quality"].to_numpy(float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Buckets()
        for batch in batches:
            p = net(pooled(batch["text"], vectors.value, memory))
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "held_out": batch["held_out"].to_numpy(), "score": p, "predicted": (p >= cut).astype(int)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).withColumn("held_out", held("doc_id")).mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
