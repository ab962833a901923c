"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of equal word counts that cover it whole. Every passage is encoded as measures of its
style and the mean of fixed random vectors of its words. A gated attention, softmax of w.(tanh(V h) * sigmoid(U h)),
weighs the passages, and a logistic layer scores the weighted encoding; all of it is learned together from the
document's label alone. Documents are encoded and scored in batches of Arrow rows, passage by passage.

Defined cases: null, empty and white-space texts are one empty passage and get its score; null, repeated and equal ids
are scored row by row; texts of any length are encoded whole; labels, lang, source and doc_id never enter a score;
several labels of an id count as their mean, null labels not at all; other columns are ignored; without usable labels
the score is 0.5; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import wordhash
from evidentia.llm.common import ship

#: Words of a passage.
PASSAGE = 48
#: Word vectors: so many, of so many numbers each.
VECTORS, WIDTH = 4096, 16
#: Labelled documents that training reads at most, the first by a hash of the id, and passages of each, evenly spaced: 80 MB
#: of encodings on the driver at most.
TRAINING_DOCUMENTS, TRAINING_PASSAGES = 3_000, 256
_STYLES = 10
FEATURES = WIDTH + _STYLES
_table: list[np.ndarray] = []


def _vectors() -> np.ndarray:
    if not _table:
        _table.append(np.random.default_rng(7).normal(size=(VECTORS, WIDTH)).astype(np.float32))
    return _table[0]


_KINDS = np.zeros((256, 5), np.float32)
_KINDS[65:91, 0] = 1
_KINDS[48:58, 1] = 1
_KINDS[[ord(c) for c in "#*$%&|<>"], 2] = 1
_KINDS[[ord(c) for c in "!?"], 3] = 1
_KINDS[[ord(c) for c in ".,;:"], 4] = 1


def encode(texts: list[bytes], passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages, and how many each text has."""
    features, counts = [], []
    for _, held in wordhash.batches(texts):
        doc, h, s, e, _ = wordhash.words(held)
        raw = np.frombuffer(b"\n".join(held), np.uint8)
        per = np.bincount(doc, minlength=len(held))
        bags = np.maximum(1, -(-per // passage))
        first_bag = np.concatenate(([0], np.cumsum(bags)[:-1]))
        x = np.zeros((int(bags.sum()), FEATURES), np.float32)
        if len(h):
            within = np.arange(len(h)) - np.searchsorted(doc, doc)
            # the words of a text are spread evenly over its passages
            bag = first_bag[doc] + within * bags[doc] // per[doc]
            starts = np.flatnonzero(np.concatenate(([True], bag[1:] != bag[:-1])))
            of, n = bag[starts], np.diff(np.concatenate((starts, [len(h)])))[:, None]
            vec = _vectors()[(h >> wordhash.U(52)).astype(np.int64)]
            x[of, :WIDTH] = np.add.reduceat(vec, starts, axis=0) / np.sqrt(n)
            size = (e - s).astype(np.float32)
            ends = e[np.concatenate((starts[1:] - 1, [len(h) - 1]))]
            kinds = np.add.reduceat(_KINDS[raw], s[starts], axis=0)
            span = (ends - s[starts]).astype(np.float32)[:, None]
            again = h[1:] == h[:-1]
            same = np.add.reduceat(np.concatenate(([False], again)).astype(np.float32), starts)[:, None]
            order = np.lexsort((h, bag))
            fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (bag[order][1:] != bag[order][:-1])))
            distinct = np.bincount(bag[order][fresh], minlength=len(x))[of][:, None]
            short = np.add.reduceat((size <= 3).astype(np.float32), starts)[:, None]
            mean = np.add.reduceat(size, starts)[:, None] / n
            x[of, WIDTH:] = np.hstack([10 * kinds / span, mean / 8, short / n, distinct / n, same / n, np.log1p(n) / 4])
        features.append(x)
        counts.append(bags)
    if not features:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    return np.concatenate(features), np.concatenate(counts)


@dataclass
class Model:
    """Gated attention over passages and a logistic layer; ``mean`` and ``scale`` standardise the encodings."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def bags(self, x: np.ndarray, counts: np.ndarray):
        """Attention weights per passage, the weighted encodings, and probabilities, per document."""
        p, z = self.p, (x - self.mean) / self.scale
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        t, g = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-np.clip(z @ p["U"], -30, 30)))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), counts))
        a = a / np.repeat(np.add.reduceat(a, starts), counts)
        m = np.add.reduceat(a[:, None] * z, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["b"], -30, 30)))
        return z, t, g, a, m, y

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.bags(x, counts)[-1] if self.p else np.full(len(counts), 0.5)


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 400, hidden: int = 16, decay: float = 1e-3, rate: float = 0.02) -> Model:
    """Adam on the mean cross-entropy of all bags; the same rows give the same model."""
    model = Model()
    if not len(labels):
        return model
    rng = np.random.default_rng(11)
    x = x.astype(np.float64)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    p = {"V": rng.normal(size=(FEATURES, hidden)) * 0.2, "U": rng.normal(size=(FEATURES, hidden)) * 0.2, "w": rng.normal(size=hidden) * 0.2, "c": np.zeros(FEATURES), "b": np.array(np.log(share / (1 - share)))}
    model.p = p
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        z, t, g, a, m, y = model.bags(x, counts)
        dy = (y - labels) / len(labels)
        dm = dy[:, None] * p["c"]
        far = np.repeat(dm, counts, axis=0)
        da = (far * z).sum(axis=1)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), counts))
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        grad = {"c": m.T @ dy + decay * p["c"], "b": np.array(dy.sum()), "w": (t * g).T @ ds, "V": z.T @ dt + decay * p["V"], "U": z.T @ dg + decay * p["U"]}
        for k, v in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _encoded(batches):
    for batch in batches:
        x, counts = encode(wordhash.encoded(batch.column(1)))
        at = np.concatenate(([0], np.cumsum(counts)))
        bags = [x[a:b] if b - a <= TRAINING_PASSAGES else x[a + np.arange(TRAINING_PASSAGES) * (b - a) // TRAINING_PASSAGES] for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in bags], pa.int64()), pa.array([g.astype("<f4").tobytes() for g in bags], pa.binary())], ["y", "n", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS, label: str = "quality") -> Model:
    """A model of the label, from at most ``most`` documents outside the held-out quarter.

    An id that stands for several rows is one document: the row whose text has the smallest hash. Of a document with
    more than TRAINING_PASSAGES passages, so many are learned from; scores use them all.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg(label).alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``most`` rows
    one = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    bags = one.select("y", "text").mapInArrow(_encoded, "y double, n long, x binary")
    rows = sorted(((r["y"], r["n"], bytes(r["x"])) for r in bags.toLocalIterator()), key=lambda r: (r[2], r[0]))
    x = np.frombuffer(b"".join(r[2] for r in rows), "<f4").reshape(-1, FEATURES)
    return fit(x, np.array([r[1] for r in rows], np.int64), np.array([r[0] for r in rows]))


def _scored(model):
    def run(batches):
        for batch in batches:
            x, counts = encode(wordhash.encoded(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.value.score(x, counts), pa.float64()), pa.array(counts, pa.int64())], ["doc_id", "held_out", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted, passages``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(_scored(sent), f"doc_id {kind}, held_out boolean, score double, passages long")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted", "passages")
