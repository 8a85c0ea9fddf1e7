"""Quality classifier: logistic regression over hashed word n-grams.

Words give n-grams twice, as written in lower case and by shape (runs of capitals, small letters, digits and each other
character). Weights are learned by follow-the-regularised-leader updates, in parallel on shards of a bounded
sample whose weights are averaged; scoring is one sparse dot product a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import fold, python_workers, written

DIM_BITS = 20
#: Words whose hashes a task remembers.
MEMORY = 200_000

_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if (w := m[0]).isupper() and len(w) > 1 else "Aa" if w[0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "0"))


def shape(word: str) -> str:
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return word


class Hasher:
    """Hashes of words and their shapes, remembered for the words seen last."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple[int, int]] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen, out = self.seen, []
        for w in words:
            h = seen.get(w)
            if h is None:
                if len(seen) >= MEMORY:
                    seen.clear()
                h = seen[w] = (xxhash.xxh3_64_intdigest(w.lower()), xxhash.xxh3_64_intdigest(shape(w), 7))
            out.append(h)
        return np.array(out, np.uint64).reshape(-1, 2)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices of a text's n-grams in ascending order, and their values: scaled counts with unit length, and a constant at 0."""
        h = self(re.split(r"[ \t-\r]+", text or ""))
        words, shapes = h[:, 0], h[:, 1]
        k = np.uint64(0x9E3779B97F4A7C15)
        grams = [words, shapes, words[:-1] * k + words[1:], shapes[:-1] * k + shapes[1:]]
        parts_i, parts_v = [np.zeros(1, np.int64)], [np.full(1, 0.5)]
        for n, g in enumerate(grams):
            g = (g ^ (g >> np.uint64(29)) ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            at, c = np.unique((g >> np.uint64(64 - DIM_BITS)).astype(np.int64), return_counts=True)
            if len(at):
                v = np.sqrt(c)
                parts_i.append(at)
                parts_v.append(v / np.sqrt((v * v).sum()))
        at, inv = np.unique(np.concatenate(parts_i), return_inverse=True)
        return at, np.bincount(inv, np.concatenate(parts_v), len(at))


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(labelled: DataFrame, label: str = "quality", max_docs: int = 12_000, shards: int = 6, epochs: int = 3) -> np.ndarray:
    """Weights learned from text and ``label`` (0 or 1) of a sample of about ``max_docs`` rows drawn by hash.

    Rows without label or text teach nothing. A task holds the features of one shard of the sample. Without rows all
    weights are 0, and every score is 0.5.
    """
    spark = labelled.sparkSession
    python_workers(spark)
    rows = labelled.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select("text", F.col(label).cast("int").alias("y"))
    n = rows.count()
    key = F.xxhash64("text", "y")
    if n > max_docs:
        rows = rows.filter(F.pmod(key, F.lit(1_000_000)) < int(1_000_000 * max_docs / n))
        n = max_docs
    parts = max(1, min(shards, n // 500))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = [(x, int(y)) for b in batches for x, y in zip(map(Hasher().features, b["text"]), b["y"], strict=True)]
        model, order = Ftrl(), np.random.default_rng(0)
        for _ in range(epochs):
            for i in order.permutation(len(data)):
                model.update(*data[i][0], data[i][1])
        at = np.flatnonzero(model.n)
        w = model.weights(at)
        yield pd.DataFrame({"at": at[w != 0], "w": w[w != 0] * len(data), "docs": len(data)})

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(learn(iter([pdf])))

    learned = dealt.groupBy("shard").applyInPandas(shard, "at long, w double, docs long")
    summed = learned.groupBy("at").agg(F.sum("w").alias("w")).collect()  # at most 2 ** DIM_BITS rows
    total = max(1, rows.count())
    out = np.zeros(1 << DIM_BITS, np.float32)
    for r in summed:
        out[r["at"]] = r["w"] / total
    return out


def score(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and score, the probability of label 1; null and empty texts get that of an empty text."""
    python_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hasher = shared.value, Hasher()
        for batch in batches:
            logits = [float(w[at] @ x) for at, x in map(hasher.features, batch.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.array(logits, float))))], [*keep, "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(scored, docs.select(*keep).schema.add("score", "double"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 12_000) -> DataFrame:
    """text and label of about ``max_docs`` labelled documents drawn by hash of their ids, written once; equal rows count once.

    The draw is made on the labels, so what is sent to the documents has about ``max_docs`` narrow rows whatever the input.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label).distinct()
    n = known.count()
    if n > max_docs:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_docs / n))
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", label)
    return written(texts.dropDuplicates(), "op6-sample")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; fold 0 of 5 is held out of training.

    Null and empty texts all have the score of an empty text; a text of any length is scored whole. Equal texts have equal
    scores, and a score of exactly 0.3 is predicted 1. Repeated rows are rows of their own; a null id is in fold 0 and has no label.
    A doc_id with both labels teaches both. Without labels every score is 0.5; an empty table gives an empty result; other columns, whatever
    their names, are ignored.
    """
    weights = train(labelled_sample(docs, labels.filter(fold(F.col("doc_id"), 5) != 0)))
    scored = score(docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), weights, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
