"""A text quality classifier: logistic regression over hashed word n-grams.

Features of a text are its words, pairs of neighbouring words, and the same of the words' shapes (letters, capitals, digits and
other marks, runs made one; a pair also says whether both words are equal), hashed into 2**bits weights. A feature's value is its share of the text's words times
a scale, so a score is a sparse dot product of feature counts and weights over the number of words. Weights are learnt by
follow-the-regularised-leader updates, a text at a time in a fixed order, over a bounded sample of labelled rows: those of smallest id hash,
at most max_train. The weights, 2**bits of four bytes, are all that scoring carries.

Null and empty texts have no features and get the intercept's score. Of several labels of an id the least counts; labels other than 0 and 1
and rows without text row or id are not learnt from. With no labelled row every score is 0.5. Repeated rows stay rows. Ids serve to join labels
and to choose the sample, never as features; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, as_bytes, bounded_batches, mix, pair, slices, span_hash, text_of

BITS = 20
SCALE = 12.0
#: Bound on the labelled rows that are learnt from.
MAX_TRAIN = 6_000
_WHITE = bytes(32 if x == 32 or 9 <= x <= 13 else x for x in range(256))
_SHAPE = np.array([32 if x == 32 else 97 if 97 <= x <= 122 or x >= 128 else 65 if 65 <= x <= 90 else 48 if 48 <= x <= 57 else x for x in range(256)], np.uint8)
_KINDS = [np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(1, 5)]


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the features of all texts, the number of them by text, and the number of words by text."""
    words = Words(texts, _WHITE)
    n = words.counts
    h = words.hashes()
    own = np.repeat(np.arange(len(texts)), n)
    shapes = _SHAPE[words.data]
    keep = np.ones(len(shapes), bool)
    np.not_equal(shapes[1:], shapes[:-1], out=keep[1:])
    place = np.cumsum(keep)
    packed = np.concatenate([shapes[keep], np.zeros(16, np.uint8)])
    s = span_hash(packed, place[words.starts] - 1, place[words.ends - 1]) if len(h) else h
    inside = own[1:] == own[:-1]
    equal = (h[1:] == h[:-1])[inside]
    found = [h ^ _KINDS[0], pair(h[:-1], h[1:])[inside] ^ _KINDS[1], mix(s ^ _KINDS[2]), pair(s[:-1], s[1:])[inside] + equal.astype(np.uint64) * _KINDS[3]]
    at = np.concatenate([own, own[1:][inside], own, own[1:][inside]])
    order = np.argsort(at, kind="stable")
    index = (mix(np.concatenate(found)) >> np.uint64(64 - bits)).astype(np.int64)[order]
    return index, np.bincount(at, minlength=len(texts)), n


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """Follow the regularised leader, by coordinate, for logistic loss. The last weight is the intercept."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        """at: distinct coordinates."""
        w = self.weights(at)
        g = (_sigmoid(w @ value) - label) * value
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def fit(texts: list[bytes], labels: list[int], bits: int = BITS, epochs: int = 4) -> np.ndarray:
    """Weights learnt from texts in their order, epochs times over."""
    model = Ftrl(1 << bits)
    rows = []
    for a in range(0, len(texts), 256):
        index, sizes, words = features(texts[a : a + 256], bits)
        ends = np.cumsum(sizes)
        for b, e, n in zip(ends - sizes, ends, words, strict=True):
            part = np.sort(index[b:e])
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
            count = np.diff(np.concatenate([first, [len(part)]]))
            rows.append((np.concatenate([part[first], [1 << bits]]).astype(np.int32), np.concatenate([count * (SCALE / max(n, 1)), [1.0]]).astype(np.float32)))
    for _ in range(epochs):
        for (at, value), label in zip(rows, labels, strict=True):
            model.learn(at, value, label)
    return model.weights(slice(None)).astype(np.float32)


def scores(texts: list[bytes], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    index, sizes, words = features(texts, bits)
    sums = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
    ends = np.cumsum(sizes)
    return _sigmoid((sums[ends] - sums[ends - sizes]) * SCALE / np.maximum(words, 1) + float(weights[-1]))


def _fit(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += as_bytes(batch["text"])
            labels += batch["label"].to_pylist()
        weights = fit(texts, labels, bits, epochs) if texts else np.zeros((1 << bits) + 1, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(weights.tobytes(), codec="zstd", asbytes=True)])], names=["weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = BITS, max_train: int = MAX_TRAIN, epochs: int = 4) -> np.ndarray:
    """Weights from at most max_train labelled rows, those of smallest id hash; learnt in one task."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # A repeated id gives one row to learn from.
    rows = texts.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    lined = rows.select("text", "label", F.xxhash64("id").alias("at"), "id").orderBy("at", "id").limit(max_train).coalesce(1).select("text", "label")
    found = lined.mapInArrow(_fit(bits, epochs), "weights binary").collect()
    if not found:
        return np.zeros((1 << bits) + 1, np.float32)
    return np.frombuffer(pa.decompress(bytes(found[0]["weights"]), decompressed_size=4 * ((1 << bits) + 1), codec="zstd", asbytes=True), np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1, in the place of a column of that name if there is one; all other columns are kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    @F.pandas_udf("double")
    def of(text):
        import pandas as pd

        parts = pa.RecordBatch.from_pandas(pd.DataFrame({"text": text.astype(object)}), preserve_index=False, schema=pa.schema([("text", pa.string())]))
        found = [scores(as_bytes(x["text"]), shared.value, bits) for x in slices(parts, "text", 2 << 20)]
        return pd.Series(np.concatenate(found) if found else [], dtype="float64")

    return docs.withColumn(out, of(text_of(text_col)))
