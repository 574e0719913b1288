"""Context-triggered piecewise hashing of documents.

A rolling hash over the last seven bytes triggers the end of a chunk where its low bits are all ones; a chunk becomes
a twelve-bit symbol, written as two base-64 characters. The block size is the smallest power of two that leaves at
most 64 chunks, found from the text alone, and a fingerprint has the signatures at that block size, at twice and at four
times it: "size:signature:signature:signature". Two fingerprints are compared at the smallest block size that
both have, by the edit distance of insertions and deletions d: 1 - d / (symbols of both). Fingerprints without a common block
size have likeness 0, equal ones 1.

Null and empty texts have the fingerprint of the empty text. Every position of a whole text is hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, mix, partitions, text_of

WINDOW = 7
CHUNKS = 64
_STEP = 1 << 16
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _STEP + WINDOW), _powers(_INVERSE, _STEP + WINDOW)


def _scan(data: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, rolling hashes, hashes of all bytes up to each) where the masked bits of the rolling hash are ones; then the end."""
    at, roll, whole = [], [], []
    before = np.uint64(0)
    m = np.uint64(mask)
    for a in range(0, len(data), _STEP):
        lead = min(WINDOW, a)
        part = data[a - lead : a + _STEP].astype(np.uint64) + np.uint64(1)
        sums = np.cumsum(part * _UP[: len(part)], dtype=np.uint64)
        back = np.concatenate([np.zeros(WINDOW, np.uint64), sums])[: len(sums)]
        rolled = mix((sums - back) * _DOWN[: len(sums)])[lead:]
        # Bytes so far, scaled by a power of the base that the caller undoes with the position.
        start = sums[lead - 1] if lead else np.uint64(0)
        run = (sums[lead:] - start) * _DOWN[lead] * np.uint64(pow(_BASE, a, 1 << 64)) + before
        hit = np.flatnonzero((rolled & m) == m)
        at.append(hit + a)
        roll.append(rolled[hit])
        whole.append(run[hit])
        before = run[-1]
    at.append(np.array([len(data) - 1]))
    roll.append(np.array([0], np.uint64))
    whole.append(np.array([before], np.uint64))
    return np.concatenate(at), np.concatenate(roll), np.concatenate(whole)


def _signature(at: np.ndarray, whole: np.ndarray, n: int) -> str:
    """The symbols of the chunks that end at positions at; the last is the end of the text."""
    begin = np.concatenate([[0], at[:-1] + 1])
    back = np.array([pow(_INVERSE, int(b), 1 << 64) for b in begin], np.uint64)
    value = mix((whole - np.concatenate([np.zeros(1, np.uint64), whole[:-1]])) * back + (at + 1 - begin).astype(np.uint64))
    pairs = np.empty(2 * len(at), np.uint8)
    pairs[0::2] = _ALPHABET[(value >> np.uint64(58)).astype(np.int64)]
    pairs[1::2] = _ALPHABET[((value >> np.uint64(52)) & np.uint64(63)).astype(np.int64)]
    return pairs.tobytes().decode()


def fingerprint(raw: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes."""
    n = len(raw)
    if not n:
        return "1:::"
    # A text of n bytes rarely has its block size below n / 512; if it has, it is scanned again in full.
    guess = max(0, (n // (8 * CHUNKS)).bit_length() - 1)
    data = np.frombuffer(raw, np.uint8)
    at, roll, whole = _scan(data, (1 << guess) - 1)
    if guess and len(at) <= CHUNKS:
        guess = 0
        at, roll, whole = _scan(data, 0)
    level = guess
    parts = []
    while True:
        m = np.uint64((1 << level) - 1)
        keep = (roll & m) == m
        keep[-1] = True
        # A trigger on the last byte ends the same chunk as the end of the text.
        keep[:-1] &= at[:-1] != n - 1
        if np.count_nonzero(keep) <= CHUNKS:
            break
        level += 1
    for k in range(3):
        m = np.uint64((1 << (level + k)) - 1)
        chosen = keep & ((roll & m) == m)
        chosen[-1] = True
        parts.append(_signature(at[chosen], whole[chosen], n))
    return f"{1 << level}:" + ":".join(parts)


def _common_subsequence(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, a bit per symbol of a."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        if m := places.get(y):
            kept = row & m
            row = ((row + kept) | (row - kept)) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """From 0 to 1, by edit distance at the smallest block size that both fingerprints have."""
    if a == b:
        return 1.0
    (n, *x), (m, *y) = a.split(":"), b.split(":")
    i = (int(m) // int(n)).bit_length() - 1 if int(m) >= int(n) else 0
    j = (int(n) // int(m)).bit_length() - 1 if int(n) >= int(m) else 0
    if i > 2 or j > 2:
        return 0.0
    p, q = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (x[i], y[j]))
    if not p or not q:
        return 0.0
    return 2 * _common_subsequence(p, q) / (len(p) + len(q))


def edited(text: str, following: str) -> str:
    """The last third of a text's code points replaced by the first as many, or all, of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, in order; the last of a bucket is a copy of the row after it."""
    held = None
    for batch in batches:
        out: list[tuple] = []
        for bucket, peek, key, raw in zip(batch["bucket"].to_pylist(), batch["peek"].to_pylist(), batch["id"].to_pylist(), as_bytes(batch["text"]), strict=True):
            text, mark = raw.decode(), fingerprint(raw)
            if held is not None and held[0] == bucket:
                _, _, own, was, print_ = held
                changed = edited(was, text)
                new = changed.encode()
                other = fingerprint(new)
                out.append((own, len(was), hashlib.sha256(new).hexdigest(), print_, other, likeness(print_, other), likeness(print_, mark)))
            held = None if peek else (bucket, peek, key, text, mark)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=[f"c{i}" for i in range(7)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its fingerprint: id and fingerprint."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(map(fingerprint, as_bytes(batch["text"])), pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the fingerprints of its text and of its text edited with the next row's, and how alike they are.

    The next row is the one after it by descending id, after the last the first; a lone row follows itself. Null ids come
    last; rows of equal id are ordered by the hash of their text, then the text; equal rows follow each other.
    Rows are dealt into ranges of the id, each of which also gets a copy of the first row of the range after it.
    """
    spark = docs.sparkSession
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "c0 long, c1 long, c2 string, c3 string, c4 string, c5 double, c6 double"
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"))
    wanted = 4 * partitions(spark)
    bounds = sorted(set(docs.select(F.col(id_col).cast("double").alias("v")).approxQuantile("v", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted))), reverse=True)
    # Counts the bounds above the key in two steps, so that a row meets about 2 * sqrt(bounds) of them.
    step = 64
    coarse = F.array(*[F.lit(x) for x in bounds[step - 1 :: step]]) if len(bounds) >= step else F.array().cast("array<double>")
    fine = F.array(*[F.lit(x) for x in bounds]) if bounds else F.array().cast("array<double>")
    above = F.size(F.filter(coarse, lambda b: b > F.col("key"))) * step
    rows = rows.withColumn("above", above).withColumn("bucket", F.col("above") + F.size(F.filter(F.slice(fine, F.col("above") + 1, step), lambda b: b > F.col("key")))).drop("above")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    heads = {r["bucket"]: r["key"] for r in rows.groupBy("bucket").agg(F.max("key").alias("key")).collect()}
    if not heads:
        return spark.createDataFrame([], schema).toDF(*names)
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    ids = [heads[b] for b in order]
    # The first row of each range; at most as many as there are ranges, found by a filter that the scan can push down.
    match = F.col(id_col).isin([x for x in ids if x != -(1 << 63)])
    if -(1 << 63) in ids:
        match |= F.col(id_col).isNull() | (F.col(id_col) == -(1 << 63))
    firsts = docs.where(match).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), text.alias("text"))
    firsts = firsts.groupBy("key").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("first"))
    to = F.create_map(*[F.lit(x) for b in order for x in (heads[b], before[b])])
    peeks = firsts.select(F.lit(None).cast("long").alias("id"), F.col("first.text").alias("text"), "key", F.element_at(to, F.col("key")).alias("bucket"), F.col("first.tie").alias("tie"), F.lit(True).alias("peek"))
    dealt = rows.withColumn("peek", F.lit(False)).unionByName(peeks).repartition(partitions(spark), "bucket")
    lined = dealt.sortWithinPartitions("bucket", "peek", F.desc("key"), "tie", "text").select("bucket", "peek", "id", "text")
    return lined.mapInArrow(_near, schema).toDF(*names)
