"""SimHash fingerprints and their near-duplicate classes.

Fingerprints of 64 bits are split into eight blocks. Two that differ in at most two bits agree in at least six
blocks, so they share one of the 28 keys made of six blocks; rows are joined on keys. Those that share a key differ
in the other 16 bits alone, so a key has at most 65,536 distinct fingerprints however many documents there are, and links within it are
found without forming its pairs: two differ in at most two bits exactly if they are equal once some two of the 16 bits are
masked, so members are sorted under each of the 120 masks and equal neighbours are linked. A key yields a
spanning forest of its links. Every link is verified by its Hamming distance.

Documents of equal fingerprint are one node from the start. Null and empty texts have fingerprint zero and are linked
like others; repeated rows stay rows; null ids are ignored as representatives unless a class has no other. Further columns
are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WHITE_TABLE, Words, as_bytes, loads, materialize, partitions, slices, text_of, unused
from .graph import components

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def _lanes(seed: int) -> list[np.uint64]:
    """The four accumulators at the start."""
    p, q = int(_P1), int(_P2)
    return [np.uint64(x & (1 << 64) - 1) for x in (seed + p + q, seed + q, seed, seed - p)]


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every span of data, all spans a step at a time; data must go on eight bytes beyond the last span."""
    s = np.uint64(seed)
    n = ends - starts
    h = np.full(len(n), s, np.uint64) + _P5
    at = starts.astype(np.int64).copy()
    long = np.flatnonzero(n >= 32)
    if len(long):
        acc = [np.full(len(long), x, np.uint64) for x in _lanes(seed)]
        left, live = n[long], np.arange(len(long))
        while len(live):
            for k in range(4):
                acc[k][live] = _round(acc[k][live], loads(data, at[long[live]] + 8 * k))
            at[long[live]] += 32
            left = left - 32
            more = left >= 32
            live, left = live[more], left[more]
        v = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for a in acc:
            v = (v ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        h[long] = v
    h += n.astype(np.uint64)
    left = ends - at
    live = np.flatnonzero(left >= 8)
    while len(live):
        x = h[live] ^ _round(np.zeros(len(live), np.uint64), loads(data, at[live]))
        h[live] = _turn(x, 27) * _P1 + _P4
        at[live] += 8
        left[live] -= 8
        live = live[left[live] >= 8]
    live = np.flatnonzero(left >= 4)
    x = h[live] ^ ((loads(data, at[live]) & np.uint64(0xFFFFFFFF)) * _P1)
    h[live] = _turn(x, 23) * _P2 + _P3
    at[live] += 4
    left[live] -= 4
    live = np.flatnonzero(left)
    while len(live):
        x = h[live] ^ (data[at[live]].astype(np.uint64) * _P5)
        h[live] = _turn(x, 11) * _P1
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


_LANES = np.uint64(0x0101010101010101)


def majority_bits(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts hashes, the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
    # Sums of up to 255 fit the bytes of a word: runs are cut into as many parts.
    parts = (counts[some] + 254) // 255
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    offsets = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for j in range(8):
        sums = np.add.reduceat((h >> np.uint64(j)) & _LANES, offsets)
        lanes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = 2 * lanes > counts[some][:, None]
        for lane in range(8):
            out[some] |= over[:, lane].astype(np.uint64) << np.uint64(8 * lane + j)
    return out


def fingerprints_of(texts: list[bytes], width: int = 3) -> np.ndarray:
    """The SimHash of each text over the XXH64 of its word shingles."""
    first = Words(texts, WHITE_TABLE)
    # Words joined by one space each, so that a shingle is a span.
    spaced = b" ".join(first.buffer.split())
    words = Words([spaced], bytes(range(256)))
    counts = first.counts
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    own = np.repeat(np.arange(len(texts)), shingles)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    nth = np.arange(len(own)) - np.repeat(np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles)
    a = begin[own] + nth
    b = a + np.minimum(counts[own], width) - 1
    return majority_bits(xxh64(words.data, words.starts[a], words.ends[b]), shingles)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                bits = fingerprints_of(as_bytes(part["text"]), width)
                own = [x for x in part.schema.names if x not in ("id", "text")]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(bits.view(np.int64)), *[part[x] for x in own]], names=["id", "bits", *own])

    return run


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, key: Column | None = None) -> DataFrame:
    """(id, bits) per row: the 64-bit fingerprint as a signed long. With key, a binary column, that too."""
    own = [] if key is None else [key.alias("key")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), *own)
    return rows.mapInArrow(_fingerprints(width), "id long, bits long" + ", key binary" * len(own))


@functools.cache
def _plan(distance: int, blocks: int = 8) -> list[tuple[int, int]]:
    """Masks of the kept blocks of each key, with the mask of the bits left over."""
    size = 64 // blocks
    part = [((1 << size) - 1) << (size * i) for i in range(blocks)]
    kept = [sum(part[i] for i in x) for x in combinations(range(blocks), blocks - distance)]
    return [(k, ~k & (1 << 64) - 1) for k in kept]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(values: np.ndarray, free: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of distinct fingerprints which differ in bits of free alone, each link within distance."""
    n = len(values)
    if n == 2:
        near = int(values[0] ^ values[1]).bit_count() <= distance
        return (values[:1], values[1:]) if near else (values[:0], values[:0])
    bits = [i for i in range(64) if free >> i & 1]
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    groups = n
    for mask in combinations(bits, distance):
        seen = values & np.uint64(((1 << 64) - 1) ^ sum(1 << i for i in mask))
        order = np.argsort(seen, kind="stable")
        same = np.flatnonzero(seen[order][1:] == seen[order][:-1])
        for i, j in zip(order[same].tolist(), order[same + 1].tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q:
                root[q] = p
                left.append(i)
                right.append(j)
                groups -= 1
        if groups == 1:
            break
    return values[left], values[right]


def _links(distance: int):
    plan = _plan(distance)

    def settle(kind: np.ndarray, key: np.ndarray, bits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links of sorted rows whose keys are complete."""
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]), [True]]))
        size = np.diff(edge)
        out = []
        two = edge[:-1][size == 2]
        a, b = bits[two], bits[two + 1]
        near = np.bitwise_count(a ^ b) <= distance
        out.append((a[near], b[near]))
        for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            out.append(forest(bits[s : s + n], plan[int(kind[s])][1], distance))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]
        last = False
        batches = iter(batches)
        while not last:
            batch = next(batches, None)
            last = batch is None
            if not last:
                new = [batch["kind"].to_numpy(), batch["key"].to_numpy(), batch["bits"].to_numpy().view(np.uint64)]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            kind, key, bits = held
            n = len(key)
            if n and not last:
                # The last key may go on in the next batch.
                n = np.flatnonzero((key != key[-1]) | (kind != kind[-1]))
                n = int(n[-1]) + 1 if len(n) else 0
            if not n:
                continue
            found = settle(kind[:n], key[:n], bits[:n])
            held = [x[n:] for x in held]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def near_links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) of fingerprints: links within distance bits that connect all that such links connect.

    distinct has one row per fingerprint, in column bits.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("bits").bitwiseAND(F.lit(_signed(k))).alias("key")) for i, (k, _) in enumerate(_plan(distance))])
    dealt = distinct.select("bits", F.explode(keys).alias("x")).select("x.kind", "x.key", "bits")
    lined = dealt.repartition(partitions(distinct.sparkSession), "kind", "key").sortWithinPartitions("kind", "key", "bits")
    return lined.mapInArrow(_links(distance), "a long, b long")


def _classed(rows: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """rows as written, and of each fingerprint among them (bits, root, component_id): root names its class."""
    rows = materialize(rows, "simhash")
    nodes = materialize(rows.groupBy("bits").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = components(near_links(nodes, distance), "simhash-links")
    joined = nodes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, joined.select("bits", "root").join(least, "root").select("bits", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """Per row its id, bits and component_id: the smallest id reachable by links of at most distance differing bits."""
    rows, classes = _classed(simhash(docs, id_col, text_col, width), distance)
    return rows.join(classes.drop("root"), "bits").select(F.col("id").alias(id_col), "bits", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """A row of docs per class of near duplicates, that of smallest id; of rows with that id, of smallest hash of id and text.

    Rows are told apart by that hash, so equal or null ids of different classes are no obstacle.
    """
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_of(text_col)), 256))
    rows, classes = _classed(simhash(docs, id_col, text_col, width, key), distance)
    first = rows.join(classes, "bits").where(F.col("id").eqNullSafe(F.col("component_id")))
    keep = first.groupBy("root").agg(F.min("key").alias("__key")).select("__key")
    # Rows of one key are copies of one text under one id.
    own = unused(docs, "key")
    return docs.withColumn(own, key).join(keep.withColumnRenamed("__key", own), own, "left_semi").dropDuplicates([own]).select(*(F.col(f"`{c}`") for c in docs.columns))
