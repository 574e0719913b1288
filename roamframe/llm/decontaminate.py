"""Find benchmark passages in documents by winnowed fingerprints.

Words are hashed, GRAM of them make a gram, and each window of WINDOW words is known by its gram of least hash, its fingerprint. Equal windows have
equal fingerprints, so every shared span of at least a window has one in common. Fingerprints of documents are joined with those of the benchmark; a hit
is extended to the windows that it stands for, and those are joined by a 128-bit hash of their words with the windows of the benchmark. An item of
fewer words than a window is one window; its gram is as long as it is.

Up to MAX_FILTER different fingerprints (counted first) go to the executors as sorted arrays and are looked up where the documents are read, so that
only hits are shuffled; beyond that, the fingerprints of each text are shuffled and joined, and a text is read again with those that hit. Windows
are joined one by one, by distinct text, so nothing is formed in pairs but a text and an item that share a window.

The result follows from the text alone, and results are joined back by two hashes of it: rows need no key of their own. Null texts have no words;
items without words match nothing. Repeated items and ids count once by id, repeated rows of documents stay rows; null item ids are written as empty
strings. Empty tables give empty results or no hits. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD_TABLE, Words, as_bytes, bounded_batches, materialize, mix, slices, text_of, unused

WINDOW = 10
GRAM = 5
#: Different fingerprints that are sent to every executor, eight bytes each.
MAX_FILTER = 1 << 21


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k words in a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[i : i + n]
    return mix(h)


def fingerprints(words: np.ndarray, size: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """By window of size words its gram of least hash; windows of fewer words than window are their own gram."""
    if size < window or window <= gram:
        return grams(words, size)
    g = grams(words, gram)
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = g[:n].copy()
    for i in range(1, size - gram + 1):
        np.minimum(least, g[i : i + n], out=least)
    return least


def _digest(words: Words, at: int, size: int) -> bytes:
    """The words of a window, a space between them, hashed."""
    return xxhash.xxh3_128_digest(b" ".join([words.buffer[a:b] for a, b in zip(words.starts[at : at + size].tolist(), words.ends[at : at + size].tolist(), strict=True)]))


_BENCH = "item string, size int, gram long, w binary"


def _bench_windows(window: int, gram: int):
    """The windows of each item: words, fingerprint, hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch["item"].to_pylist(), as_bytes(batch["text"]), strict=True):
                words = Words([raw], WORD_TABLE)
                size = min(window, int(words.counts[0]))
                found = fingerprints(words.hashes(), size, window, gram) if size else np.empty(0, np.uint64)
                n = len(found)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * n, pa.string()), pa.array([size] * n, pa.int32()), pa.array(found.view(np.int64)), pa.array([_digest(words, i, size) for i in range(n)], pa.binary())],
                        names=["item", "size", "gram", "w"],
                    )

    return run


_KEYS = "k1 long, k2 long"
_FOUND = f"id long, {_KEYS}, n_words long, windows array<struct<at:int,size:int,w:binary>>"
_WINDOWS = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("w", pa.binary())]))


def _inside(words: Words, size: int) -> np.ndarray:
    """Whether the window from each word on is in one text, and the text."""
    own = np.repeat(np.arange(len(words.counts)), words.counts)
    return own[: max(len(own) - size + 1, 0)] == own[size - 1 :]


def _hits(words: Words, known: dict[int, np.ndarray], window: int, gram: int) -> list[list[dict]]:
    """By text its windows whose fingerprint is among the known ones of their size (sorted arrays)."""
    h = words.hashes()
    out: list[list[dict]] = [[] for _ in words.counts]
    for size, table in known.items():
        if len(h) < size or not len(table):
            continue
        g = fingerprints(h, size, window, gram)
        at = np.flatnonzero(table[np.minimum(np.searchsorted(table, g), len(table) - 1)] == g)
        at = at[_inside(words, size)[at]]
        text = np.searchsorted(words.first, at, side="right") - 1
        for i, t in zip(at.tolist(), text.tolist(), strict=True):
            out[t].append({"at": i - int(words.first[t]), "size": size, "w": _digest(words, i, size)})
    return out


def _look_up(known, window: int, gram: int):
    """known: a broadcast of sorted fingerprints by window size; None where each row brings its own, as (size, gram) in a column of hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = as_bytes(part["text"])
                if known is not None:
                    words = Words(texts, WORD_TABLE)
                    counts, found = words.counts, _hits(words, known.value, window, gram)
                else:
                    counts, found = np.zeros(len(texts), np.int64), []
                    for i, (raw, hits) in enumerate(zip(texts, part["hits"].to_pylist(), strict=True)):
                        own: dict[int, list[int]] = {}
                        for x in hits or []:
                            own.setdefault(x["size"], []).append(x["gram"])
                        words = Words([raw], WORD_TABLE)
                        counts[i] = words.counts[0]
                        found += _hits(words, {n: np.sort(np.array(x, np.int64).view(np.uint64)) for n, x in own.items()}, window, gram)
                yield pa.RecordBatch.from_arrays([part["id"], part["k1"], part["k2"], pa.array(counts), pa.array(found, _WINDOWS)], names=["id", "k1", "k2", "n_words", "windows"])

    return run


def _prints(sizes: list[int], window: int, gram: int):
    """The different fingerprints of each text, by window size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, raw in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), as_bytes(batch["text"]), strict=True):
                h = Words([raw], WORD_TABLE).hashes()
                for size in sizes:
                    g = np.unique(fingerprints(h, size, window, gram)) if len(h) >= size else []
                    n = len(g)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array([size] * n, pa.int32()), pa.array(g.view(np.int64))], names=["k1", "k2", "size", "gram"])

    return run


def _matched(docs: DataFrame, benchmark: DataFrame, id_col: str | None, text_col: str, item_col: str, item_text_col: str, window: int, gram: int, max_filter: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written rows of docs with candidate windows, the windows of each distinct text that are the benchmark's, and the benchmark's windows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), text_of(item_text_col).alias("text")).distinct()
    bench = materialize(items.mapInArrow(_bench_windows(window, gram), _BENCH).distinct(), "benchmark-windows")
    prints = bench.select("size", "gram").distinct()
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most window of them
    own_id = F.lit(None).cast("long") if id_col is None else F.col(f"`{id_col}`").cast("long")
    text = text_of(text_col)
    rows = docs.select(own_id.alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text).alias("k2"), text.alias("text"))
    if prints.count() <= max_filter:
        table = prints.toPandas()
        known = spark.sparkContext.broadcast({n: np.sort(table["gram"][table["size"] == n].to_numpy(np.int64).view(np.uint64)) for n in sizes})
        found = rows.mapInArrow(_look_up(known, window, gram), _FOUND)
    else:
        dealt = rows.mapInArrow(_prints(sizes, window, gram), f"{_KEYS}, size int, gram long").distinct()
        hits = materialize(dealt.join(prints, ["size", "gram"], "left_semi").groupBy("k1", "k2").agg(F.collect_list(F.struct("size", "gram")).alias("hits")), "benchmark-hits")
        found = rows.join(hits, ["k1", "k2"], "left").select("id", "k1", "k2", "text", "hits").mapInArrow(_look_up(None, window, gram), _FOUND)
    if id_col is None:
        found = found.where(F.size("windows") > 0)
    found = materialize(found, "benchmark-candidates")
    # Copies of a text are one from here on.
    by_text = found.where(F.size("windows") > 0).groupBy("k1", "k2").agg(F.first("windows").alias("windows"))
    windows = by_text.select("k1", "k2", F.explode("windows").alias("x")).select("k1", "k2", "x.at", "x.size", "x.w")
    return found, windows.join(bench.select("w").distinct(), "w", "left_semi"), bench


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_merged([(x["at"], x["at"] + x["size"]) for x in row]) for row in batch["spans"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], pa.array([x for x, _ in spans], pa.list_(pa.int32())), pa.array([x for _, x in spans], pa.list_(pa.int32()))], names=["k1", "k2", "starts", "ends"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, max_filter: int = MAX_FILTER
) -> DataFrame:
    """Per row of docs: id, n_words, the merged hit spans in words (starts, ends) and the sorted ids of the items found."""
    found, windows, bench = _matched(docs, benchmark, id_col, text_col, item_col, item_text_col, window, gram, max_filter)
    windows = materialize(windows, "benchmark-found")
    spans = windows.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "size")).alias("spans")).mapInArrow(_unite, f"{_KEYS}, starts array<int>, ends array<int>")
    shared = windows.select("k1", "k2", "w").distinct().join(bench.select("w", "item").distinct(), "w").select("k1", "k2", "item").distinct()
    items = shared.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("item")).alias("items"))
    texts = materialize(spans.join(items, ["k1", "k2"]), "benchmark-texts")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    out = found.drop("windows").join(texts, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), "n_words", none("starts", "int"), none("ends", "int"), none("items", "string"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, max_filter: int = MAX_FILTER) -> DataFrame:
    """The rows of docs whose text shares no window with an item, with all their columns."""
    _, windows, _ = _matched(docs, benchmark, None, text_col, item_col, item_text_col, window, gram, max_filter)
    a, b = unused(docs, "k1"), unused(docs, "k2")
    bad = materialize(windows.select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct(), "benchmark-bad")
    text = text_of(text_col)
    return docs.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit("k2"), text)}).join(bad, [a, b], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
