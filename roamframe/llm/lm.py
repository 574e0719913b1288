"""An interpolated modified Kneser-Ney bigram model, counted in Spark, in sorted hash arrays that workers map into memory.

Texts are lower-cased (A-Z), split at white space, and end with one end token; words are known by a 64-bit hash. Counting:
texts are read in pieces of bounded size, bigrams are summed within a piece, and the sums are dealt as packed arrays to shards by their
first word; a word that makes up a large share of some piece is dealt by both its words, so that no shard
holds a frequent word's followers alone. A shard merges its pieces and writes its bigrams as a file of sorted hashes and counts; sums by word
(token count, left neighbours, followers seen once, twice, more often) are dealt by the word to word shards and written alike.
Files are written under another name and renamed, so that a task may run again. Scoring maps the shards of the
folder read-only and looks up each piece's words and bigrams in order of their hashes.

The folder is the session's spark.checkpoint.dir; where it is not a mounted path, workers read a shard into memory when they need it, and keep
KEPT_BYTES of the shards that they used last. There are as many shards as spark.sql.shuffle.partitions, so that number bounds what a task merges: it has to
grow with the input.

Null and empty texts have the end token alone. With nothing to learn from, every token has probability 1. Repeated rows are all
learnt from and all scored; further columns are not read.
"""

from __future__ import annotations

import mmap
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WHITE_TABLE, Words, as_bytes, chunks, mix, pair, partitions, shared_dir, text_of

#: Text that a worker counts or scores at once, in bytes.
PIECE_BYTES = 16 << 20
SCORE_BYTES = 6 << 20
#: Shards that a worker keeps where it cannot map them.
KEPT_BYTES = 256 << 20
END, BEGIN = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0xB0E0B0E0B0E0B0E3)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the token before, the token, where each text's tokens begin; then their number)."""
    words = Words(texts, WHITE_TABLE)
    v = np.insert(words.hashes(), words.first[1:], END)
    begins = words.first + np.arange(len(words.first))
    u = np.concatenate([np.array([BEGIN]), v[:-1]]) if len(v) else v
    u[begins[:-1]] = BEGIN
    return u, v, begins


def _sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and where each distinct one begins in it."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else order


def _range_shard(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def shard_of(u: np.ndarray, key: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """By the first word; by both for a hot first word."""
    out = _range_shard(mix(u), n)
    spread = _among(u, hot)
    out[spread] = _range_shard(mix(key[spread]), n)
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.uint64(len(arrays[0])).tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, "<u8", 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _frequent(n: int):
    """Words that make up over 1 / 2n of a piece, with their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", PIECE_BYTES):
            _, v, _ = tokens(as_bytes(table["text"]))
            v.sort()
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            count = np.diff(np.concatenate([first, [len(v)]]))
            many = count * 2 * n > len(v)
            yield pa.RecordBatch.from_arrays([pa.array(v[first[many]].view(np.int64)), pa.array(count[many])], names=["word", "n"])

    return run


def _count(hot: np.ndarray, n: int, dealt: list[int]):
    """A piece's bigrams by shard: first words and how many follow each, following words, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", PIECE_BYTES):
            u, v, _ = tokens(as_bytes(table["text"]))
            key = pair(u, v)
            order, first = _sums(key)
            count = np.diff(np.concatenate([first, [len(order)]])).astype("<u4")
            at = order[first]
            u, v, key = u[at], v[at], key[at]
            shard = shard_of(u, key, hot, n)
            order = np.lexsort((u, shard))
            u, v, count, shard = u[order], v[order], count[order], shard[order]
            ends = np.searchsorted(shard, np.arange(n + 1))
            rows, blobs = [], []
            for s in np.unique(shard).tolist():
                a, b = ends[s], ends[s + 1]
                begin = np.flatnonzero(np.concatenate([[True], u[a + 1 : b] != u[a : b - 1]]))
                run_length = np.diff(np.concatenate([begin, [b - a]])).astype("<u4")
                rows.append(s)
                blobs.append((_pack(u[a:b][begin], run_length), _pack(v[a:b], count[a:b])))
            for a in range(0, len(rows), 16):
                part = rows[a : a + 16]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dealt[s] for s in part], pa.int32()), pa.array(part, pa.int32()), pa.array([x for x, _ in blobs[a : a + 16]], pa.binary()), pa.array([x for _, x in blobs[a : a + 16]], pa.binary())],
                    names=["deal", "shard", "first", "second"],
                )

    return run


def _write(folder: str, name: str, parts: list[bytes]) -> None:
    """A file that is there whole or not at all; the same task run again writes the same."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(own) as f:
        for x in parts:
            f.write(x)
    where.move(own, f"{path}/{name}")


def _dealt(spark, n: int) -> list[int]:
    """By shard a number that repartition(n) deals to that partition alone: plain shard numbers would meet by chance, several in one task and none in others."""
    rows = spark.range(64 * n).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("s")).agg(F.min("k").alias("k")).collect()
    found = {r["s"]: r["k"] for r in rows}
    return [found.get(s, s) for s in range(n)]


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Rows sorted by shard, a shard at a time."""
    at, held = None, [[] for _ in columns]
    for batch in batches:
        for row in zip(batch["shard"].to_pylist(), *(batch[c].to_pylist() for c in columns), strict=True):
            if row[0] != at:
                if at is not None:
                    yield at, held
                at, held = row[0], [[] for _ in columns]
            for h, x in zip(held, row[1:], strict=True):
                h.append(x)
    if at is not None:
        yield at, held


def _bucket_bits(n: int) -> int:
    return max(1, (n // 16).bit_length())


def _bigram_file(key: np.ndarray, count: np.ndarray) -> list[bytes]:
    """key sorted. Number, bits of a bucket, large counts; bucket starts; then the next 32 bits of each hash, counts below 255; large ones."""
    n, bits = len(key), _bucket_bits(len(key))
    start = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u8")
    low = (key >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).astype("<u4")
    large = np.flatnonzero(count >= 255)
    return [np.array([n, bits, len(large)], "<u8").tobytes(), start.tobytes(), large.astype("<u8").tobytes(), count[large].astype("<u8").tobytes(), low.tobytes(), np.minimum(count, 255).astype("u1").tobytes()]


def _merge(folder: str, n: int, dealt: list[int]):
    """Writes a shard's bigrams; gives sums by word, packed by word shard, and counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (firsts, seconds) in _grouped(batches, ["first", "second"]):
            u, v, c = [], [], []
            for a, b in zip(firsts, seconds, strict=True):
                first, length = _unpack(a, "<u8", "<u4")
                second, count = _unpack(b, "<u8", "<u4")
                u.append(np.repeat(first, length))
                v.append(second)
                c.append(count)
            u, v, c = np.concatenate(u), np.concatenate(v), np.concatenate(c).astype(np.int64)
            firsts.clear()
            seconds.clear()
            key = pair(u, v)
            order, begin = _sums(key)
            c = np.add.reduceat(c[order], begin)
            at = order[begin]
            u, v, key = u[at], v[at], key[at]
            _write(folder, f"bigrams-{shard}", _bigram_file(key, c))
            # By word: as the second word its tokens and left neighbours, as the first its followers by count.
            one = np.ones(len(c), np.int64)
            zero = np.zeros(len(c), np.int64)
            word = np.concatenate([v, u])
            order, begin = _sums(word)
            columns = [np.add.reduceat(np.concatenate(x)[order], begin) for x in ((c, zero), (one, zero), (zero, one * (c == 1)), (zero, one * (c == 2)), (zero, one * (c > 2)))]
            word = word[order[begin]]
            ends = np.searchsorted(_range_shard(word, n), np.arange(n + 1))
            of_counts = [int(np.count_nonzero(c == k)) for k in range(1, 5)]
            for s in range(n):
                a, b = ends[s], ends[s + 1]
                if b > a or not s:
                    data = _pack(word[a:b], *(x[a:b].astype("<u8" if i == 0 else "<u4") for i, x in enumerate(columns)))
                    columns_ = [pa.array([dealt[s]], pa.int32()), pa.array([s], pa.int32()), pa.array([data], pa.binary()), pa.array([of_counts if not s else [0] * 4], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns_, names=["deal", "shard", "data", "of_counts"])

    return run


_WORD_KINDS = ("<u8", "<u8", "<u4", "<u4", "<u4", "<u4")
_SUMMARY = "shard int, n long, tokens long, distinct long, types long, of_counts array<long>, of_left array<long>"


def _words(folder: str):
    """Writes a word shard; gives its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (blobs, counts) in _grouped(batches, ["data", "of_counts"]):
            parts = [_unpack(x, *_WORD_KINDS) for x in blobs]
            word = np.concatenate([x[0] for x in parts])
            order, begin = _sums(word)
            columns = [np.add.reduceat(np.concatenate([x[i] for x in parts]).astype(np.int64)[order], begin) if len(order) else np.empty(0, np.int64) for i in range(1, 6)]
            word = word[order[begin]]
            _write(folder, f"words-{shard}", [_pack(word, *(x.astype(k) for x, k in zip(columns, _WORD_KINDS[1:], strict=True)))])
            tokens_, left = columns[:2]
            row = [shard, len(word), int(tokens_.sum()), int(np.count_nonzero(tokens_)), int(left.sum()), [sum(x) for x in zip(*counts, strict=True)], [int(np.count_nonzero(left == k)) for k in range(1, 5)]]
            kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["shard", "n", "tokens", "distinct", "types", "of_counts", "of_left"])

    return run


def discounts(of_counts: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of types seen once to four times; of few types, half a count."""
    n1, n2, n3, n4 = of_counts
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for all of them."""

    folder: str
    shards: int
    hot: np.ndarray
    word_shards: frozenset
    tokens: int
    distinct: int
    types: int
    bigram: tuple[float, float, float]
    left: tuple[float, float, float]
    of_left: tuple[int, ...]


def train(texts: DataFrame, text_col: str = "text") -> Model:
    """Count all rows of texts and write the model to the shared folder."""
    spark = texts.sparkSession
    n = max(partitions(spark), 2)
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    rows = texts.select(text_of(text_col).alias("text"))
    found = rows.mapInArrow(_frequent(n), "word long, n long")
    # A word over that share in all has it in some piece. The list, of at most 4n words, only serves balance.
    hot_rows = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(4 * n).collect()
    hot = np.sort(np.array([r["word"] for r in hot_rows], np.int64).view(np.uint64))
    dealt = _dealt(spark, n)
    pieces = rows.mapInArrow(_count(hot, n, dealt), "deal int, shard int, first binary, second binary")
    merged = pieces.repartition(n, "deal").sortWithinPartitions("shard").mapInArrow(_merge(folder, n, dealt), "deal int, shard int, data binary, of_counts array<long>")
    summary = merged.repartition(n, "deal").sortWithinPartitions("shard").mapInArrow(_words(folder), _SUMMARY).collect()
    of_counts = [sum(r["of_counts"][k] for r in summary) for k in range(4)]
    of_left = [sum(r["of_left"][k] for r in summary) for k in range(4)]
    return Model(folder, n, hot, frozenset(r["shard"] for r in summary), sum(r["tokens"] for r in summary), sum(r["distinct"] for r in summary), sum(r["types"] for r in summary), discounts(of_counts), discounts(of_left), tuple(of_left))


def _read(folder: str, name: str) -> memoryview:
    """A file mapped into memory; read where it cannot be mapped; empty where there is none."""
    if folder.startswith("/"):
        try:
            with open(f"{folder}/{name}", "rb") as f:
                return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        except FileNotFoundError:
            return memoryview(b"")
    where, path = fs.FileSystem.from_uri(folder)
    if where.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        return memoryview(b"")
    with where.open_input_file(f"{path}/{name}") as f:
        return memoryview(f.read())


class Bigrams:
    def __init__(self, data: memoryview):
        self.n = 0
        if not len(data):
            return
        n, bits, m = (int(x) for x in np.frombuffer(data, "<u8", 3))
        at = 24
        self.n, self.bits = n, bits
        self.start = np.frombuffer(data, "<u8", (1 << bits) + 1, at)
        at += 8 * len(self.start)
        self.large = np.frombuffer(data, "<u8", m, at)
        self.counts = np.frombuffer(data, "<u8", m, at + 8 * m)
        at += 16 * m
        self.low = np.frombuffer(data, "<u4", n, at)
        self.small = np.frombuffer(data, "u1", n, at + 4 * n)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The count of each key, 0 if there is none."""
        out = np.zeros(len(key), np.int64)
        if not self.n:
            return out
        bucket = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        want = (key >> np.uint64(32 - self.bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        low, high = self.start[bucket].astype(np.int64), self.start[bucket + 1].astype(np.int64)
        end = high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            less = self.low[mid] < want[live]
            low[live[less]] = mid[less] + 1
            high[live[~less]] = mid[~less]
            live = live[low[live] < high[live]]
        there = np.flatnonzero(low < end)
        there = there[self.low[low[there]] == want[there]]
        out[there] = self.small[low[there]]
        over = there[out[there] == 255]
        if len(over):
            out[over] = self.counts[np.searchsorted(self.large, low[over].astype(np.uint64))]
        return out


class Reader:
    """A model as a worker sees it; shards are opened when needed."""

    def __init__(self, model: Model):
        self.m = model
        self.opened: OrderedDict[str, tuple[int, object]] = OrderedDict()
        self.ends = int(self.lookup(np.array([END]))[0][0])

    def shard(self, name: str, parse):
        """A parsed shard. Mapped ones are the system's to page out; of those in memory the longest unused go once they are over KEPT_BYTES."""
        if name in self.opened:
            self.opened.move_to_end(name)
            return self.opened[name][1]
        data = _read(self.m.folder, name)
        size = 0 if isinstance(data.obj, mmap.mmap) else len(data)
        held = sum(x for x, _ in self.opened.values())
        for old in [k for k, (x, _) in self.opened.items() if x] if size else []:
            if held + size <= KEPT_BYTES:
                break
            held -= self.opened.pop(old)[0]
        self.opened[name] = (size, parse(data))
        return self.opened[name][1]

    def lookup(self, word: np.ndarray) -> np.ndarray:
        """word sorted and distinct. Rows: token count, left neighbours, followers seen once, twice, more often."""
        m = self.m
        out = np.zeros((5, len(word)), np.int64)
        ends = np.searchsorted(_range_shard(word, m.shards), np.arange(m.shards + 1))
        for s in range(m.shards):
            a, b = ends[s], ends[s + 1]
            if b == a or s not in m.word_shards:
                continue
            known, *columns = self.shard(f"words-{s}", lambda data: _unpack(data, *_WORD_KINDS))
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, word[a:b]), len(known) - 1)
            there = known[at] == word[a:b]
            for i, x in enumerate(columns):
                out[i, a:b] = np.where(there, x[at], 0)
        return out

    def count(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        m = self.m
        key = pair(u, v)
        shard = shard_of(u, key, m.hot, m.shards)
        order = np.lexsort((key, shard))
        ends = np.searchsorted(shard[order], np.arange(m.shards + 1))
        out = np.zeros(len(key), np.int64)
        for s in range(m.shards):
            own = order[ends[s] : ends[s + 1]]
            if len(own):
                out[own] = self.shard(f"bigrams-{s}", Bigrams).find(key[own])
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """By text: tokens, known tokens, base score, score."""
        m = self.m
        u, v, begins = tokens(texts)
        distinct = np.sort(np.concatenate([v, np.array([BEGIN])]))
        distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
        c, left, n1, n2, n3 = self.lookup(distinct)
        total = c.copy()
        total[np.searchsorted(distinct, BEGIN)] = self.ends
        if END in distinct:
            total[np.searchsorted(distinct, END)] = 0
        d = np.array([0.0, *m.bigram])
        # The lowest order: discounted shares of left neighbours, and what they leave, even over all words and one unknown.
        e = np.array([0.0, *m.left])
        types = max(m.types, 1)
        more = m.distinct - m.of_left[0] - m.of_left[1]
        rest = (e[1] * m.of_left[0] + e[2] * m.of_left[1] + e[3] * more) / types if m.types else 1.0
        low = (left - e[np.minimum(left, 3)]) / types + rest / (m.distinct + 1)
        gamma = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
        x = np.searchsorted(distinct, v)
        w = np.concatenate([np.array([np.searchsorted(distinct, BEGIN)]), x[:-1]])
        w[begins[:-1]] = np.searchsorted(distinct, BEGIN)
        seen = np.zeros(len(v), np.int64)
        maybe = np.flatnonzero((c[x] > 0) & (total[w] > 0))
        seen[maybe] = self.count(u[maybe], v[maybe])
        p = (seen - d[np.minimum(seen, 3)]) / np.maximum(total[w], 1) + gamma[w] * low[x]
        base = np.log10((c[x] + 0.1) / (m.tokens + 0.1 * (m.distinct + 1)))
        at = begins[:-1]
        return np.diff(begins), np.add.reduceat((c[x] > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)


_READERS: dict[str, Reader] = {}


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _READERS:
            _READERS.clear()
            _READERS[model.folder] = Reader(model)
        reader = _READERS[model.folder]
        for table in chunks(batches, "text", SCORE_BYTES):
            found = reader.score(as_bytes(table["text"]))
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), *map(pa.array, found)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score (unigrams, 0.1 added to each count) and score, log10 of the text's probability.

    Perplexity is 10 ** (-score / n_tokens).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(_score(model), "id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def perplexity(scores: DataFrame) -> DataFrame:
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
