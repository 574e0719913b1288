"""Pieces that several corpus operators share: shared storage, Arrow access, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 17
#: Text that the vectorised readers take at once; a larger text is taken alone.
CHUNK_BYTES = 8 << 20
#: Text that goes to Python in one batch; a larger text goes alone.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A local session without one gets a temporary folder; a cluster must name it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="roamframe-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, lineage cut, safe when executors go."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of about BATCH_BYTES, unless the session names another size: long texts would else fill large buffers on both sides."""
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text"):
    """A text column where null is the empty text."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 byte strings; null as the empty one."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that the text of a part stays near limit bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Join and cut batches into tables with about limit bytes of text each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, column, limit):
            held.append(part)
            size += part.get_total_buffer_size() if part.num_rows == batch.num_rows else part.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_M1, _M2, _M3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * _M2
    x ^= x >> np.uint64(29)
    x = x * _M3
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered hash of two hashed items."""
    return mix(a * _M1 + np.uint64(0x5851F42D4C957F2D) + (b ^ (b >> np.uint64(31))) * _M3)


def loads(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The eight bytes from each start as a little-endian integer; data must go on eight bytes beyond."""
    words = np.ndarray((max(len(data) - 7, 0),), np.dtype("<u8"), data, strides=(1,))
    return words[starts]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of data, eight bytes a step; data must go on eight bytes beyond the last span."""
    length = (ends - starts).astype(np.uint64)
    h = mix(length + np.uint64(0x1234567))
    live, at, left = np.arange(len(starts)), starts.copy(), (ends - starts).copy()
    while len(live):
        w = loads(data, at)
        short = left < 8
        if short.any():
            keep = (np.uint64(1) << (np.uint64(8) * np.minimum(left, 7).astype(np.uint64))) - np.uint64(1)
            w = np.where(short, w & keep, w)
        x = (h[live] ^ w) * _M1
        x ^= x >> np.uint64(32)
        x *= _M3
        h[live] = x ^ (x >> np.uint64(29))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


class Words:
    """The words of many texts at once.

    texts are joined with a separator byte that no word holds; a word is a maximal run of bytes
    whose class is nonzero. hashes, starts and ends are by word; counts by text.
    """

    def __init__(self, texts: list[bytes], table: bytes, separator: bytes = b" "):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = separator.join(texts).translate(table)
        self.buffer = joined + b" " * 16
        self.data = np.frombuffer(self.buffer, np.uint8)
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths + 1, out=self.offsets[1:])
        word = np.empty(len(self.data) + 1, bool)
        word[0] = False
        np.not_equal(self.data, 32, out=word[1:])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends)


def _lower(other: int) -> int:
    return other + 32 if 65 <= other <= 90 else other


#: A-Z in lower case; white space is \x20 and \x09-\x0D, all made a space.
WHITE_TABLE = bytes(32 if x == 32 or 9 <= x <= 13 else _lower(x) for x in range(256))
#: A-Z in lower case; all ASCII but digits and letters made a space.
WORD_TABLE = bytes(_lower(x) if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def crc_remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
