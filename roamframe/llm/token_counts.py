"""Token counts without token ids.

Pieces are counted once per distinct pre-token. Texts are dealt into blocks of a bounded number of
bytes; a block keeps its vocabulary of pre-tokens once and, for each text, a sparse vector of
pre-token frequencies over it. The vocabularies of all blocks are reduced to the distinct pre-tokens,
those are counted with the merges of the tokenizer, joined to (block, pre-token), and each text's
count is the dot product of its frequencies and the piece counts.

A pre-token costs one row a block that holds it. Those that many blocks hold, of which there are at most MAX_FREQUENT, are found in some of the blocks, counted
once and joined by broadcast, so that the shuffle by pre-token gives no task the rows of nearly all blocks; which ones are on that list makes no
difference to any count.

Null and empty texts have no bytes and no tokens. Repeated rows and repeated or null ids each keep their
own row. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, chunks, materialize, partitions, text_of
from .pretokens import letters, splitter

#: Blocks that are looked into for frequent pre-tokens, the share of them that makes one frequent, and how many, of how many bytes at most, are taken.
LOOK_INTO = 64
FREQUENT = 1 / 8
MAX_FREQUENT = 1 << 16
FREQUENT_BYTES = 64

_BLOCK = "block long, ids array<long>, n_bytes array<long>, n_special array<long>, n_distinct array<int>, at binary, freq binary, vocab array<string>"


def _packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed by byte planes."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


class _Ids(dict):
    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def _blocks(path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = splitter(path)
        first = TaskContext.get().partitionId() << 32
        for k, table in enumerate(chunks(batches, "text", block_bytes)):
            vocab, n_bytes, n_special, n_distinct, at, freq = _Ids(), [], [], [], [], []
            for raw in as_bytes(table["text"]):
                parts = cut.segments(raw.decode())
                seen = Counter()
                for part in parts[::2]:
                    seen.update(cut.pieces(part))
                ids = np.fromiter(map(vocab.__getitem__, seen), np.uint32, len(seen))
                counts = np.fromiter(seen.values(), np.uint32, len(seen))
                order = np.argsort(ids)
                at.append(np.diff(ids[order], prepend=np.uint32(0)))
                freq.append(counts[order])
                n_bytes.append(len(raw))
                n_special.append(len(parts) // 2)
                n_distinct.append(len(seen))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + k], pa.int64()),
                    pa.array([table["id"].to_pylist()], pa.list_(pa.int64())),
                    pa.array([n_bytes], pa.list_(pa.int64())),
                    pa.array([n_special], pa.list_(pa.int64())),
                    pa.array([n_distinct], pa.list_(pa.int32())),
                    pa.array([_packed(np.concatenate(at))], pa.binary()),
                    pa.array([_packed(np.concatenate(freq))], pa.binary()),
                    pa.array([list(vocab)], pa.list_(pa.string())),
                ],
                names=["block", "ids", "n_bytes", "n_special", "n_distinct", "at", "freq", "vocab"],
            )

    return run


def _piece_counts(path: str):
    """Rows come sorted by pre-token; the merges run once for each, and every block that holds it gets their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = splitter(path).model
        last, count = None, 0
        for batch in batches:
            pieces = batch["piece"].to_pylist()
            new = [x for x, y in zip(pieces, [last, *pieces[:-1]], strict=True) if x != y]
            found = [len(x) for a in range(0, len(new), 2048) for x in model.encode_batch_fast([letters(x) for x in new[a : a + 2048]], add_special_tokens=False)]
            known = dict(zip(new, found, strict=True)) | ({last: count} if last is not None else {})
            n = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
            if pieces:
                last, count = pieces[-1], int(n[-1])
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array((n << 32) | batch["pos"].to_numpy().astype(np.int64))], names=["block", "packed"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.select(["ids", "n_bytes", "n_special", "n_distinct", "at", "freq", "packed"]).to_pylist():
            packed = np.array(row["packed"] or [], np.int64)
            pieces = np.zeros(len(packed), np.int64)
            pieces[packed & 0xFFFFFFFF] = packed >> 32
            ends = np.concatenate([[0], np.cumsum(np.array(row["n_distinct"], np.int64))])
            at = _unpacked(row["at"], ends[-1]).astype(np.int64)
            # The positions of each text are differences that start anew.
            run = np.cumsum(at)
            run -= np.repeat(np.concatenate([[0], run])[ends[:-1]], np.diff(ends))
            total = np.concatenate([[0], np.cumsum(pieces[run] * _unpacked(row["freq"], ends[-1]))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array(row["n_bytes"], pa.int64()),
                    pa.array(total[ends[1:]] - total[ends[:-1]] + np.array(row["n_special"], np.int64)),
                ],
                names=["id", "n_bytes", "n_tokens"],
            )


def _frequent(blocks: DataFrame, path: str) -> list[tuple[str, int]]:
    """Frequent pre-tokens with their numbers of tokens; the list has a bound and serves balance alone."""
    chosen = [r["block"] for r in blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(LOOK_INTO).collect()]
    pieces = blocks.where(F.col("block").isin(chosen)).select(F.explode("vocab").alias("piece")).where(F.octet_length("piece") <= FREQUENT_BYTES)
    many = pieces.groupBy("piece").count().where(F.col("count") >= max(2, FREQUENT * len(chosen))).orderBy(F.desc("count"), "piece").limit(MAX_FREQUENT)
    found = [r["piece"] for r in many.select("piece").collect()]
    model = splitter(path).model
    return [(x, len(n)) for a in range(0, len(found), 2048) for x, n in zip(found[a : a + 2048], model.encode_batch_fast([letters(x) for x in found[a : a + 2048]], add_special_tokens=False), strict=True)]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, block_bytes: int = 8 << 20) -> DataFrame:
    """Per row of docs: its id, n_bytes, n_tokens and over_limit (n_tokens > max_tokens).

    path: a tokenizer file of the tokenizers library, readable on every executor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks(path, block_bytes), _BLOCK), "token-blocks")
    words = blocks.select("block", F.posexplode("vocab").alias("pos", "piece"))
    frequent = F.broadcast(docs.sparkSession.createDataFrame(_frequent(blocks, path), "piece string, n long"))
    known = words.join(frequent, "piece").select("block", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("packed"))
    # One shuffle brings each other pre-token's blocks together, sorted, so that it is counted once and joined in place.
    rest = words.join(frequent.select("piece"), "piece", "left_anti")
    lined = rest.repartition(partitions(docs.sparkSession), "piece").sortWithinPartitions("piece")
    back = lined.mapInArrow(_piece_counts(path), "block long, packed long").unionByName(known).groupBy("block").agg(F.collect_list("packed").alias("packed"))
    sums = blocks.drop("vocab").join(back, "block", "left").mapInArrow(_sums, "id long, n_bytes long, n_tokens long")
    return sums.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
