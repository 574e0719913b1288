"""Byte-level BPE encoding and decoding by tree concatenation.

A pre-token is encoded by the merges alone. A long unsplit pre-token would cost one task much time, so
a long text is cut into leaves that are encoded in parallel: pieces that end where a run of white space begins
(no pre-token crosses such a place), and, inside a pre-token longer than a leaf, halves of halves of it.
Halves are joined by re-encoding a window around the join, growing it until its first and last tokens
are the ones that both sides have there. A token sequence is what the merges give for its bytes if and only if
each two neighbours are what the merges give for their own bytes; so that agreement makes the whole exact.

Null and empty texts have no ids and decode to the empty text. Repeated rows and repeated or null ids keep their own
row. Further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, bounded_batches, slices, text_of
from .pretokens import LETTER_BYTES, Splitter, letters, splitter

#: A pre-token of more bytes than this is encoded as a tree of halves.
LEAF_BYTES = 4096
#: A text of more characters than this is cut into leaves that are dealt to all tasks.
LONG_CHARS = 1 << 16
#: Text whose ids and decoded texts a task holds at once; a larger text is taken alone.
SLICE_BYTES = 1 << 20
#: Pre-tokens that a worker remembers.
_MEMO = 400_000
_BREAK = re.compile(r"\S(?=\s)")


class Codec:
    """Ids as bytes (little-endian unsigned 32-bit) for pre-tokens, remembered, and bytes for ids."""

    def __init__(self, path: str):
        self.split: Splitter = splitter(path)
        self.memo: dict[str, bytes] = {}
        self.tokenize = self.split.library.model.tokenize
        vocab = self.split.library.get_vocab(with_added_tokens=True)
        self.special = {x: np.array([i], "<u4").tobytes() for x, i in self.split.special.items()}
        token: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for x, i in vocab.items():
            token[i] = x.encode() if x in self.special else bytes(LETTER_BYTES[ord(c)] for c in x)
        self.token = pa.array(token, pa.large_binary())

    def merge(self, spelled: list[str]) -> list[list[int]]:
        """By the model itself: the library's batches start a thread for each of the machine's processors, whose waiting costs more than such short strings."""
        return [[x.id for x in self.tokenize(s)] for s in spelled]

    def whole(self, raw: bytes) -> np.ndarray:
        """The merges' ids of bytes, whatever their length, without the tree."""
        return np.array(self.merge([raw.decode("latin-1").translate(_BYTES)])[0], "<u4")

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, one after another: what a gathered column holds."""
        if not len(ids):
            return b""
        _, offsets, data = self.token.take(pa.array(ids)).buffers()
        return data[: int(np.frombuffer(offsets, "<i8", 1, 8 * len(ids))[0])].to_pybytes() if data else b""

    def join(self, left: np.ndarray, right: np.ndarray, window: int = 4) -> np.ndarray:
        """The ids of two encoded neighbours, from a window around their join that grows until both sides agree."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        while True:
            a, b = max(len(left) - window, 0), min(window, len(right))
            mid = self.whole(self.raw(left[a:]) + self.raw(right[:b]))
            start_agrees = a == 0 or mid[0] == left[a]
            end_agrees = b == len(right) or mid[-1] == right[b - 1]
            if start_agrees and end_agrees:
                return np.concatenate([left[:a], mid, right[b:]])
            window *= 2

    def tree(self, leaves: list[np.ndarray]) -> np.ndarray:
        """Leaves in order, joined in pairs until one is left."""
        while len(leaves) > 1:
            pairs = [self.join(*leaves[i : i + 2]) for i in range(0, len(leaves) - 1, 2)]
            leaves = pairs + leaves[len(leaves) // 2 * 2 :]
        return leaves[0]

    def piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        return self.tree([self.whole(raw[a:b]) for a, b in halves(len(raw))]).tobytes()

    def ids(self, pieces: list[str]) -> bytes:
        """The ids of pre-tokens, one after another."""
        if len(self.memo) > _MEMO:
            self.memo.clear()
        new = list(set(pieces).difference(self.memo))
        if new:
            short = [x for x in new if len(x) <= LEAF_BYTES // 4]
            self.memo.update(zip(short, [array("I", x).tobytes() for x in self.merge([letters(x) for x in short])], strict=True))
            if len(short) < len(new):
                long = {x: self.piece(x) for x in new if len(x) > LEAF_BYTES // 4}
                return b"".join([long[x] if x in long else self.memo[x] for x in pieces])
        return b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.split.segments(text)):
            out.append(self.special[part] if k % 2 else self.ids(self.split.pieces(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Token bytes, joined and read as UTF-8, faulty ones replaced."""
        return self.raw(np.frombuffer(ids, "<u4")).decode("utf-8", "replace")


_BYTES = {b: letters_of for b, letters_of in ((v, chr(k)) for k, v in LETTER_BYTES.items())}


def halves(n: int, leaf: int = LEAF_BYTES) -> list[tuple[int, int]]:
    """The leaves of halving n bytes until none is over leaf."""
    if n <= leaf:
        return [(0, n)]
    m = n // 2
    return halves(m, leaf) + [(a + m, b + m) for a, b in halves(n - m, leaf)]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def leaves(text: str, split: Splitter, limit: int) -> Iterator[tuple[int, bool, bytes]]:
    """(number of the unsplit run, whether it is a part of a longer pre-token, UTF-8) of each leaf of a text, in order."""
    run, at = 0, 0
    while at < len(text):
        end = len(text)
        if len(text) - at > limit:
            found = _BREAK.search(text, at + limit - 1)
            end = found.end() if found else len(text)
        part = text[at:end]
        at = end
        if len(part) <= 2 * limit:
            yield run, False, part.encode()
            run += 1
            continue
        # No white space for long: cut at the pre-tokens themselves.
        for k, segment in enumerate(split.segments(part)):
            held: list[str] = []
            size = 0
            for piece in [segment] if k % 2 else split.pieces(segment):
                raw = piece.encode()
                if k % 2 or len(raw) > LEAF_BYTES or size > limit:
                    if held:
                        yield run, False, "".join(held).encode()
                        run, held, size = run + 1, [], 0
                if not k % 2 and len(raw) > LEAF_BYTES:
                    for a, b in halves(len(raw)):
                        yield run, True, raw[a:b]
                    run += 1
                else:
                    held.append(piece)
                    size += len(piece)
            if held:
                yield run, False, "".join(held).encode()
                run += 1


def _finish(outputs: str):
    """What to keep of the ids of a document, as a tuple of columns; decoded only where that is asked for."""
    if outputs == IDS:
        return lambda code, ids: (len(ids) // 4, np.frombuffer(ids, "<i4"))
    consume = digests if outputs == DIGESTS else contents
    return lambda code, ids: consume(ids, code.decode(ids).encode())


def digests(ids: bytes, decoded: bytes) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def contents(ids: bytes, decoded: bytes) -> tuple:
    return len(ids) // 4, np.frombuffer(ids, "<i4"), decoded.decode()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
CONTENTS = "n_tokens long, ids array<int>, decoded string"
IDS = "n_tokens long, ids array<int>"
_TYPES = {
    DIGESTS: [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())],
    IDS: [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))],
    CONTENTS: [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())],
}


def _rows(schema: str, found: list[tuple], *keys: tuple[str, list]) -> pa.RecordBatch:
    kinds = [*((name, pa.int64()) for name, _ in keys), *_TYPES[schema]]
    columns = [*(x for _, x in keys), *([x[i] for x in found] for i in range(len(_TYPES[schema])))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _whole_texts(path: str, keep, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = [keep(code, code.encode(raw.decode())) for raw in as_bytes(part["text"])]
                yield _rows(schema, found, ("id", part["id"].to_pylist()))

    return run


def _cut(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        for batch in batches:
            for k1, k2, raw in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), as_bytes(batch["text"]), strict=True):
                held = list(leaves(raw.decode(), split, limit))
                n = len(held)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k1] * n, pa.int64()),
                        pa.array([k2] * n, pa.int64()),
                        pa.array(range(n), pa.int64()),
                        pa.array([x[0] for x in held], pa.int64()),
                        pa.array([x[1] for x in held], pa.bool_()),
                        pa.array([x[2] for x in held], pa.binary()),
                    ],
                    names=["k1", "k2", "leaf", "run", "part", "raw"],
                )

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            raws, parts = batch["raw"].to_pylist(), batch["part"].to_pylist()
            ids = [code.whole(x).tobytes() if p else code.encode(x.decode()) for x, p in zip(raws, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("k1", "k2", "leaf", "run", "part")), pa.array(ids, pa.binary())], names=["k1", "k2", "leaf", "run", "part", "ids"])

    return run


def _concatenate(path: str, keep, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            for k1, k2, held in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["leaves"].to_pylist(), strict=True):
                out, tree = [], []
                for k, x in enumerate(held):
                    if not x["part"]:
                        out.append(x["ids"])
                        continue
                    tree.append(np.frombuffer(x["ids"], "<u4"))
                    if k + 1 == len(held) or held[k + 1]["run"] != x["run"]:
                        out.append(code.tree(tree).tobytes())
                        tree = []
                ids = b"".join(out)
                yield _rows(schema, [keep(code, ids)], ("k1", [k1]), ("k2", [k2]))

    return run


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: str = CONTENTS, long_chars: int = LONG_CHARS, leaf_chars: int = 1 << 14) -> DataFrame:
    """Encode and decode every text.

    outputs: CONTENTS for n_tokens, ids and the decoded text; IDS without the text; DIGESTS for n_tokens and SHA-256 of both.
    Texts over long_chars are cut into leaves of about leaf_chars that all tasks share, and put together again by text.
    path: a byte-level tokenizer file, readable on every executor.
    """
    bounded_batches(docs.sparkSession)
    keep = _finish(outputs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    is_long = F.length("text") > long_chars
    short = rows.where(~is_long).mapInArrow(_whole_texts(path, keep, outputs), f"id long, {outputs}")
    # A long text is known by two hashes of it, whatever its ids; copies are cut and encoded once.
    keyed = rows.where(is_long).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("k2"), "text")})
    key = "k1 long, k2 long"
    cut = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text")).mapInArrow(_cut(path, leaf_chars), f"{key}, leaf long, run long, part boolean, raw binary")
    coded = cut.repartition("k1", "k2", "leaf").mapInArrow(_encode_leaves(path), f"{key}, leaf long, run long, part boolean, ids binary")
    by_text = coded.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("leaf", "run", "part", "ids"))).alias("leaves"))
    whole = by_text.mapInArrow(_concatenate(path, keep, outputs), f"{key}, {outputs}")
    long = keyed.select("id", "k1", "k2").join(whole, ["k1", "k2"]).drop("k1", "k2")
    return short.unionByName(long).withColumnRenamed("id", id_col)
