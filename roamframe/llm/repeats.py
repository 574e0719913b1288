"""Exact removal of long repeated byte strings by suffix order, built column by column for many texts at once.

Every text is anchored: in each window of 400 bytes the 32-byte gram of least hash (of equal ones the last) is the window's anchor,
found from the window alone. Two equal windows have their anchors at one place, so they belong to anchors of equal hash and begin at the same distance
from them. Anchors whose hash is alone in the collection are done with; of the others, the bytes that their windows cover are cut out as short
strings, aligned at the anchor and dealt by its hash.

Strings that share a hash are the collection of a suffix sorting that inserts one symbol of every string a round, from right to left: a
round's suffixes are those of the round before with a symbol put before them, so a stable sort by that symbol (the Burrows-Wheeler column read
in suffix order) gives their order, and the common prefix of two neighbours of equal symbol is one more than the least common prefix between their old places.
Only suffixes of one round can hold equal windows, so a round keeps its own order and common prefixes and no earlier ones; a suffix that has
400 bytes in common with a neighbour begins a repeated string. Strings come from sorted shuffle files in sequence, a bounded number at a time.

Two lengths can be asked for at once: windows of the lesser one are anchored, strings reach as far as windows of the greater one, and a round
gives both, as a suffix has either length in common with a neighbour.

An anchor with more than max_group strings is not sorted in one task. Its equal strings are made one, which repeats as a whole; if too many
are left, they are dealt again by part of the rounds: windows that begin in few neighbouring rounds have all but few of their bytes in common, and go by the hash
of these. Each part is a collection like the one before, of shorter strings and fewer rounds, and is sorted alike or dealt again; with one
round to a part, a group is one string.

Equal texts count as one that repeats as a whole. Null and empty texts have no bytes. Repeated rows are copies of each other; ids
may repeat or be null; further columns are kept where texts are returned, and not read elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, bounded_batches, chunks, materialize, mix, partitions, text_of

LENGTH = 400
#: A passage of fifty words, at four bytes a word with its space.
PASSAGE = 200
GRAM = 32
#: Strings of one anchor that are sorted in one task.
MAX_GROUP = 20_000
#: Anchors of so many strings that are sent to every executor, eight bytes each.
MAX_LARGE = 1 << 20
#: Texts with repeats whose keys are sent to every executor, sixteen bytes each.
MAX_KEYS = 1 << 20
#: Strings that are sorted at once.
BATCH = 16_384
#: Strings whose spans are read at once.
PART = 2_048
_NONE = 255  # a byte that UTF-8 never has
_LOW = np.uint64((1 << 24) - 1)
_SCALES = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """The hash of the 32 bytes from each of the first n places."""
    words = np.ndarray((n + 24,), np.dtype("<u8"), data, strides=(1,)).copy()
    h = words[:n] * _SCALES[0]
    for i in range(1, 4):
        h += words[8 * i : 8 * i + n] * _SCALES[i]
        h ^= h >> np.uint64(29)
    return mix(h)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, hash, place of the anchor, first and last window that it anchors), places within their text.

    The texts of a call have under 2**24 bytes together, or are one text.
    """
    w = length - GRAM + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = b"".join(texts)
    found: list[list[np.ndarray]] = []
    data = np.frombuffer(joined + b"\0" * 64, np.uint8)
    total = max(len(joined) - length + 1, 0)
    inside = np.ones(total, bool)
    for end in offsets[1:-1].tolist():
        inside[max(end - length + 1, 0) : end] = False
    step, block = 1 << 22, 1 << 16
    for begin in range(0, total, step):
        n = min(step, total - begin)
        starts = np.flatnonzero(inside[begin : begin + n])
        if not len(starts):
            continue
        # Windows that begin here, and all their grams, as much at a time as stays in the cache. A least gram tells its place.
        h, best = np.empty(n + w - 1, np.uint64), np.empty(n, np.uint64)
        for a in range(0, n, block):
            b = min(n, a + block)
            own = gram_hashes(data[begin + a :], b - a + w - 1)
            h[a : b + w - 1] = own
            best[a:b] = _window_min((own & ~_LOW) | (_LOW - np.arange(a, b + w - 1, dtype=np.uint64)), w)
        best = best[starts]
        edge = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        last = np.concatenate([edge[1:], [len(starts)]]) - 1
        at = (_LOW - (best[edge] & _LOW)).astype(np.int64)
        text = np.searchsorted(offsets, at + begin, side="right") - 1
        base = offsets[text] - begin
        found.append([text, h[at], at - base, starts[edge] - base, starts[last] - base])
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of x[low:high] for each pair; high > low."""
    size = high - low
    out = x[low].copy()
    wide = np.flatnonzero(size > 1)
    level, table = 0, x
    while len(wide):
        own = wide[(size[wide] >> level) <= 1]
        if len(own):
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << level)])
        wide = wide[(size[wide] >> level) > 1]
        if len(wide):
            table = np.minimum(table[: -(1 << level)], table[1 << level :])
            level += 1
    return out


class Columns:
    """The suffix order of aligned strings by group, a round at a time."""

    def __init__(self, group: np.ndarray):
        """group: the group number of each string, ascending."""
        n = len(group)
        self.order = np.arange(n)
        self.common = np.zeros(n, np.int32)
        first = np.concatenate([[True], group[1:] != group[:-1]])
        self.inner = ~first
        starts = np.flatnonzero(first)
        size = np.diff(np.concatenate([starts, [n]]))
        self.number = np.cumsum(first) - 1
        self.sorts = (size > 2)[self.number]
        self.n_groups = len(starts)

    def insert(self, column: np.ndarray) -> np.ndarray:
        """Put a symbol before every suffix; whether each string's suffix now shares LENGTH bytes with a neighbour is read from common."""
        s = column[self.order]
        same = np.zeros(len(s), bool)
        same[1:] = (s[1:] == s[:-1]) & (s[1:] != _NONE)
        same &= self.inner
        broken = self.inner & ~same & self.sorts
        if broken.any():
            torn = np.zeros(self.n_groups, bool)
            torn[self.number[broken]] = True
            rows = np.flatnonzero(torn[self.number])
            self._resort(rows, s)
            calm = same & ~torn[self.number]
            reset = self.inner & ~same & ~torn[self.number]
        else:
            calm, reset = same, self.inner & ~same
        self.common[calm] += 1
        self.common[reset] = 0
        return self.common

    def _resort(self, rows: np.ndarray, s: np.ndarray) -> None:
        """Order whole groups, whose places are rows, by their new symbols."""
        symbol, number = s[rows], self.number[rows]
        before = np.argsort(number * 256 + symbol, kind="stable")
        old = self.common[rows]
        next_symbol, next_number = symbol[before], number[before]
        joined = np.zeros(len(rows), bool)
        joined[1:] = (next_symbol[1:] == next_symbol[:-1]) & (next_number[1:] == next_number[:-1]) & (next_symbol[1:] != _NONE)
        new = np.zeros(len(rows), np.int32)
        at = np.flatnonzero(joined)
        if len(at):
            new[at] = 1 + _range_min(old, before[at - 1] + 1, before[at] + 1)
        self.order[rows] = self.order[rows][before]
        self.common[rows] = new


def repeated_starts(group: np.ndarray, strings: list[bytes], left: np.ndarray, reach: int, lengths: tuple[int, ...] = (LENGTH,)) -> list[np.ndarray]:
    """For each length a row per string and a column per distance: whether the window that begins there, counted from reach bytes before the anchor, repeats.

    left: how many bytes of each string stand before its anchor, reach at most.
    """
    n, width = len(strings), reach + max(lengths)
    text = np.full((n, width), _NONE, np.uint8)
    for i, (x, k) in enumerate(zip(strings, left.tolist(), strict=True)):
        text[i, reach - k : reach - k + len(x)] = np.frombuffer(x, np.uint8)
    columns = np.ascontiguousarray(text.T)
    del text
    state = Columns(group)
    out = [np.zeros((reach + 1, n), bool) for _ in lengths]
    for c in range(width - 1, -1, -1):
        common = state.insert(columns[c])
        if c <= reach:
            for length, found in zip(lengths, out, strict=True):
                hit = common >= length
                if hit.any():
                    hit[:-1] |= hit[1:]
                    found[c, state.order[hit]] = True
    return [found.T for found in out]


_KEY = ("k1", "k2")
#: place: the anchor's place, what lies between its first window and it, and between its first and last window, 12 bits each for the latter two.
_ANCHOR = "hash long, k1 long, k2 long, place long"
_BITS = 12


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", 1 << 20):
            text, h, at, first, last = anchors(as_bytes(table["text"]), length)
            keys = [table[k].combine_chunks().take(pa.array(text)) for k in _KEY]
            place = (at << 2 * _BITS) | (at - first << _BITS) | (last - first)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *keys, pa.array(place)], names=["hash", *_KEY, "place"])

    return run


_STRING = "hash long, k1 long, k2 long, at int, left int, starts int, string binary, end int"
_COVER = "k1 long, k2 long, a int, b int, length int"


def _strings(lengths: tuple[int, ...]):
    """The bytes that windows of the greatest length cover from the windows of each anchor on, as far as the text goes.

    Of equal strings of one text one goes on for all; end, null for others, says that their bytes up to there repeat as they are. Those that stay
    behind have no string, and the text's own hash.
    """
    reach, low = max(lengths), (1 << _BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, raw, found in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), as_bytes(batch["text"]), batch["anchors"].to_pylist(), strict=True):
                seen: dict[tuple, list[tuple[int, int]]] = {}
                for x in found:
                    at, left, starts = x["place"] >> 2 * _BITS, x["place"] >> _BITS & low, (x["place"] & low) + 1
                    part = raw[at - left : at - left + starts - 1 + reach]
                    seen.setdefault((x["hash"], left, xxhash.xxh3_128_digest(part)), []).append((at, starts))
                rows = []
                for (h, left, _), same in seen.items():
                    for i, (at, starts) in enumerate(same):
                        end = min(at - left + starts - 1 + reach, len(raw))
                        rows.append((k1 if i else h, at, left, starts, None if i else raw[at - left : end], end if len(same) > 1 else None))
                n = len(rows)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
                h, at, left, starts, string, end = (pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds))
                yield pa.RecordBatch.from_arrays([h, pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), at, left, starts, string, end], names=["hash", "k1", "k2", "at", "left", "starts", "string", "end"])

    return run


def _spans(found: np.ndarray, shift: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the merged spans of bytes of each row's window starts; found has a row per string, shift is the place of its first column."""
    row, start = np.nonzero(found)
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] - start[:-1] > length)])) if len(row) else row
    last = np.concatenate([new[1:], [len(row)]])[: len(new)] - 1
    row = row[new]
    return row, start[new] + shift[row], start[last] + shift[row] + length


def _compare(lengths: tuple[int, ...], reach: int):
    """Rows come sorted by hash: whole groups are sorted together, BATCH strings or one group at a time. Windows begin at most reach bytes before their anchor."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        hashes, k1, k2, at, left = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:5])
        begin = at - left
        end = np.array([-1 if r[6] is None else r[6] for r in rows], np.int64)
        # Strings that a text has twice are covered as they are, by windows of each length that fits into them.
        whole = [np.flatnonzero(end - begin >= n) for n in lengths]
        out = [(k1[i], k2[i], begin[i], end[i], np.full(len(i), n)) for i, n in zip(whole, lengths, strict=True)]
        own = np.flatnonzero([r[5] is not None for r in rows])
        group = np.cumsum(np.concatenate([[0], hashes[own][1:] != hashes[own][:-1]])) if len(own) else own
        many = np.bincount(group)[group] > 1 if len(own) else own == 0
        own, group = own[many], group[many]
        if len(own):
            for n, found in zip(lengths, repeated_starts(group, [rows[i][5] for i in own.tolist()], left[own], reach, lengths), strict=True):
                # A common string has hits in all its places: they are read from few strings at a time.
                for x in range(0, len(own), PART):
                    part = own[x : x + PART]
                    row, a, b = _spans(found[x : x + PART] & ~(end[part] - begin[part] >= n)[:, None], at[part] - reach, n)
                    out.append((k1[part][row], k2[part][row], a, b, np.full(len(row), n)))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["k1", "k2", "a", "b", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch[c].to_pylist() for c in ("hash", "k1", "k2", "at", "left", "string", "end")), strict=True)
            while len(held) >= BATCH:
                # Up to the last change of hash among the first BATCH rows, or the first one after.
                cut = next((i for i in range(BATCH - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0) or next((i for i in range(BATCH, len(held)) if held[i][0] != held[i - 1][0]), 0)
                if not cut:
                    break
                yield settle(held[:cut])
                held = held[cut:]
        if held:
            yield settle(held)

    return run


_DEALT = "hash long, k1 long, k2 long, at int, left int, string binary"


def _deal(length: int, rounds: int, part: int):
    """The bytes of each string that its windows of length from part neighbouring rounds cover, by the hash of what all of these windows have; its place is the new anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group, k1, k2, at, left, string in zip(*(batch[c].to_pylist() for c in ("hash", "k1", "k2", "at", "left", "string")), strict=True):
                for k in range(0, rounds, part):
                    # The last window of these rounds begins here, the first one less than n bytes before.
                    last, n = left - k, min(part, rounds - k)
                    common = string[last : last - n + 1 + length] if last >= 0 else b""
                    if len(common) == length - n + 1:
                        first = max(last - n + 1, 0)
                        # With the group as seed, a string that two anchors of a text have is not taken for a copy of itself.
                        rows.append((xxhash.xxh3_64_intdigest(common, (group + k) % (1 << 64)), k1, k2, at - k, last - first, string[first : last + length]))
            h, *rest = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            columns = [pa.array(np.array(h, np.uint64).view(np.int64)), *(pa.array(x, kind) for x, kind in zip(rest, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "k1", "k2", "at", "left", "string"])

    return run


def _lined(strings: DataFrame) -> DataFrame:
    return strings.repartition(partitions(strings.sparkSession), "hash").sortWithinPartitions("hash")


def _crowded(strings: DataFrame, rounds: int, lengths: tuple[int, ...], max_group: int) -> DataFrame:
    """Covers of strings (hash, k1, k2, at, left, string), however many have a hash; their windows begin less than rounds bytes before their anchor."""
    same = ("hash", "left", "string")
    strings = materialize(strings.withColumns({"s1": F.xxhash64(*same), "s2": F.xxhash64(F.lit("s2"), *same)}), "repeats-crowd")
    one = materialize(strings.groupBy("s1", "s2").agg(*(F.first(c).alias(c) for c in same), F.count("*").alias("n")), "repeats-strings")
    # One round leaves one string to a group.
    large = materialize(one.groupBy("hash").agg(F.count("*").alias("n")).where((F.col("n") > max_group) & F.lit(rounds > 1)).select("hash"), "repeats-large")
    n_large = large.count()
    large = F.broadcast(large) if n_large <= MAX_LARGE else large
    # Places are counted from the begin of a string. Of a crowd, only what strings have as a whole is settled here.
    rows = one.select("hash", F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("left").alias("at"), "left", "string", F.when(F.col("n") > 1, F.octet_length("string")).alias("end"))
    calm = rows.join(large.withColumn("large", F.lit(True)), "hash", "left").where("large is null or end is not null")
    calm = calm.withColumns({"string": F.when(F.col("large").isNull(), F.col("string")), "hash": F.when(F.col("large").isNull(), F.col("hash")).otherwise(F.col("k1"))}).drop("large")
    covers = _lined(calm).mapInArrow(_compare(lengths, rounds - 1), _COVER)
    if n_large:
        part = (rounds + 3) // 4
        crowd = rows.join(large, "hash", "left_semi").drop("end")
        for length in lengths:
            covers = covers.unionByName(_crowded(crowd.mapInArrow(_deal(length, rounds, part), _DEALT), part, (length,), max_group))
    # Written, so that the join with it has a plain shuffle on both sides and a very common string can be split.
    covers = materialize(covers.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("a").alias("from"), F.col("b").alias("to"), "length"), "repeats-covers")
    begin = F.col("at") - F.col("left")
    return strings.drop("string").join(covers, ["s1", "s2"]).select("k1", "k2", (begin + F.col("from")).alias("a"), (begin + F.col("to")).alias("b"), "length")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_CUT = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_shared", pa.int64()), ("kept_sha256", pa.string()), ("remains", pa.string())])


def _cut(length: int, texts: bool):
    """What remains of each text without windows of length: its digest and, with texts, its whole characters. n_shared counts bytes in windows of any length."""

    @F.arrow_udf("n_removed long, n_spans long, n_shared long, kept_sha256 string, remains string")
    def of(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for raw, found in zip(as_bytes(text), spans, strict=True):
            found = found.as_py()
            whole = merged([(x["a"], x["b"]) for x in found if x["length"] == length])
            kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in whole)], [*(a for a, _ in whole), len(raw)], strict=True))
            shared = sum(b - a for a, b in merged([(x["a"], x["b"]) for x in found]))
            rows.append((sum(b - a for a, b in whole), len(whole), shared, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], _CUT[i].type) for i in range(5)], fields=list(_CUT))

    return of


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with its text (null: empty) and two hashes that tell texts apart."""
    text = text_of(text_col)
    return docs.withColumns({"__text": text, "k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("k2"), text)})


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, max_group: int = MAX_GROUP, shared: int | None = None) -> DataFrame:
    """By distinct text that has repeated strings besides being repeated as a whole: k1, k2 and spans (a, b, length) of the bytes that strings of that length cover."""
    spark = docs.sparkSession
    bounded_batches(spark)
    lengths = (length,) if shared is None or shared == length else (length, shared)
    least = min(lengths)
    rounds = least - GRAM + 1
    if least > 1 << _BITS:
        raise ValueError(f"strings of at most {1 << _BITS} bytes are anchored")
    bodies = _keyed(docs.select(text_col), text_col).select("k1", "k2", F.col("__text").alias("text")).where(F.octet_length("text") >= least)
    found = bodies.mapInArrow(_anchors(least), _ANCHOR)
    # Copies of a text have their anchors at the same places, and do not make a hash one to look at.
    spot = F.xxhash64("k1", "place")
    repeated = materialize(found.groupBy("hash").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("hash"), "repeats-hashes")
    by_text = found.join(repeated, "hash").groupBy("k1", "k2").agg(F.collect_set(F.struct("hash", "place")).alias("anchors"))
    # Copies of a text are one from here on.
    one = bodies.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    candidates = materialize(one.join(by_text, ["k1", "k2"]), "repeats-texts")
    hashes = candidates.select("k1", "k2", F.explode("anchors.hash").alias("hash"))
    large = materialize(hashes.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > max_group).select("hash"), "repeats-large")
    n_large = large.count()
    strings = candidates.mapInArrow(_strings(lengths), _STRING)
    if n_large:
        # Few by nature: each has over max_group anchors. A list of unusual length is joined by shuffle.
        large = F.broadcast(large) if n_large <= MAX_LARGE else large
        owners = materialize(hashes.join(large, "hash", "left_semi").select("k1", "k2").distinct(), "repeats-owners")
        crowd = candidates.join(owners, ["k1", "k2"], "left_semi").mapInArrow(_strings(lengths), _STRING).where("string is not null").join(large, "hash", "left_semi")
        crowded = _crowded(crowd.select("hash", "k1", "k2", "at", "left", "string"), rounds, lengths, max_group)
        # What a text has twice still comes with its strings.
        strings = strings.join(large.withColumn("large", F.lit(True)), "hash", "left").where("large is null or end is not null")
        strings = strings.withColumns({"string": F.when(F.col("large").isNull(), F.col("string")), "hash": F.when(F.col("large").isNull(), F.col("hash")).otherwise(F.col("k1"))}).drop("large")
    covers = _lined(strings).mapInArrow(_compare(lengths, rounds - 1), _COVER)
    if n_large:
        covers = covers.unionByName(crowded)
    return covers.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b", "length")).alias("spans"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, max_group: int = MAX_GROUP, texts: bool = False, shared: int | None = None
) -> DataFrame:
    """Remove each byte covered by a string of length bytes that also begins anywhere else.

    Per row its id, n_bytes, n_removed, n_spans and kept_sha256; with shared, n_shared too: the bytes covered by strings of shared bytes (at most
    length) that also begin anywhere else. With texts, docs itself with the remaining text, characters that lost a byte left out, and those of these
    columns whose names docs does not have.
    """
    names = docs.columns if texts else [id_col]
    text = text_of(text_col)
    least = min(length, shared or length)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text).alias("k2"), text.alias("text"))
    copied = _keyed(docs.select(text_col), text_col).where(F.octet_length("__text") >= least).groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2", F.lit(True).alias("copied"))
    # One written table of what befalls a text: the join with it has a plain shuffle on both sides, so that a text with very many copies can be split.
    found = materialize(repeated_spans(docs, text_col, length, max_group, shared).join(copied, ["k1", "k2"], "full"), "repeats-found")
    none = F.array().cast("array<struct<a:int,b:int,length:int>>")
    if found.count() <= MAX_KEYS:
        # Rows that nothing befalls are told by a list of bounded size and not shuffled.
        keys = F.broadcast(found.select("k1", "k2"))
        met = rows.join(keys, ["k1", "k2"], "left_semi").join(found, ["k1", "k2"])
        met = met.unionByName(rows.join(keys, ["k1", "k2"], "left_anti"), allowMissingColumns=True)
    else:
        met = rows.join(found, ["k1", "k2"], "left")
    shares = F.coalesce("copied", F.lit(False))
    n_bytes = F.octet_length("text").cast("long")
    out = met.select("row", "text", n_bytes.alias("n_bytes"), shares.alias("shares"), (shares & (n_bytes >= length)).alias("gone"), F.coalesce("spans", none).alias("spans"))
    # Texts that go whole, or have no spans, do not go to Python.
    partly = ~F.col("gone") & (F.size("spans") > 0)
    out = out.withColumn("cut", F.when(partly, _cut(length, texts)(F.when(partly, F.col("text")), F.when(partly, F.col("spans")).otherwise(none))))
    zero = F.lit(0).cast("long")
    gone = F.col("gone")
    out = out.withColumns(
        {
            "n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("cut.n_removed", zero)),
            "n_spans": F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("cut.n_spans", zero)),
            "kept_sha256": F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut.kept_sha256", F.sha2(F.col("text").cast("binary"), 256))),
            "n_shared": F.when(F.col("shares"), F.col("n_bytes")).otherwise(F.coalesce("cut.n_shared", zero)),
        }
    )
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_shared"] * (shared is not None)
    if not texts:
        return out.select("row.*", *own)
    left = F.when(gone, F.lit("")).otherwise(F.coalesce("cut.remains", F.col("row").getField(text_col)))
    return out.select(*(left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names), *(c for c in own if c not in names))
