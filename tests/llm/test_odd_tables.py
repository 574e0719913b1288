"""Every operator on a table with nulls, repeated rows, ties, a very long text and columns of names that it uses itself; then on no rows."""

import random
from collections import Counter

import numpy as np
import pytest

from roamframe.llm import bpe, chat, decontaminate, fingerprints, lm, quality, repeats, simhash, token_counts
from roamframe.llm.queries import tokenizer_path

NAMES = ["id", "row", "k1", "k2", "key", "bits", "score", "n", "hash", "at", "block", "piece", "shard", "deal", "windows", "size", "gram", "w", "label", "value", "fingerprint", "tie", "bucket", "peek", "spans", "n_tokens", "__key", "__text", "length", "a.b"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    same = prose(rng, 90)
    return [(1, same), (1, same), (2, same), (None, same), (None, None), (3, None), (4, ""), (5, prose(rng, 40)), (5, prose(rng, 60)), (6, prose(rng, 30_000)), (None, "\0 é 日本 🙂"), (7, "x" * 70_000)]


@pytest.fixture(scope="module")
def frames(spark, texts):
    """The table alone and with columns of other meaning."""
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [(i, x, *[None if k % 3 else f"{c}{k}" for c in NAMES]) for k, (i, x) in enumerate(texts)]
    return plain, spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES)).repartition(3)


OPERATORS = {
    "op1": lambda d: token_counts.token_counts(d, tokenizer_path("word_bpe_49k.json")),
    "op2": fingerprints.neighbour_fingerprints,
    "op3": simhash.near_duplicates,
    "op4": lambda d: bpe.bpe(d, tokenizer_path("byte_bpe_50k.json"), outputs=bpe.DIGESTS, long_chars=1 << 12),
    "op6": lambda d: decontaminate.contamination(d, d.selectExpr("doc_id as item_id", "text")),
    "op7": lambda d: quality.score(d, quality.train(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))).selectExpr("doc_id", "text", "score"),
    "op8": lambda d: lm.score(d, lm.train(d)),
    "op10": lambda d: repeats.remove_repeats(d, shared=repeats.PASSAGE),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_same_rows_whatever_else_the_table_holds(name, frames, texts):
    plain, full = frames
    one, two = (Counter(str(tuple(r)) for r in OPERATORS[name](d).collect()) for d in (plain, full))
    assert one == two and sum(one.values()) == len(texts)
    assert OPERATORS[name](full.limit(0)).count() == 0


def test_copies_and_nulls_have_defined_results(frames, texts):
    _, full = frames
    cut = {r.doc_id: r for r in OPERATORS["op10"](full).where("doc_id in (1, 2, 3, 4, 7)").collect()}
    assert cut[1].n_removed == cut[2].n_removed == len(texts[0][1]) and cut[3].n_bytes == cut[4].n_bytes == 0 and cut[7].n_removed == 70_000
    near = {r.doc_id: r.component_id for r in OPERATORS["op3"](full).where("doc_id in (1, 2, 3, 4)").collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 3}
    hit = OPERATORS["op6"](full).where("doc_id = 2").first()
    assert list(hit["items"]) == ["", "1", "2"]


def test_chat_on_odd_rows(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (1, 1, None, "what", None), (None, None, None, None, None), (2, None, "assistant", None, "y"), (2, 1, "nobody", "z" * 50_000, "y"), (3, 0, "user", "", None)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(2)
    found = chat.chat_digests(talk)
    assert Counter(r.conv_id for r in found.collect()) == Counter([1, 2, 3, None])
    one, two = (Counter(str(tuple(r)) for r in chat.format_chat(talk.repartition(n)).collect()) for n in (1, 4))
    assert one == two
    assert chat.chat_digests(talk.limit(0)).count() == 0 and chat.format_chat(talk.limit(0)).count() == 0


def test_quality_scores_are_sparse_dot_products(texts):
    """Scores of many texts at once against one text, one feature at a time."""
    raw = [(x or "").encode() for _, x in texts if len(x or "") < 10_000] + [b"One two two, TWO 22!", b"a"]
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 1, (1 << 12) + 1).astype(np.float32)
    want = []
    for x in raw:
        index, sizes, words = quality.features([x], 12)
        assert len(index) == sizes[0] == max(4 * int(words[0]) - 2, 0)  # words, pairs, shapes, pairs of shapes
        total = sum(float(weights[i]) * quality.SCALE / int(words[0]) for i in index.tolist())
        want.append(1 / (1 + np.exp(-(total + float(weights[-1])))))
    assert np.allclose(quality.scores(raw, weights, 12), want)


