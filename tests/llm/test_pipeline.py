import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from roamframe.llm import quality
from roamframe.llm.queries import QUERIES

from .test_operators import classes, hits, simhash_of


def left_of(texts, n):
    """What is left of each text: the characters that lose no byte to a repeated string of n bytes."""
    raw = [x.encode() for x in texts]
    seen = Counter(b[k : k + n] for b in raw for k in range(len(b) - n + 1))
    out = []
    for x, b in zip(texts, raw, strict=True):
        gone = set()
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone.update(range(k, k + n))
        at, kept = 0, []
        for c in x:
            size = len(c.encode())
            if gone.isdisjoint(range(at, at + size)):
                kept.append(c)
            at += size
        out.append("".join(kept))
    return out


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    found = [docs]
    for _, f in cp.STAGES:
        found.append(f(spark, found[-1], sf).cache())
    assert all(x.columns == docs.columns for x in found[:-1])
    text = [{r.doc_id: r.text for r in x.collect()} for x in found[:-1]]
    weights = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(text[1]) == {r.doc_id for r in quality.score(docs, weights).where("score >= 0.3").collect()}
    bits = {i: simhash_of(x) for i, x in text[1].items()}
    ids = sorted(bits)
    roots = classes(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (bits[a] ^ bits[b]).bit_count() <= 2])
    assert set(text[2]) == set(roots.values())
    ids = sorted(text[2])
    assert text[3] == dict(zip(ids, left_of([text[2][i] or "" for i in ids], 200), strict=True))
    assert all(r.n_chars == len(r.text) for r in found[3].collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(text[4]) == {i for i, x in text[3].items() if not hits(x, items)[1]}
    last = found[-1].collect()
    assert Counter(r.doc_id for r in last) == Counter(list(text[4])) and all(r.n_tokens == len(r.ids) for r in last)
    assert len(names) == 5 and cp.ORACLE_SQL is None


def test_run_and_query(spark, sf):
    assert QUERIES["pipeline"](spark, sf).count() == cp.run(spark, sf).count() > 0


def test_equal_and_null_ids_are_judged_by_row(spark, sf):
    rng = random.Random(5)
    prose = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(8)]
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.length("text").desc(), "item_id").first().text
    # Ids 5 lead two classes; a 5 in the class of 3 goes; nulls lead classes of their own, twice the same text.
    docs = [(5, prose[0]), (5, prose[1]), (5, prose[1]), (3, prose[2]), (5, prose[2]), (None, prose[3]), (None, prose[4]), (None, prose[4]), (7, prose[5]), (None, prose[5]), (8, None), (9, "")]
    left = cp.drop_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf)
    want = [(5, prose[0]), (5, prose[1]), (3, prose[2]), (None, prose[3]), (None, prose[4]), (7, prose[5]), (8, None)]
    assert left.columns == ["doc_id", "text"] and Counter(map(tuple, left.collect())) == Counter(want)
    rows = [(5, prose[6]), (5, leak), (None, prose[7]), (None, leak), (1, leak), (None, None)]
    clean = cp.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert Counter(map(tuple, clean.collect())) == Counter([rows[0], rows[2], rows[5]])


def test_stages_on_odd_tables(spark, sf):
    """Names that stages use themselves, nulls in every column, repeated rows, a very long text, no rows."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    extra = ["__key", "key", "__bad", "__row", "__score", "score", "k1", "K2", "row", "n_tokens", "a.b", "n_removed", "copied"]
    texts = [prose(80), prose(90), prose(40_000), "", None, "\0 é", prose(80)]
    rows = [(None if i == 1 else i, x, *[None if i == 5 else f"{c}{i}" for c in extra]) for i, x in enumerate(texts)]
    rows += [rows[6]]
    schema = ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in extra)])
    docs = spark.createDataFrame(rows, schema)
    first = {r[0]: r for r in rows}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.schema.names, name
        found = out.collect()
        if name != "suffix-array dedup":
            assert all(tuple(r) in rows for r in found), name
        assert all(tuple(r)[2:] == first[r[0]][2:] for r in found), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if name == "simhash near-dedup":
            assert len(found) == 6  # the repeated row once, empty and null once
        if name == "suffix-array dedup":
            assert Counter(r.text for r in found) == Counter([*texts[:6], "", ""])
        if name == "benchmark decontamination":
            assert len(found) == len(rows)
    coded = cp.encode(spark, docs, sf)
    assert coded.columns == ["doc_id", "n_tokens", "ids"] and coded.count() == len(rows)
    assert {r.n_tokens for r in coded.where("doc_id in (3, 4)").collect()} == {0}
    assert cp.encode(spark, docs.limit(0), sf).count() == 0
