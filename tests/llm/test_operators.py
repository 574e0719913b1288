"""Each corpus operator against a library, brute force or held-out labels."""

import hashlib
import math
import os
import random
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from roamframe.llm import bpe, chat, decontaminate, fingerprints, graph, html, lm, quality, repeats, simhash, token_counts
from roamframe.llm._common import WHITE_TABLE, WORD_TABLE, Words, crc_remainder
from roamframe.llm.pretokens import Splitter
from roamframe.llm.queries import QUERIES, tokenizer_path

WORD_BPE, BYTE_BPE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, score int, bits string"
ODD = ["", None, " ", "\n\t ", "a", "<|endoftext|>", "x <|startoftext|><|endoftext|>y", "don't CAN'T we'LL", "Σίσυφος ΑΣ ﬁ é ½²Ⅷ", "\x1c\x1f\x85\xa0 z", "日本語テキスト。중국어 12３", "🙂👍🏽 ok", "0123 4567", "İstanbul ǅ", "a" * 9000, "ab" * 7000, "é" * 5000, "the  cat\r\n\r\n  sat "]


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, x, "en", "s", 0, "clash", 1, "clash") for i, x in zip(ids, texts, strict=True)], DOC).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]


def test_words_are_those_of_the_definitions():
    samples = [x.encode() for x in ODD if x is not None]
    w = Words(samples, WHITE_TABLE)
    assert [[w.buffer[a:b] for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)] == [x.lower().split() for x in samples]
    w = Words([b"A-b_1 \xc3\xa9X"], WORD_TABLE)
    assert [w.buffer[a:b] for a, b in zip(w.starts, w.ends, strict=True)] == [b"a", b"b", b"1", b"\xc3\xa9x"]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_fast_split_equals_the_library(path):
    s = Splitter(path)
    rng = random.Random(1)
    letters = [chr(c) for c in (*range(1, 0x250), *range(0x370, 0x530), *range(0x2000, 0x2070), *range(0x3040, 0x3100), 0x4E00, 0xAC00, 0x1F642, 0x301)] + list(" '  \n\nstrevml")
    for _ in range(400):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert s.pieces(x) == s.library_pieces(x), repr(x)


def test_token_counts(spark, texts):
    ids, all_ = zip(*texts, *((10_000 + i, x) for i, x in enumerate(ODD)), (10_001, "twice"), (None, "no id"), strict=True)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    tokenizer.no_truncation()
    want = sorted((str(i), len((x or "").encode()), len(e), len(e) > 50) for i, x, e in zip(ids, all_, tokenizer.encode_batch([x or "" for x in all_], add_special_tokens=False), strict=True))
    got = token_counts.token_counts(frame(spark, all_, ids), WORD_BPE, max_tokens=50, block_bytes=20_000)
    assert sorted((str(a), b, c, d) for a, b, c, d in rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit")) == want
    assert token_counts.token_counts(frame(spark, all_).limit(0), WORD_BPE).count() == 0


@pytest.mark.parametrize("long_chars", [1 << 16, 60])
def test_bpe_equals_the_library(spark, texts, long_chars):
    ids, all_ = zip(*texts, *((10_000 + i, x) for i, x in enumerate(ODD)), strict=True)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    encoded = tokenizer.encode_batch([x or "" for x in all_], add_special_tokens=False)
    want = {i: (e.ids, tokenizer.decode(e.ids, skip_special_tokens=False)) for i, e in zip(ids, encoded, strict=True)}
    got = bpe.bpe(frame(spark, all_, ids), BYTE_BPE, long_chars=long_chars, leaf_chars=40)
    assert {r.doc_id: (list(r.ids), r.decoded) for r in got.collect()} == want
    digest = {r.doc_id: r.ids_sha256 for r in bpe.bpe(frame(spark, all_, ids), BYTE_BPE, outputs=bpe.DIGESTS).collect()}
    assert digest == {i: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for i, (x, _) in want.items()}


def test_bpe_starts_no_threads():
    """Threads of the library, one for each processor, take more CPU time than the merges."""
    run = "import os; from roamframe.llm.bpe import Codec; c = Codec(%r); n = len(os.listdir('/proc/self/task')); c.encode(' '.join(map(str, range(10 ** 5, 11 * 10 ** 4)))); print(len(os.listdir('/proc/self/task')) - n)"
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    assert int(subprocess.run([sys.executable, "-c", run % BYTE_BPE], env=env, capture_output=True, check=True, text=True).stdout) == 0


def test_tree_concatenation_is_exact():
    code, rng = bpe.Codec(BYTE_BPE), random.Random(2)
    for _ in range(500):
        raw = "".join(rng.choice(rng.choice(["ab", "the an", "aeioux", "éñth", "!-="])) for _ in range(rng.choice([3, 40, 300]))).encode()
        parts = [code.whole(raw[a:b]) for a, b in bpe.halves(len(raw), rng.choice([2, 7, 33]))]
        assert code.tree(parts).tolist() == code.whole(raw).tolist()


def test_fingerprints(spark, texts):
    extra = [(10_000 + i, x) for i, x in enumerate(ODD)]
    order = sorted(texts + extra, key=lambda x: -x[0])
    want = {}
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        new = fingerprints.edited(a or "", b or "")
        want[i] = (len(a or ""), hashlib.sha256(new.encode()).hexdigest(), fingerprints.fingerprint((a or "").encode()), fingerprints.fingerprint(new.encode()))
    got = fingerprints.neighbour_fingerprints(frame(spark, [x for _, x in order], [i for i, _ in order])).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    near = [(r.near_edited, r.near_next) for r in got if r.doc_id < 10_000]
    assert sum(a > b for a, b in near) > 0.95 * len(near)
    assert fingerprints.neighbour_fingerprints(frame(spark, ["a"]).limit(0)).count() == 0
    one = fingerprints.neighbour_fingerprints(frame(spark, ["abcdef"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    many = fingerprints.neighbour_fingerprints(frame(spark, ["x", "y", None, "x"], [1, 1, None, None]))
    assert many.count() == 4


def test_fingerprint_slices_do_not_show(monkeypatch):
    rng = random.Random(3)
    raw = bytes(rng.randrange(97, 123) for _ in range(5000))
    whole = fingerprints.fingerprint(raw)
    monkeypatch.setattr(fingerprints, "_STEP", 64)
    assert fingerprints.fingerprint(raw) == whole


def simhash_of(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_simhash(spark, texts):
    extra = [(10_000 + i, x) for i, x in enumerate(ODD)]
    all_ = dict(texts + extra)
    bits = {i: simhash_of(x) for i, x in all_.items()}
    ids = sorted(bits)
    want = classes(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (bits[a] ^ bits[b]).bit_count() <= 2])
    got = simhash.near_duplicates(frame(spark, list(all_.values()), list(all_)))
    assert {r.doc_id: (r.bits % (1 << 64), r.component_id) for r in got.collect()} == {i: (bits[i], want[i]) for i in ids}
    assert simhash.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0
    assert simhash.near_duplicates(frame(spark, ["a b", "a b", "a b"], [5, None, 5])).select("component_id").distinct().collect()[0][0] == 5


def test_links_of_dense_groups():
    rng = random.Random(4)
    for _ in range(50):
        base = rng.getrandbits(64)
        v = list({base ^ sum(1 << rng.randrange(8, 24) for _ in range(rng.randrange(6))) & 0xFFFF00 for _ in range(rng.randrange(3, 60))})
        if len(v) < 3:
            continue
        a, b = simhash.forest(np.array(v, np.uint64), 0xFFFF << 8, 2)
        pairs = list(zip(a.tolist(), b.tolist(), strict=True))
        assert all((x ^ y).bit_count() <= 2 for x, y in pairs)
        assert classes(v, pairs) == classes(v, [(x, y) for x in v for y in v if (x ^ y).bit_count() <= 2])


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == classes(nodes, edges)


def repaired(turns, costs=(1, 2, 3)):
    """Least cost over all ways to label, merge and insert."""
    best = math.inf
    legal = {(-1, 0), (-1, 1), (0, 1), (1, 2), (2, 1)}

    def steps(a, b):
        if (a, b) in legal:
            return 0
        return min((1 + steps(m, b) for m in range(3) if (a, m) in legal and (m, b) in legal), default=math.inf) if (a, b) != (-1, 2) else 1

    for labels in product(range(3), repeat=len(turns)):
        for merges in product((False, True), repeat=len(turns)):
            cost, state = 0, -1
            for own, r, m in zip(turns, labels, merges, strict=True):
                cost += costs[1] * (own != r) if r or own == 0 else math.inf
                if m:
                    cost += costs[0] if state == r else math.inf
                else:
                    cost += costs[2] * steps(state, r)
                    state = r
            best = min(best, cost + costs[2] * (state == 0))
    return best


def test_chat_repair_has_least_cost(spark):
    rng = random.Random(6)
    names = ["system", "user", "assistant", "tool", None]
    number = {"system": 0, "user": 1, "assistant": 2}
    data, want = [], {}
    for c in range(60):
        roles = [rng.choice(names) for _ in range(rng.randrange(1, 5))]
        data += [(c, k, r, rng.choice(["hi", "", None])) for k, r in enumerate(roles)]
        want[c] = repaired([number.get(r, -9) for r in roles])
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    assert {r.conv_id: r.cost for r in chat.chat_digests(df).collect()} == want
    parts = defaultdict(dict)
    for r in chat.format_chat(df).collect():
        parts[r.conv_id][r.part] = r.rendered
    digests = {r.conv_id: r.rendered_sha256 for r in chat.chat_digests(df).collect()}
    assert {c: hashlib.sha256("".join(p[k] for k in sorted(p)).encode()).hexdigest() for c, p in parts.items()} == digests
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_chat_settles_as_it_goes():
    rng = random.Random(7)
    turns = [(rng.choice([-1, 0, 1, 2]), str(i)) for i in range(500)]
    whole, parts = chat.Repair(), chat.Repair()
    given = []
    for x in turns:
        whole.add(*x)
        parts.add(*x)
        given += parts.settled()
    (cost, all_), (cost2, rest) = whole.finish(), parts.finish()
    assert cost == cost2 and all_ == given + rest and len(given) > 300


def hits(doc, items, w=10):
    split = lambda x: (x or "").encode().translate(WORD_TABLE).split()
    d = split(doc)
    hit, found = set(), set()
    for i, x in items:
        q = split(x)
        n = min(w, len(q))
        if not n:
            continue
        grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}
        for k in range(len(d) - n + 1):
            if tuple(d[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(d), len(hit), sorted(found)


@pytest.mark.parametrize("max_filter", [decontaminate.MAX_FILTER, 20])
def test_contamination(spark, max_filter):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "The", "é", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 7, 9, 10, 11, 25])))) for i in range(40)] + [(40, None), (3, "the, A. b"), (41, "long " * 30)]
    docs = []
    for _ in range(80):
        parts = [" ".join(rng.choice(["q", "r", "s", "a", "b"]) for _ in range(rng.randrange(20))) for _ in range(3)]
        docs.append(rng.choice([" ", ", "]).join([parts[0], rng.choice(items)[1] or "", parts[1], rng.choice(items)[1] or "", parts[2]]))
    docs += ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, docs), bench, max_filter=max_filter)
    found = {r.doc_id: (r.n_words, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), list(r["items"])) for r in got.collect()}
    assert found == {i: hits(x, items) for i, x in enumerate(docs)}
    clean = decontaminate.clean(frame(spark, docs), bench, max_filter=max_filter)
    assert {r.doc_id for r in clean.collect()} == {i for i, x in found.items() if not x[2]} and clean.columns == frame(spark, docs).columns
    assert decontaminate.contamination(frame(spark, docs), bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.contamination(frame(spark, docs).limit(0), bench).count() == 0


def test_quality_on_held_out_labels(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, big).collect()}
    labels = [r for r in spark.read.parquet(f"{big}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(labels) > 40 and sum(got[r.doc_id].predicted == r.quality for r in labels) > 0.95 * len(labels)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    weights = quality.train(frame(spark, ODD), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(frame(spark, ODD).drop("score"), weights).collect()} == {0.5}


def test_language_model(spark, corpus, texts, monkeypatch):
    model = lm.train(corpus.where(crc_remainder("doc_id", 10) != 0))
    got = {r.doc_id: r for r in lm.score(corpus, model).collect()}
    split = {i: x.encode().lower().split() + ["</s>"] for i, x in texts}
    c, bi = Counter(), Counter()
    for i, x in split.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(x)
            bi.update(zip(["<s>", *x[:-1]], x, strict=True))
    n, v, types = sum(c.values()), len(c), len(bi)
    left, total, follow = Counter(b for _, b in bi), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), k in bi.items():
        total[a] += k
        follow[a][min(k, 3) - 1] += 1
    of = lambda x: [sum(k == m for k in x.values()) for m in range(1, 5)]
    d, e = (0.0, *lm.discounts(of(bi))), (0.0, *lm.discounts(of(left)))
    rest = sum(e[min(k, 3)] for k in left.values()) / types
    low = lambda w: (left[w] - e[min(left[w], 3)]) / types + rest / (v + 1)

    def p(a, b):
        if not total[a]:
            return low(b)
        return (bi[a, b] - d[min(bi[a, b], 3)]) / total[a] + sum(d[k + 1] * follow[a][k] for k in range(3)) / total[a] * low(b)

    assert (model.tokens, model.distinct) == (n, v)
    for i, x in split.items():
        assert got[i].n_tokens == len(x) and got[i].n_known == sum(w in c for w in x)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x))
        assert got[i].score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *x[:-1]], x, strict=True)))
    assert sum(low(w) for w in c) + low("no such word") == pytest.approx(1)
    empty = lm.train(corpus.limit(0))
    assert {r.score for r in lm.score(frame(spark, [None, "a b"]), empty).collect()} == {0.0}


def test_html_text():
    page = "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div class='ad'>Buy, now. Now!</div><article><h1>A &amp; B</h1><p>One  long\n sentence, with marks. <b>Bold</b>; more.<p>Two, too.<br>End.</p><section class=comments><p>I think, so.</p></section></article><footer>(c)</footer>"
    assert html.main_text(page) == "A & B\nOne long sentence, with marks. Bold; more.\nTwo, too. End."
    for x in ("", "<", "<p", "plain text", "<!-- no end", "<script>var a='</p>'", "<p title='>'>x</p>", "&amp", "<a href=\"x>y</a>"):
        assert isinstance(html.main_text(x), str)
    assert html.main_text("plain text") == "plain text"


def test_html_names_do_not_leave_out_a_page():
    text = "<h1>Title</h1><p>One long sentence, with marks. And more of it.</p><p>Two, too. And an end, as long as the first one.</p>"
    want = "Title\nOne long sentence, with marks. And more of it.\nTwo, too. And an end, as long as the first one."
    for page in (
        f"<body class='no-sidebar'>{text}</body>", f"<html class='menu-closed'><body>{text}</body></html>", f"<body class=menu><div id='page' class='header-fixed'>{text}</div></body>",
        f"<article class='post category-notices has-comments'>{text}</article>", f"<main id=search>{text}</main>", f"<div class='content header'>{text}</div>", f"<form id=aspnet><div data-id='menu'>{text}</div></form>", f"<span class=ad><div>{text}</div></span>",
    ):
        assert html.main_text(f"{page}<div class='x ad'>Buy, now.</div>") == want, page
    assert html.main_text("<p>A <span class=search>term</span> that is said, <span class='box ad'>Buy!</span> and so on.") == "A term that is said, and so on."


def test_html_keeps_content_outside_the_largest_element():
    long = "A sentence of the body, with marks. And some more of it, which goes on. " * 4
    intro = "The intro says what it is about, in two sentences. It is much shorter."
    page = f"<ul class=x><li>Home<li>About</ul><div id=content><h1>Title</h1><p>{intro}</p><div class=body><p>{long}</p><p>{long}</p></div></div><footer>(c)</footer>"
    assert html.main_text(page).split("\n")[-4:] == ["Title", intro, long.strip(), long.strip()]
    page = f"<main><article><h2>One</h2><p>{long}</p><p>{long}</p></article><article><h2>Two</h2><p>{intro}</p></article></main>"
    assert html.main_text(page).split("\n") == ["One", long.strip(), long.strip(), "Two", intro]
    page = f"<div><h1>Title</h1><p>{intro}</p><section><p>{long}</p><p>{long}</p></section><ul><li>{intro}</ul></div>"
    assert html.main_text(page).split("\n") == ["Title", intro, long.strip(), long.strip(), intro]
    menu = "".join(f"<div class=m><a href=/{k}>Go {k}</a></div>" for k in range(30))
    assert "Go 5" not in html.main_text(f"{menu}<section><h1>Title</h1><p>{intro}</p><p>{long}</p></section>")


def test_html_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x")], "page_id long, html string")
    assert sorted(rows(html.extract(df), "page_id", "text")) == [(1, ""), (2, ""), (3, "x")]
    assert html.extract(df.limit(0)).count() == 0


def brute_repeats(texts, n):
    seen = Counter(b[k : k + n] for b in texts for k in range(len(b) - n + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        runs = np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        out.append((len(b), int(gone.sum()), int(runs), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("max_group", [repeats.MAX_GROUP, 3])
def test_repeats(spark, max_group, monkeypatch):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([0, 30, 39, 60, 300, 900]))) for _ in range(40)]
    passages = ["".join(rng.choice("xyz") for _ in range(n)) for n in (41, 60, 100)]
    docs = []
    for _ in range(120):
        x = rng.choice(base)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(x) + 1)
            x = x[:k] + rng.choice(passages) + x[k:]
        docs.append(rng.choice(["", "ab" * 30, "hello world " * 9]) + x if rng.random() < 0.2 else x)
    docs += [None, "", "a" * 200]
    raw = [(x or "").encode() for x in docs]
    for length, shared in ((40, None), (400, None), (60, 40), (400, 41), (41, 40)):
        monkeypatch.setattr(repeats, "MAX_KEYS", 0 if length == 41 else 1 << 20)
        got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, docs), length=length, max_group=max_group, shared=shared).collect()}
        found = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (got[i] for i in range(len(docs)))]
        assert found == brute_repeats(raw, length)
        if shared:
            assert [got[i].n_shared for i in range(len(docs))] == [x[1] for x in brute_repeats(raw, shared)]
    kept = repeats.remove_repeats(frame(spark, docs), length=40, max_group=max_group, texts=True)
    assert kept.columns[:8] == frame(spark, docs).columns and kept.count() == len(docs)
    assert repeats.remove_repeats(frame(spark, docs).limit(0)).count() == 0


def compared(strings, lengths, reach):
    """What suffix order finds in strings (hash, text, at, left, bytes): the bytes covered, by text and length."""
    names = ["hash", "k1", "k2", "at", "left", "string", "end"]
    lined = sorted(strings, key=lambda x: x[0])
    batch = pa.RecordBatch.from_pydict(dict(zip(names, zip(*((h, k, 0, at, left, x, None) for h, k, at, left, x in lined), strict=True), strict=True)))
    out = defaultdict(set)
    for found in repeats._compare(lengths, reach)(iter([batch])):
        for r in found.to_pylist():
            out[r["k1"], r["length"]].update(range(r["a"], r["b"]))
    return out


def test_a_crowd_dealt_by_rounds_is_ordered_alike():
    """strings of one anchor, too many for a task, go on in suffix order by parts of the rounds, down to one round."""
    rng = random.Random(11)
    lengths, rounds = (40, 60), 9
    gram = "".join(rng.choice("abc") for _ in range(32))
    sides = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(6)]
    texts = [(rng.choice(sides)[rng.randrange(40) :] + gram + rng.choice(sides)[: rng.randrange(40)]).encode() for _ in range(60)]
    strings = [(5, k, x.index(gram.encode()), min(x.index(gram.encode()), rounds - 1)) for k, x in enumerate(texts)]
    strings = [(h, k, at, left, texts[k][at - left : at + 60]) for h, k, at, left in strings]
    whole = compared(strings, lengths, rounds - 1)
    assert sum(map(bool, whole.values())) > 20
    for parts in ((3,), (3, 1), (1,)):
        for length in lengths:
            dealt, left = strings, rounds
            for part in parts:
                batch = pa.RecordBatch.from_pydict(dict(zip(["hash", "k1", "k2", "at", "left", "string"], zip(*((h, k, 0, at, before, x) for h, k, at, before, x in dealt), strict=True), strict=True)))
                dealt = [(r["hash"], r["k1"], r["at"], r["left"], r["string"]) for b in repeats._deal(length, left, part)(iter([batch])) for r in b.to_pylist()]
                left = part
            found = compared(dealt, (length,), left - 1)
            assert {k: x for k, x in found.items() if x} == {k: x for k, x in whole.items() if x and k[1] == length}


def test_a_common_string_takes_little_memory():
    """As many strings as a task sorts at once, all of whose windows repeat; 115 MB when their spans were read at once."""
    n = repeats.MAX_GROUP
    string = bytes(random.Random(1).choices(b"abcdefgh ", k=568))
    columns = {"hash": [7] * n, "k1": range(n), "k2": [0] * n, "at": [168] * n, "left": [168] * n, "string": [string] * n, "end": pa.array([None] * n, pa.int32())}
    batch = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    tracemalloc.start()
    found = pa.Table.from_batches(repeats._compare((400, 200), 168)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 2 * n and set(found["a"].to_pylist()) == {0} and set(found["b"].to_pylist()) == {368, 568}
    assert peak < 60e6


def test_repeats_leave_columns_of_the_same_names_alone(spark):
    rng = random.Random(7)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(60))
    texts = [f"one {shared} x", f"two {shared} y", "alone", None, "", f"one {shared} x"]
    cols = ["k1", "k2", "kept", "copied", "row", "n_bytes", "own_sha256", "a.b"]
    docs = spark.createDataFrame([(i, x, *[f"{c}{i}" for c in cols]) for i, x in enumerate(texts)], ["doc_id", "text", *cols])
    got = repeats.remove_repeats(docs, length=40, texts=True)
    assert got.columns == [*docs.columns, "n_removed", "n_spans", "kept_sha256"]
    found = {r[0]: tuple(r) for r in got.collect()}
    assert all(found[i][2:10] == tuple(f"{c}{i}" for c in cols) for i in range(len(texts)))
    assert [found[i][1] for i in range(len(texts))] == ["", "twoy", "alone", None, "", ""]  # the spaces around are shared too
