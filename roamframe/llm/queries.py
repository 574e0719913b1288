"""The registered queries of the corpus operators: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fingerprints, html, lm, quality, repeats, simhash, token_counts
from ._common import crc_remainder, text_of


def tokenizer_path(name: str) -> str:
    """A public tokenizer file: in the folder named by TOKENIZERS_DIR, or of the installed package."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), outputs=bpe.DIGESTS)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(table(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_remainder("doc_id", 5) == 0
    weights = quality.train(docs, labels.where(~held_out))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder("doc_id", 10) == 0, F.lit(False))
    model = lm.train(docs.where(~held_out))
    scored = lm.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", text_of("text").alias("text"), F.length("text").cast("long").alias("n_chars"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), shared=repeats.PASSAGE)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_fingerprints, op3_simhash, op4_bpe, op5_chat, op6_decontamination, op7_quality, op8_language_model, op9_html_text, op10_repeats, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _repeats_sql(length: int, name: str) -> str:
    """The windows of length bytes that begin twice, as spans: (r, a, b), 1-based, b beyond."""
    return f"""{name}_w as materialized (select r, i, md5(e[i:i + {length - 1}]) as x from (select r, e, unnest(range(1, n - {length - 2})) as i from d where n >= {length})),
{name}_t as (select r, i from {name}_w where x in (select x from {name}_w group by x having count(*) > 1)),
{name}_g as (select r, i, sum(new) over (partition by r order by i) as k from (select r, i, case when i - lag(i) over (partition by r order by i) <= {length} then 0 else 1 end as new from {name}_t)),
{name} as (select r, min(i) as a, max(i) + {length} as b from {name}_g group by r, k)"""


_WHITE = r"[^\x20\x09-\x0D]+"


def _crc_sql(col: str) -> str:
    """CRC-32 of a column's ASCII text, bit by bit."""
    bits = f"flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(cast({col} as varchar), '')])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}::bigint[]), lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))), 4294967295)"


def _discounts_sql(n: str, d: str) -> str:
    """Three discounts from numbers of types seen once to four times."""
    y = f"({n}1 / ({n}1 + 2 * {n}2))"
    known = f"{n}1 > 0 and {n}2 > 0 and {n}3 > 0 and {n}4 > 0"
    return ", ".join(f"case when {known} then least(greatest({k} - {k + 1} * {y} * {n}{k + 1} / {n}{k}, 0), {k}) else 0.5 end as {d}{k}" for k in (1, 2, 3))


#: The others are out of reach of SQL: tests compare them with brute force, libraries or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({_LOWER}, '{_WORDS}') as w from benchmark),
bw as (
    select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as x
    from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)
),
dw as (
    select r, i, n, array_to_string(w[i:i + n - 1], ' ') as x
    from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)
),
hit as (select r, i, n, x from dw where x in (select x from bw)),
words as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from hit) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit join bw using (x)) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)""",
    "op10_repeats": f"""
with d as materialized (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as e, hex(e) as h, strlen(coalesce(text, '')) as n from documents),
{_repeats_sql(repeats.LENGTH, 'cut')},
{_repeats_sql(repeats.PASSAGE, 'low')},
gaps as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 1) as from_ from cut),
kept as (select r, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last, string_agg(h[2 * from_ - 1:2 * a - 2], '' order by a) as head from gaps join d using (r) group by r),
shared as (select r, sum(b - a) as n_shared from low group by r)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, cast(coalesce(n_shared, 0) as bigint) as n_shared,
sha256(unhex(case when last is null then h else head || h[2 * last - 1:] end)) as kept_sha256
from d left join kept using (r) left join shared using (r)""",
    "op8_language_model": f"""
with d as materialized (select r, doc_id, w, coalesce({_crc_sql('doc_id')} % 10 = 0, false) as held_out from (select row_number() over () as r, doc_id, list_append(regexp_extract_all({_LOWER}, '{_WHITE}'), chr(1)) as w from documents)),
tok as materialized (select r, held_out, w[i] as v, case when i = 1 then chr(2) else w[i - 1] end as u from (select r, held_out, w, unnest(range(1, len(w) + 1)) as i from d)),
bi as materialized (select u, v, count(*) as c from tok where not held_out group by u, v),
uni as materialized (select v, sum(c) as c, count(*) as l from bi group by v),
ctx as materialized (select u, sum(c) as total, count(*) filter (c = 1) as n1, count(*) filter (c = 2) as n2, count(*) filter (c > 2) as n3 from bi group by u),
n as (select coalesce(sum(c), 0) as tokens, count(*) as vocab, coalesce(sum(l), 0) as types, count(*) filter (l = 1) as l1, count(*) filter (l = 2) as l2, count(*) filter (l = 3) as l3, count(*) filter (l = 4) as l4 from uni),
b as (select count(*) filter (c = 1) as b1, count(*) filter (c = 2) as b2, count(*) filter (c = 3) as b3, count(*) filter (c = 4) as b4 from bi),
p as materialized (select tokens, vocab, types, l1, l2, {_discounts_sql('b', 'd')}, {_discounts_sql('l', 'e')} from n, b),
t as (
    select tok.r, coalesce(uni.c, 0) as c, coalesce(uni.l, 0) as l, coalesce(bi.c, 0) as seen, coalesce(ctx.total, 0) as total, n1, n2, n3
    from tok left join uni on tok.v = uni.v left join bi on tok.u = bi.u and tok.v = bi.v left join ctx on tok.u = ctx.u
),
x as (
    select t.*, p.*, case when types > 0 then (l - case least(l, 3) when 0 then 0 when 1 then e1 when 2 then e2 else e3 end) / types + (e1 * l1 + e2 * l2 + e3 * (vocab - l1 - l2)) / types / (vocab + 1) else 1.0 / (vocab + 1) end as low,
    case when total > 0 then (d1 * n1 + d2 * n2 + d3 * n3) / total else 1 end as gamma, case when seen = 0 then 0 when seen = 1 then d1 when seen = 2 then d2 else d3 end as off
    from t, p
),
s as (
    select r, count(*) as n_tokens, count(*) filter (c > 0) as n_known, sum(log10((c + 0.1) / (tokens + 0.1 * (vocab + 1)))) as base_score, sum(log10((seen - off) / greatest(total, 1) + gamma * low)) as score
    from x group by r
)
select doc_id, held_out, n_tokens, n_known, cast(tokens as bigint) as train_tokens, round(base_score, 6) as base_score, round(score, 6) as score from d join s using (r), p""",
}
