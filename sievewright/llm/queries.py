"""Registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, exact_dedup, language, line_dedup, minhash, mixing, packing, pii, quality_model, quality_rules,
               resampling, token_count, topk_search)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_pack")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@query("op2_quality_model")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_model.quality_scores(documents(spark, sf_dir), labels)


@query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


RULES_SQL = r"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    w as (select r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
    win as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] as k
            from w, unnest(range(1, len(ws) - 3)) as u(i)),
    twice as (select r, i from (select r, i, count(*) over (partition by r, k) as n from win) where n > 1),
    covered as (select r, count(distinct i + j) as n from twice, unnest(range(0, 5)) as v(j) group by r),
    s as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
                 (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
                 len(ls) as n_lines, len(list_intersect(ws, [STOPS])) as n_stop
          from w left join covered c using (r)),
    b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not (base_failed or 100 * n_symbols > 25 * n_words or 100 * word_chars > 2000 * n_words
                or (100 * n_words > 60 * word_chars and n_words >= 50) or 100 * n_dup_lines > 50 * n_lines
                or (n_stop < 2 and n_words >= 80)) as kept
    from b""".replace("STOPS", ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS))


@query("op4_quality_rules", RULES_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(documents(spark, sf_dir, "doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


@query("op6_page_languages")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return language.page_languages(pages, documents(spark, sf_dir, "doc_id", "text", "lang"))


@query("op7_exact_duplicates", r"""
    with low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz') as t from documents)
    select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
           doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
    from low""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@query("op8_line_spread")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean_lines(documents(spark, sf_dir))
    return cleaned.select("row.doc_id", "n_lines", "n_removed", F.md5("row.text").alias("text_md5"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


@query("op10_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = mixing.mix_plan(documents(spark, sf_dir))
    plan = sources.withColumnRenamed("source", "of")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * mixing.repeats(F.col("spot"))).cast("long").alias("taken"), "source")


@query("op11_resample", r"""
    with recursive step as (select i, i::bigint as c, 0 as k from range(256) as u(i)
                  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
    crc as (select list(c order by i) as t from step where k = 8),
    x as (select 'd' as side, row_number() over () as r, doc_id, text from documents
          union all select 'b', row_number() over (), null, text from benchmark),
    w as (select side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from x),
    g as (select side, r, array_to_string(ws[i:i + m - 1], ' ') as g
          from w, unnest(range(1, 4)) as a(m), unnest(range(1, len(ws) - m + 2)) as b(i)),
    f as (select side, r, g, count(*) as n from g group by all),
    h as (select g, hex(encode(g)) as h from f group by g),
    v as (select g, xor(list_reduce(list_transform(range(0, (length(h) // 2)::bigint + 1),
                     lambda i: case when i = 0 then 4294967295 else ('0x' || substr(h, 2 * i - 1, 2))::bigint end),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as b from h, crc),
    e as (select side, r, b, sum(n)::bigint as n from f join v using (g) group by all),
    c as (select b, coalesce(sum(n) filter (side = 'b'), 0) as t, coalesce(sum(n) filter (side = 'd'), 0) as s from e group by b),
    o as (select coalesce(sum(t), 0)::double as tt, coalesce(sum(s), 0)::double as ss from c),
    l as (select b, floor(1000 * ln((t + 1)::double * (ss + 10000) / ((s + 1)::double * (tt + 10000))))::bigint as gain from c, o),
    y as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from e join l using (b) where side = 'd' group by r),
    z as (select w.doc_id, len(ws) >= 20 as able, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(w.doc_id::varchar, '')), 1, 8))::bigint
                                                             + 0.5::double) / 4294967296)))::bigint as score
          from w left join y using (r) where side = 'd'),
    k as (select *, row_number() over (partition by able order by score desc, doc_id nulls last) as place,
                 5 * count(*) over (partition by able) // 100 as drawn from z)
    select doc_id, n_features, weight, score, case when able and place <= drawn then place end as rank from k""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resampling.resample(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_search", """
    with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e
               from embeddings
               where embedding is not null
                 and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
    s as (select q.r, q.vec_id as query_id, v.r as cr, v.vec_id,
                 coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: coalesce(p[1]::bigint * p[2]::bigint, 0))), 0)::bigint as score
          from v as q join v on q.vec_id % 100 = 0 and q.r <> v.r),
    o as (select *, row_number() over (partition by r order by score desc, vec_id nulls last, cr)::int as rank from s)
    select query_id, rank, vec_id, score from o where rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.top_hits(vectors, F.col("vec_id") % 100 == 0)


@query("op13_collocations", r"""
    with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?\x0A-\x0D]')) as piece from documents),
    w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
    g as (select lang, m, array_to_string(ws[i:i + m - 1], ' ') as g
          from w, unnest(range(1, 6)) as a(m), unnest(range(1, len(ws) - m + 2)) as b(i)),
    f as (select lang, m, g, count(*) as f from g group by lang, m, g having count(*) >= 100),
    n as (select lang, sum(len(ws))::bigint as n from w group by lang),
    c as (select lang, m, g, f as a from f where m > 1),
    k as (select * from c where not exists (
              select 1 from c as x where x.lang = c.lang and x.m > c.m and 100 * x.a >= 100 * c.a
                                     and contains(' ' || x.g || ' ', ' ' || c.g || ' '))),
    s as (select k.lang, k.g, k.a, n.n, i, string_split(k.g, ' ') as ws from k join n using (lang), unnest(range(1, k.m)) as u(i)),
    t as (select s.lang, s.g, s.a, s.n, s.i, x.f as l, y.f as r, ((1000::hugeint * s.a * s.n) // (x.f::hugeint * y.f))::bigint as score
          from s join f as x on x.lang = s.lang and x.g = array_to_string(ws[1:i], ' ')
          join f as y on y.lang = s.lang and y.g = array_to_string(ws[i + 1:], ' ')),
    b as (select *, row_number() over (partition by lang, g order by score, i) as first from t),
    o as (select lang, row_number() over (partition by lang order by score desc, a desc, g) as rank, g as phrase, a, l, r, n, score
          from b where first = 1)
    select * from o where rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))
