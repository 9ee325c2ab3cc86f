"""Notes, text vectors and similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import knowledge as K
from ...session import cut_lineage, scratch_path
from .checks import monthly_results, oracle as results_oracle
from .registry import over, query, table, with_views

# Every document is a note on the table named after its source.
NOTES = """select cast(doc_id as string) as doc_id, concat('src.', source) as table_fq_name, concat('Note ', lang) as title,
    text as content, cast(doc_id as double) as created_at from documents"""
# A log over the notes: all are added, English ones are rewritten, long ones deleted at the end.
_LOG = """select *, 1 as seq, false as deleted from notes
    union all select doc_id, table_fq_name, 'Rewritten', concat('v2 ', content), created_at, 2, false from notes where title = 'Note en'
    union all select doc_id, null, null, null, null, 3, true from notes where length(content) > 3000"""
_CURRENT = """select doc_id, table_fq_name, title, content, created_at from
    (select *, row_number() over (partition by doc_id order by seq desc) as n from log) where n = 1 and not deleted"""


def notes(spark, sf_dir):
    return over(spark, NOTES, "documents", table(spark, sf_dir, "documents"))


def _log(spark, sf_dir):
    return over(spark, _LOG, "notes", notes(spark, sf_dir))


def doc_oracle(body: str, **extra: str) -> str:
    return with_views(body, notes=NOTES, log=_LOG, cur=_CURRENT, **extra)


_DOC = "doc_id, table_fq_name, title, md5(content) as content_md5"


def _rounded(weight):
    """round(weight, 9) of weights from 0 to 1 as DuckDB has it, without a decimal for each."""
    return F.floor(weight * 1e9 + 0.5) / 1e9


def _shown(docs):
    return docs.select("doc_id", "table_fq_name", "title", F.md5("content").alias("content_md5"))


@query("upsert_docs", doc_oracle(f"select {_DOC} from cur"))
def upsert_docs(spark, sf_dir):
    return _shown(K.current_docs(_log(spark, sf_dir)))


@query("delete_docs", doc_oracle("select doc_id from notes where doc_id not in (select doc_id from cur)"))
def delete_docs(spark, sf_dir):
    return notes(spark, sf_dir).join(K.current_docs(_log(spark, sf_dir)), "doc_id", "left_anti").select("doc_id")


@query("get_docs", doc_oracle(f"select {_DOC} from cur where table_fq_name = 'src.src3'"))
def get_docs(spark, sf_dir):
    return _shown(K.current_docs(_log(spark, sf_dir)).filter("table_fq_name = 'src.src3'"))


@query("knowledge_for_table", with_views(
    """select t.table_fq_name, count(n.doc_id) as notes from (select distinct concat('src.', source) as table_fq_name from documents
       union all select 'src.none') t left join notes n using (table_fq_name) group by 1""", notes=NOTES))
def knowledge_for_table(spark, sf_dir):
    known = notes(spark, sf_dir)
    none = spark.range(1).select(F.lit("src.none").alias("table_fq_name"))
    tables = known.select("table_fq_name").distinct().unionByName(none)
    return K.docs_for_tables(tables, known).groupBy("table_fq_name").agg(F.count("doc_id").alias("notes"))


# -- vectors ---------------------------------------------------------------
_BUCKET = "('0x' || substr(md5(term), 1, 8))::bigint % 4096"


def postings_oracle(source: str, key: str, text: str) -> str:
    return f"""select {key}, bucket, tf, tf / sqrt(sum(tf * tf) over (partition by {key})) as weight from (
        select {key}, {_BUCKET} as bucket, count(*) as tf from (
          select {key}, unnest(regexp_extract_all(lower({text}), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)) as term from {source}) group by 1, 2)"""


@query("embed", with_views("select doc_id, bucket, tf, round(weight, 9) as weight from e",
                           e=postings_oracle("documents", "doc_id", "text")))
def embed(spark, sf_dir):
    return K.embed(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", F.col("bucket").cast("long").alias("bucket"), "tf", _rounded(F.col("weight")).alias("weight"))


@query("l2_norms", with_views("select doc_id, round(sqrt(sum(weight * weight)), 9) as norm, count(*) as buckets from e group by 1",
                              e=postings_oracle("documents", "doc_id", "text")))
def l2_norms(spark, sf_dir):
    return K.embed(table(spark, sf_dir, "documents", "doc_id", "text")).groupBy("doc_id").agg(
        F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 9).alias("norm"), F.count(F.lit(1)).alias("buckets"))


@query("vector_upsert", with_views(
    "select doc_id, bucket, tf, round(weight, 9) as weight from e",
    docs="select doc_id, case when lang = 'fr' then concat('neu ', text) else text end as text from documents",
    e=postings_oracle("docs", "doc_id", "text")))
def vector_upsert(spark, sf_dir):
    """A kept index, built once, after some of its texts have changed."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    index = _index(spark, docs)
    index.upsert(docs.filter("lang = 'fr'").select("doc_id", F.concat(F.lit("neu "), "text").alias("text")))
    return index.postings().select("doc_id", F.col("bucket").cast("long").alias("bucket"), "tf",
                                   _rounded(F.col("tf") / F.col("norm")).alias("weight"))


_HITS = """select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from (
    select q.query_id, d.doc_id, round(sum(q.weight * d.weight), 9) as score from q join d using (bucket) group by 1, 2) where score > 0"""
_QUERIES = postings_oracle("(select item_id as query_id, text from benchmark)", "query_id", "text")


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark, texts):
    index = K.VectorIndex(spark, scratch_path(spark, "index"))
    index.build(texts)
    return index


def _hits(spark, sf_dir, k=5):
    return _index(spark, table(spark, sf_dir, "documents", "doc_id", "text")).search(_asked(spark, sf_dir), k)


def hit_oracle(body: str) -> str:
    return with_views(body, d=postings_oracle("documents", "doc_id", "text"), q=_QUERIES, hits=_HITS)


@query("similarity_query", hit_oracle("select query_id, doc_id, round(score, 6) as score from hits where rank <= 5"))
def similarity_query(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("topk_similarity", """select source as query_id, doc_id, score, rank from (
    select source, doc_id, n_chars / 1000 as score, cast(row_number() over (partition by source order by n_chars / 1000 desc, doc_id) as int) as rank
    from documents) where rank <= 3""")
def topk_similarity(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id",
                                                    (F.col("n_chars") / 1000).alias("score"))
    return K.top_hits(hits, 3)


@query("search_hits_to_docs", hit_oracle(
    "select query_id, rank, d.doc_id, d.lang, d.source from hits join documents d using (doc_id) where rank <= 5"))
def search_hits_to_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return K.hits_to_docs(_hits(spark, sf_dir), docs).select("query_id", "rank", "doc_id", "lang", "source")


_NOTE_TEXT = "(select doc_id, table_fq_name, concat(table_fq_name, ' | ', title, chr(10), content) as text from notes{})"


def search_oracle(body: str, where: str = "") -> str:
    return with_views(body, notes=NOTES, d=postings_oracle(_NOTE_TEXT.format(where), "doc_id", "text"), q=_QUERIES, hits=_HITS)


@query("search", search_oracle("select query_id, rank, doc_id from hits where rank <= 5"))
def search(spark, sf_dir):
    return _search(spark, sf_dir)


def _search(spark, sf_dir, **options):
    known = notes(spark, sf_dir)
    index = _index(spark, K.indexed_text(known))
    return K.search(known, _asked(spark, sf_dir), 5, index=index, **options).select("query_id", "rank", "doc_id")


@query("search_exact", search_oracle("select query_id, rank, doc_id from hits where rank <= 5", " where table_fq_name = 'src.src3'"))
def search_exact(spark, sf_dir):
    return _search(spark, sf_dir, table="src.src3")


@query("search_parity", search_oracle("""select query_id, cast(row_number() over (partition by query_id order by rank) as int) as rank, doc_id
    from hits join notes using (doc_id) where rank <= 15 and table_fq_name = 'src.src3'
    qualify row_number() over (partition by query_id order by rank) <= 5"""))
def search_parity(spark, sf_dir):
    """The overfetch variant: three times k over all tables, then the table filter."""
    return _search(spark, sf_dir, table="src.src3", overfetch=True)


_LABEL_VECTORS = """select label, list(m order by i)::double[] as v from (
    select label, i, round(avg(x), 6) as m from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings)
    group by 1, 2) group by 1"""


@query("dense_similarity", with_views(
    """select query_id, doc_id, round(score, 6) as score from (
         select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from (
           select l.label as query_id, e.vec_id as doc_id, round(list_cosine_similarity(l.v, e.embedding::double[]), 9) as score
           from centres l, embeddings e) where score > 0) where rank <= 5""", centres=_LABEL_VECTORS))
def dense_similarity(spark, sf_dir):
    """Nearest vectors to the mean vector of each label."""
    vectors = table(spark, sf_dir, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    # One entry per dimension: a bounded group.
    centres = parts.groupBy(F.col("label").alias("query_id")).agg(
        F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p")).select(
        "query_id", F.transform("p", lambda s: s["m"]).alias("vector"))
    docs = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return K.similar_vectors(docs, cut_lineage(centres), 5).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("cosine_pairs", """select vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as score
    from embeddings a join (select vec_id - 1 as vec_id, embedding from embeddings) b using (vec_id)""")
def cosine_pairs(spark, sf_dir):
    """Each vector against the next one."""
    vectors = table(spark, sf_dir, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return vectors.join(after, "vec_id").select(
        "vec_id", F.round(K.cosine(F.col("embedding"), F.col("b")), 9).alias("score"))
