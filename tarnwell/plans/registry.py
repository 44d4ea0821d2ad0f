"""The queries over the test tables and the SQL that each is compared with.

Query sets of searches are the rows whose id is divisible by 50; every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import text as X
from tarnwell.operators import align, chunking, evaluate, memory, metrics, search
from tarnwell.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# Scans and lookups ------------------------------------------------------------------------------------------


@query("select count(*) as chunks, count(distinct chunk_id) as ids, count(embedding) as vectors from document_chunks")
def chunk_count(s, d):
    return table(s, d, "document_chunks").agg(F.count("*").alias("chunks"), F.countDistinct("chunk_id").alias("ids"), F.count("embedding").alias("vectors"))


@query("select chunk_id, doc_id, coalesce(page, metadata_json.page_start) as page, coalesce(section, '') as section, length(content) as chars from document_chunks")
def chunk_scan(s, d):
    c = table(s, d, "document_chunks")
    return c.select("chunk_id", "doc_id", F.coalesce("page", "metadata_json.page_start").alias("page"), F.coalesce("section", F.lit("")).alias("section"), F.length("content").alias("chars"))


@query("""select id, split from tier3_rag where (split is null or split = 'test') and trim(coalesce(user_input, '')) <> ''
  and (coalesce(len(reference_contexts), 0) > 0 or coalesce(len(ground_truth_chunk_ids), 0) > 0 or evidence is not null)""")
def split_scan(s, d):
    t = table(s, d, "tier3_rag")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return t.where((F.col("split").isNull() | (F.col("split") == "test")) & (F.trim(F.coalesce("user_input", F.lit(""))) != "") & (some("reference_contexts") | some("ground_truth_chunk_ids") | F.col("evidence").isNotNull())).select("id", "split")


@query("select chunk_id, doc_id from document_chunks where chunk_id in (select unnest(ground_truth_chunk_ids) from tier3_rag)")
def point_lookup(s, d):
    ids = table(s, d, "tier3_rag").select(F.explode("ground_truth_chunk_ids").alias("chunk_id")).distinct()
    return table(s, d, "document_chunks").join(ids, "chunk_id", "left_semi").select("chunk_id", "doc_id")


@query("select chunk_id, len(embedding) as dims from document_chunks where embedding is not null and chunk_id in (select unnest(ground_truth_chunk_ids) from tier3_rag)")
def vector_lookup(s, d):
    ids = table(s, d, "tier3_rag").select(F.explode("ground_truth_chunk_ids").alias("chunk_id")).distinct()
    return table(s, d, "document_chunks").where("embedding is not null").join(ids, "chunk_id", "left_semi").select("chunk_id", F.size("embedding").cast("long").alias("dims"))


@query("select doc_id, sha256(text) as digest, strlen(text) as bytes from documents where text is not null")
def text_hash(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query("select doc_id, content_type from documents where content_type = 'web_page' and length(trim(text)) > 80")
def web_document_filter(s, d):
    return table(s, d, "documents").where("content_type = 'web_page' and length(trim(text)) > 80").select("doc_id", "content_type")


@query("""with new as (select doc_id, chunk_id, 'new' as version from document_chunks where id % 10 = 0),
old as (select doc_id, chunk_id, 'old' as version from document_chunks)
select doc_id, chunk_id, version from new union all
select doc_id, chunk_id, version from old where doc_id not in (select doc_id from new where doc_id is not null) and chunk_id not in (select chunk_id from new)""")
def batch_upsert(s, d):
    c = table(s, d, "document_chunks")
    old, new = c.select("doc_id", "chunk_id", F.lit("old").alias("version")), c.where("id % 10 = 0").select("doc_id", "chunk_id", F.lit("new").alias("version"))
    return memory.replace_documents(old, new)


@query("select doc_id, count(*) as purged from document_chunks where doc_id in (select doc_id from document_chunks where id % 50 = 0) group by doc_id")
def purge_counts(s, d):
    c = table(s, d, "document_chunks")
    return c.join(c.where("id % 50 = 0").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("purged"))


# Predicates and scalar functions -----------------------------------------------------------------------------


@query("""select id, regexp_matches(lower(coalesce(content, '')), 'synthesize meth|make bomb|illicit drug synthesis|how to kill|suicide method|fatal dose') as blocked,
  case when regexp_matches(lower(coalesce(content, '')), 'synthesize meth|make bomb|illicit drug synthesis|how to kill|suicide method|fatal dose|dosage adjustment|insulin dose|warfarin dose|stop medication') then 'high' else 'low' end as risk from messages""")
def guardrail_flags(s, d):
    blocked, risk = X.guardrail(F.col("content"))
    return table(s, d, "messages").select("id", blocked.alias("blocked"), risk.alias("risk"))


@query(r"""with q as (select id, user_input as q from tier3_rag)
select id, coalesce((
  (regexp_matches(q, '(?i)\band\b.*\b(?:what|how|why|when|which|compare|explain|describe)\b'))::int + (regexp_matches(q, '(?i)\b(?:compare|contrast|difference between)\b'))::int
  + (regexp_matches(q, '(?i)\b(?:also|additionally|furthermore)\b'))::int + (regexp_matches(q, '(?i)(?:1\.|2\.|a\)|b\))'))::int + (regexp_matches(q, '(?i)^(?:what|how|why|when|which)\b.*\band\b'))::int
) >= 1 and len(list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> '')) >= 8, false) as multi from q""")
def multi_part_flags(s, d):
    return table(s, d, "tier3_rag").select("id", X.is_multi_part(F.col("user_input")).alias("multi"))


@query()
def question_parts(s, d):
    return table(s, d, "tier3_rag").where("user_input is not null").select("id", F.posexplode(X.sub_questions(F.col("user_input"))).alias("place", "question"))


@query(r"""select chunk_id, trim(regexp_replace(regexp_replace(lower(section), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as heading,
  left(regexp_replace(regexp_replace(lower(section), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 50) as slug from document_chunks where section is not null""")
def heading_keys(s, d):
    return table(s, d, "document_chunks").where("section is not null").select("chunk_id", X.heading_key(F.col("section")).alias("heading"), X.slug(F.col("section")).alias("slug"))


@query("""select chunk_id, concat_ws(' ', case when page is not null then '[p.' || page || ']' end, nullif(concat_ws(' > ', nullif(doc_id, ''), nullif(section, '')), '')) as prefix from document_chunks""")
def context_prefixes(s, d):
    return table(s, d, "document_chunks").select("chunk_id", X.context_prefix(F.col("page"), F.col("doc_id"), F.col("section")).alias("prefix"))


@query(r"""with t as (select chunk_id, lower(content) as c from document_chunks where content is not null)
select distinct chunk_id, ref from (select chunk_id, unnest(list_concat(
  list_transform(regexp_extract_all(c, '\bchapter\s+([\d]+(?:\.\d+)*)', 1), lambda m: 'chapter_' || replace(m, '.', '_')),
  list_transform(regexp_extract_all(c, '\bsection\s+([\d]+(?:\.\d+)*)', 1), lambda m: 'section_' || replace(m, '.', '_')),
  list_transform(regexp_extract_all(c, '\btable\s+([\d]+(?:\.\d+)*)', 1), lambda m: 'table_' || replace(m, '.', '_')),
  list_transform(regexp_extract_all(c, '\bfigure\s+([\d]+(?:\.\d+)*)', 1), lambda m: 'figure_' || replace(m, '.', '_')),
  list_transform(regexp_extract_all(c, '\bappendix\s+([a-zA-Z\d]+(?:\.\d+)*)', 1), lambda m: 'appendix_' || replace(m, '.', '_')))) as ref from t)""")
def cross_references(s, d):
    return table(s, d, "document_chunks").where("content is not null").select("chunk_id", F.explode(X.cross_references(F.col("content"))).alias("ref"))


@query(r"""with m as (select id, lower(content) as t from messages where lower(trim(role)) = 'user' and content is not null),
f as (select id, 'age' as key, regexp_extract(t, '\b(i am|i''m)\s+(\d{1,3})\b', 2) as value, 0.9 as confidence from m
union all select id, 'allergy', trim(regexp_extract(t, 'allerg(y|ic)\s+to\s+([a-z\s-]+)', 2)), 0.85 from m
union all select id, 'condition', trim(regexp_extract(t, 'i have\s+([a-z0-9\s-]{3,40})', 1)), 0.65 from m)
select id, key, value, confidence::double as confidence from f where value <> ''""")
def fact_extract(s, d):
    m = table(s, d, "messages").where("lower(trim(role)) = 'user' and content is not null")
    return m.select("id", F.inline(X.extracted_facts(F.col("content"))))


@query()
def term_counts(s, d):
    c = table(s, d, "document_chunks").where("content is not null")
    return c.select("chunk_id", *[F.size(f(F.col("content"))).alias(n) for n, f in (("query", X.query_terms), ("document", X.document_terms), ("rerank", X.rerank_terms), ("judge", X.judge_terms), ("set", X.word_set), ("topic", X.topic_terms))], X.token_count(F.col("content")).alias("tokens"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def json_props(s, d):
    return table(s, d, "events").select("event_id", X.json_object(F.col("props"), "k bigint")["k"].alias("k"))


# Search and fusion -------------------------------------------------------------------------------------------

_DENSE = """select qid, id, round(sim, 6) as sim, rank from (
  select q.vec_id as qid, c.vec_id as id, list_cosine_similarity(q.embedding::double[], c.embedding::double[]) as sim,
    row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) desc, c.vec_id) as rank
  from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0) where rank <= 5"""


def _embedding_topk(s, d, k):
    e = table(s, d, "embeddings")
    return search.dense_topk(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), k, 64)


@query(_DENSE)
def dense_topk(s, d):
    return _embedding_topk(s, d, 5).select("qid", "id", r6("sim").alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"""with near as ({_DENSE.replace('rank <= 5', 'rank <= 20')}),
top as (select n.qid, e.label, row_number() over (partition by qid order by n.sim desc, e.label desc) as r from near n join embeddings e on e.vec_id = n.id),
votes as (select qid, label, count(*) as votes, min(r) as first from top where r <= 5 group by all),
best as (select *, row_number() over (partition by qid order by votes desc, first) as b from votes)
select qid, case when votes / 5.0 < 0.4 then 'vector' else label::varchar end as label, votes from best where b = 1""")
def knn_route_vote(s, d):
    near = _embedding_topk(s, d, 20).withColumn("sim", r6("sim")).join(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return search.knn_vote(near.drop("rank"))


@query(f"select qid, id, sim from ({_DENSE.replace('rank <= 5', 'rank = 1')}) where sim >= 0.3")
def semantic_cache_hit(s, d):
    return _embedding_topk(s, d, 1).select("qid", "id", r6("sim").alias("sim")).where("sim >= 0.3")


_TERMS = r"list_filter(list_transform(regexp_split_to_array(lower(coalesce({t}, '')), '\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) > 2)"
_DOC_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '\s+'), lambda w: length(w) > 2)"
_BM25 = f"""q as (select qid, term, count(*) as times from (select cast(substr(id, 4) as bigint) as qid, unnest({_TERMS.format(t='user_input')}) as term from tier3_rag where cast(substr(id, 4) as bigint) % 50 = 0) group by all),
docs as (select id, {_DOC_TERMS.format(t='content')} as terms from document_chunks),
mean as (select sum(len(terms)) / greatest(count(*), 1) as avgdl from docs),
tf as (select id, dl, term, count(*) as tf from (select id, len(terms) as dl, unnest(terms) as term from docs) group by all),
bm as (select qid, id, sum(times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from tf join q using (term) cross join mean group by all)"""


def _rag_queries(s, d):
    return table(s, d, "tier3_rag").withColumn("qid", F.substring("id", 4, 20).cast("long")).where("qid % 50 = 0").select("qid", F.col("user_input").alias("text"))


def _bm25(s, d, k, queries=None):
    return search.bm25_topk(_rag_queries(s, d) if queries is None else queries, table(s, d, "document_chunks").select("id", F.col("content").alias("text")), k)


@query(f"with {_BM25} select qid, id, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from bm) where rank <= 10")
def bm25_topk(s, d):
    return _bm25(s, d, 10).select("qid", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


_CHUNK_DENSE = """v as (select id, embedding::double[] as e, section from document_chunks where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
dense as (select * from (select q.id as qid, c.id, list_cosine_similarity(q.e, c.e) as sim, row_number() over (partition by q.id order by round(list_cosine_similarity(q.e, c.e), 9) desc, c.id) as rank
  from v q join v c on q.id <> c.id where q.id % 50 = 0) where rank <= 10)"""
_CHUNK_BM25 = _BM25[_BM25.index("docs as"):]
_CHUNK_TERMS = f"q as (select qid, term, count(*) as times from (select id as qid, unnest({_TERMS.format(t='section')}) as term from document_chunks where id % 50 = 0) group by all)"
_SPARSE = "sparse as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from bm where qid <> id) where rank <= 10)"
_FUSED = """a as (select qid, id, case when max(sim) over w > min(sim) over w then (sim - min(sim) over w) / (max(sim) over w - min(sim) over w) else 1.0 end as d from dense window w as (partition by qid)),
b as (select qid, id, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1.0 end as s from sparse window w as (partition by qid)),
fused as (select coalesce(a.qid, b.qid) as qid, coalesce(a.id, b.id) as id, 0.7 * coalesce(d, 0) + (1 - 0.7) * coalesce(s, 0) as score from a full join b on a.qid = b.qid and a.id = b.id),
top as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from fused) where rank <= 5)"""
_HYBRID = f"{_CHUNK_DENSE}, {_CHUNK_TERMS}, {_CHUNK_BM25}, {_SPARSE}, {_FUSED}"


def _two_lists(s, d, k=10):
    c = table(s, d, "document_chunks")
    q = c.where("id % 50 = 0")
    dense = search.dense_topk(q.select(F.col("id").alias("qid"), "embedding"), c.select("id", "embedding"), k, 64)
    return dense, search.bm25_topk(q.select(F.col("id").alias("qid"), F.col("section").alias("text")), c.select("id", F.col("content").alias("text")), k, own=False)


@query(f"with {_HYBRID} select qid, id, round(score, 6) as score, rank from top")
def hybrid_topk(s, d):
    dense, sparse = _two_lists(s, d)
    return search.fused(dense, sparse, 5).select("qid", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {_CHUNK_DENSE}, {_CHUNK_TERMS}, {_CHUNK_BM25}, {_SPARSE},
p as (select qid, id, 1.0 / rank as p from dense union all select qid, id, 0.75 / rank from sparse), g as (select qid, id, sum(p) as score from p group by all)
select qid, id, round(score, 6) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as r from g) where r <= 5""")
def rank_fusion(s, d):
    dense, sparse = _two_lists(s, d)
    return search.rank_fused(dense, sparse, 5).select("qid", "id", r6("score").alias("score"))


@query(f"""with {_CHUNK_DENSE}, {_CHUNK_TERMS}, {_CHUNK_BM25}, {_SPARSE},
u as (select qid, id, 0 as src, rank from dense union all select qid, id, 1, rank from sparse),
o as (select *, row_number() over (partition by qid, id order by src, rank) as n from u)
select qid, id, src::int as src, row_number() over (partition by qid order by src, rank) as rank from o where n = 1""")
def step_back_merge(s, d):
    dense, sparse = _two_lists(s, d)
    return search.step_back_merge(dense, sparse).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {_CHUNK_DENSE}, r as (select dense.qid, dense.id, coalesce(v.section, '_unknown') as section, dense.rank from dense join v using (id)),
n as (select *, row_number() over (partition by qid, section order by rank) as n from r)
select * from (select qid, id, section, row_number() over (partition by qid order by rank) as place from n where n <= 2) where place <= 5""")
def section_quota(s, d):
    dense, _ = _two_lists(s, d)
    ranked = dense.join(table(s, d, "document_chunks").select("id", "section"), "id")
    return search.section_quota(ranked, 5).select("qid", "id", "section", F.col("place").cast("long").alias("place"))


@query()
def mmr_topk(s, d):
    c = table(s, d, "document_chunks")
    dense, _ = _two_lists(s, d, 20)
    cand = dense.join(c.select("id", "section", "embedding"), "id").join(c.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("query")), "qid")
    return search.mmr(cand, 5)


@query()
def bm25_rerank(s, d):
    c = table(s, d, "document_chunks")
    top = _bm25(s, d, 20).select("qid", "id")
    cand = top.join(c.select("id", F.col("content").alias("text")), "id").join(_rag_queries(s, d).withColumnRenamed("text", "question"), "qid")
    return search.reranked(cand).select("qid", "id", r6("score").alias("score"), "rank")


# Chunks ------------------------------------------------------------------------------------------------------


def _numbered(s, d):
    c = table(s, d, "document_chunks")
    return c.select("doc_id", "chunk_id", "id", "section", "content", "page", F.coalesce("metadata_json.is_table", F.lit(False)).alias("is_table"), F.row_number().over(search.W.partitionBy("doc_id").orderBy("id")).alias("chunk_index"))


_NUMBERED = "n as (select *, coalesce(metadata_json.is_table, false) as is_table, row_number() over (partition by doc_id order by id) as chunk_index from document_chunks)"


@query()
def token_packing(s, d):
    return chunking.packed(table(s, d, "documents"))


@query(f"""with {_NUMBERED} select chunk_id, case when row_number() over w = 1 then 'intro' when lead(1) over w is null then 'conclusion' else 'body' end as chunk_position from n window w as (partition by doc_id, section order by chunk_index)""")
def position_tags(s, d):
    return chunking.position_tags(_numbered(s, d), ["doc_id", "section"], ["chunk_index"]).select("chunk_id", "chunk_position")


@query(f"""with {_NUMBERED},
b as (select *, case when lag(section) over w is not distinct from section and lag(is_table) over w = false and not is_table and row_number() over w > 1 then 0 else 1 end as opens from n window w as (partition by doc_id order by chunk_index)),
r as (select *, sum(opens) over (partition by doc_id order by chunk_index rows unbounded preceding) as run from b),
g as (select *, (row_number() over (partition by doc_id, run order by chunk_index) - 1) // 5 as batch from r)
select doc_id, parent_no, section, children, page_start, page_end, chars from (
  select doc_id, section, count(*) as children, min(page) as page_start, max(page) as page_end, sum(coalesce(length(content), 0)) as chars, row_number() over (partition by doc_id order by run, batch) - 1 as parent_no from g group by doc_id, run, batch, section)""")
def parent_groups(s, d):
    n = _numbered(s, d)
    p = chunking.parent_groups(n.withColumn("content", F.coalesce("content", F.lit(""))))
    joints = 2 * (F.col("children") - 1)
    return p.select("doc_id", "parent_no", "section", "children", "page_start", "page_end", (F.length("content") - joints).alias("chars"))


@query(f"""with {_NUMBERED} select a.chunk_id, b.chunk_id as neighbour_id from n a join n b on a.doc_id = b.doc_id and a.section = b.section and abs(a.chunk_index - b.chunk_index) = 1 where a.id % 50 = 0 and b.id % 50 <> 0""")
def adjacent_chunks(s, d):
    n = _numbered(s, d)
    return chunking.neighbours(n, n.where("id % 50 = 0").select("chunk_id"))


@query("select c.chunk_id, p.chunk_id as parent_chunk_id, length(p.content) as parent_chars from document_chunks c left join document_chunks p on p.chunk_id = c.metadata_json.parent_id")
def parent_resolution(s, d):
    c = table(s, d, "document_chunks")
    p = c.select(F.col("chunk_id").alias("parent_chunk_id"), F.length("content").alias("parent_chars"))
    return c.select("chunk_id", F.col("metadata_json.parent_id").alias("want")).join(p, F.col("want") == F.col("parent_chunk_id"), "left").select("chunk_id", "parent_chunk_id", "parent_chars")


@query()
def table_structure(s, d):
    return chunking.tables(table(s, d, "document_chunks")).select("chunk_id", "columns", "row_count", "size_tier", "linear", "parts")


@query(r"""with t as (select len(list_filter(regexp_split_to_array(coalesce(content, ''), '\s+'), lambda x: x <> '')) as t, coalesce(length(content), 0) as n, section, page, doc_id as doc from document_chunks)
select count(*) as chunks, round(avg(t), 6) as token_mean, median(t) as token_median, min(t)::int as token_min, max(t)::int as token_max, round(avg(n), 6) as char_mean, min(n)::int as char_min, max(n)::int as char_max,
  round(avg(coalesce(section <> '', false)::int), 6) as with_section, round(avg((page is not null)::int), 6) as with_page, round(avg((page is not null or coalesce(doc, '') <> '' or coalesce(section, '') <> '')::int), 6) as with_prefix,
  (select round(max(t) filter (i = lo) + (max(t) filter (i = lo + 1) - max(t) filter (i = lo)) * (max(spot) - max(lo)), 6) from (select t, i, 0.95 * (n + 1) as spot, floor(0.95 * (n + 1)) as lo from (select t, row_number() over (order by t) as i, count(*) over () as n from t))) as token_p95 from t""")
def chunk_profile(s, d):
    p = chunking.quality_profile(table(s, d, "document_chunks"))
    return p.withColumns({c: r6(c) for c in ("token_mean", "char_mean", "with_section", "with_page", "with_prefix", "token_p95")})


@query("""with p as (select doc_id, page, arg_min(section, id) filter (section <> '') as title, string_agg(content, chr(10) order by id) as body, count(nullif(section, '')) > 0 as headed from document_chunks where page is not null group by all),
t as (select doc_id, page, last_value(title ignore nulls) over (partition by doc_id order by page rows unbounded preceding) as title, body, headed from p),
k as (select * from t where title is not null and (coalesce(body, '') <> '' or headed)),
o as (select *, case when lag(title) over w = title and lag(page) over w = page - 1 then 0 else 1 end as opens from k window w as (partition by doc_id order by page)),
g as (select *, sum(opens) over (partition by doc_id order by page rows unbounded preceding) as win from o)
select doc_id, win::bigint as "window", min(title) as title, min(page) as page_start, max(page) as page_end from g group by doc_id, win""")
def article_windows(s, d):
    return align.windows(_pages(s, d)).drop("body", "headings")


def _pages(s, d):
    c = table(s, d, "document_chunks").where("page is not null")
    body = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("id", "content")))), lambda x: x["content"]))
    return c.groupBy("doc_id", "page").agg(F.min_by("section", F.when(F.col("section") != "", F.col("id"))).alias("title"), body.alias("body"), F.collect_set(F.when(F.col("section") != "", F.col("section"))).alias("headings"))


@query()
def page_alignment(s, d):
    return align.aligned(align.windows(_pages(s, d)), table(s, d, "document_chunks"))


# Sessions and facts ------------------------------------------------------------------------------------------


@query("""with f as (select session_id, arg_min(struct_pack(c := content), struct_pack(a := created_at, b := id)).c as t from messages where lower(trim(role)) = 'user' and created_at is not null group by 1)
select s.session_id, s.created_at, s.last_active, case when length(t) > 50 then left(t, 50) || '...' else t end as preview from sessions s left join f using (session_id)""")
def session_previews(s, d):
    return memory.previews(table(s, d, "sessions"), table(s, d, "messages").where("created_at is not null"))


@query("select session_id, id, rank from (select session_id, id, row_number() over (partition by session_id order by created_at desc nulls last, id desc) as rank from messages) where rank <= 6")
def recent_turns(s, d):
    return memory.recent_turns(table(s, d, "messages")).select("session_id", "id", F.col("rank").cast("long").alias("rank"))


_FACTS = """f as (select session_id, lower(trim(fact_key)) as key, trim(fact_value) as value, coalesce(confidence, 0) as confidence, created_at, id from user_facts where session_id is not null),
merged as (select session_id, key, value, confidence from (select *, row_number() over (partition by session_id, key order by confidence desc, created_at desc nulls last, id desc) as r from f where key <> '' and value <> '') where r = 1)"""


@query(f"with {_FACTS} select * from merged")
def fact_upsert(s, d):
    return memory.merged_facts(table(s, d, "user_facts"))


@query(f"""with {_FACTS} select session_id, max(value) filter (key = 'age') as age, coalesce(len(list(distinct value) filter (key = 'allergy')), 0) as allergies, coalesce(len(list(distinct value) filter (key = 'condition')), 0) as conditions from merged group by 1""")
def core_state(s, d):
    return memory.core_state(memory.merged_facts(table(s, d, "user_facts"))).select("session_id", "age", F.size("allergies").cast("long").alias("allergies"), F.size("conditions").cast("long").alias("conditions"))


@query("select session_id, count(*) as messages, count(content) as with_text, min(created_at) as first_at, max(created_at) as last_at from messages join sessions using (session_id) group by 1".replace("min(created_at)", "min(messages.created_at)").replace("max(created_at)", "max(messages.created_at)"))
def session_activity(s, d):
    m = table(s, d, "messages").join(table(s, d, "sessions").select("session_id"), "session_id")
    return m.groupBy("session_id").agg(F.count("*").alias("messages"), F.count("content").alias("with_text"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


# Evaluation --------------------------------------------------------------------------------------------------


def _ranked(s, d):
    c = table(s, d, "document_chunks")
    t = table(s, d, "tier3_rag").withColumn("qid", F.substring("id", 4, 20).cast("long"))
    top = _bm25(s, d, 10, t.select("qid", F.col("user_input").alias("text")))
    return t, top.join(c.select("id", "chunk_id", "section"), "id").drop("id").join(t.select("qid", "id"), "qid")


_EVIDENCE = """t as (select id, difficulty, evidence, ground_truth_chunk_ids, cast(substr(id, 4) as bigint) as qid from tier3_rag),
e as (select id, qid, difficulty, list_distinct(case when coalesce(len(evidence.required), 0) > 0 then list_transform(evidence.required, lambda x: x.chunk_id) else coalesce(ground_truth_chunk_ids, []) end) as req,
  list_distinct(list_transform(coalesce(evidence.supporting, []), lambda x: x.chunk_id)) as sup, list_distinct(list_transform(coalesce(evidence.hard_negative_candidates, []), lambda x: x.chunk_id)) as neg from t),
ranked as (select b.qid, c.chunk_id, c.section, b.rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from bm) b join document_chunks c on c.id = b.id where b.rank <= 5),
g as (select e.id, r.rank, r.section, r.chunk_id, case when list_contains(req, r.chunk_id) then 3 when list_contains(sup, r.chunk_id) then 2 when list_contains(neg, r.chunk_id) then 1 else 0 end as grade from ranked r join e using (qid)),
h as (select *, sum((grade >= 2)::int) over (partition by id order by rank rows unbounded preceding) as hits from g),
o as (select id, max((grade = 3)::int) as hit, count(distinct chunk_id) filter (grade = 3) as found, sum((grade >= 2)::int) as n_good, min(rank) filter (grade = 3) as first,
  sum(hits / rank) filter (grade >= 2) as ap, max(hits) as n_hits, sum(grade / log2(rank + 1)) as dcg, count(distinct nullif(section, '')) as sections from h group by id),
ideal as (select id, list_concat(list_concat(list_transform(req, lambda x: 3), list_transform(sup, lambda x: 2)), list_transform(neg, lambda x: 1))[1:5] as gains from e),
i as (select id, sum(g / log2(p + 1)) as idcg from (select id, unnest(gains) as g, generate_subscripts(gains, 1) as p from ideal) group by id),
m as (select e.id, e.difficulty, coalesce(hit, 0)::double as hit, coalesce(found / greatest(len(req), 1), 0) as recall, coalesce(n_good / 5, 0) as precision, least(len(req) + len(sup), 5) / 5 as max_precision, coalesce(1.0 / first, 0) as mrr,
  coalesce(case when n_hits > 0 then ap / n_hits end, 0) as map, coalesce(dcg / nullif(idcg, 0), 0) as ndcg, coalesce(sections / 5, 0) as section_diversity from e left join o using (id) left join i using (id))"""
_BM25_ALL = _BM25.replace(" where cast(substr(id, 4) as bigint) % 50 = 0", "")
_METRICS = ["hit", "recall", "precision", "max_precision", "mrr", "map", "ndcg", "section_diversity"]


@query(f"with {_BM25_ALL}, {_EVIDENCE} select id, " + ", ".join(f'round("{m}", 6) as "{m}"' for m in _METRICS) + " from m")
def ranking_metrics(s, d):
    t, ranked = _ranked(s, d)
    m = evaluate.ranking_metrics(ranked, evaluate.evidence_ids(t), 5)
    return m.select("id", *[r6(c).alias(c) for c in _METRICS])


_SLICED = ["ndcg", "recall", "hit", "precision", "mrr", "map", "max_precision", "section_diversity"]


@query(f"""with {_BM25_ALL}, {_EVIDENCE}, k as (select id, case when len(list_filter(list_transform(evidence.required, lambda x: x.content_type), lambda x: x is not null)) > 0 then 'text' else 'mixed_or_unknown' end as content from e join t using (id)),
s as (select unnest(['all', 'difficulty:' || coalesce(difficulty, 'unknown'), 'content:' || content]) as slice, m.* from m join k using (id)) select slice, count(*) as samples, """ + ", ".join(f'round(avg("{m}"), 6) as "{m}"' for m in _SLICED) + " from s group by slice")
def metric_slices(s, d):
    t, ranked = _ranked(s, d)
    types = F.array_compact(F.transform("evidence.required", lambda x: x["content_type"]))
    content = F.when(F.coalesce(F.size(types), F.lit(0)) > 0, "text").otherwise("mixed_or_unknown")
    m = evaluate.ranking_metrics(ranked, evaluate.evidence_ids(t), 5).join(t.select("id", "difficulty", content.alias("content")), "id")
    out = evaluate.sliced_means(m, [F.lit("all"), F.concat(F.lit("difficulty:"), F.coalesce("difficulty", F.lit("unknown"))), F.concat(F.lit("content:"), "content")], _SLICED)
    return out.select("slice", "samples", *[r6(c).alias(c) for c in _SLICED])


@query("""select distinct id, chunk_id, max(grade)::int as grade from (
  select id, unnest(list_transform(case when coalesce(len(evidence.required), 0) > 0 then list_transform(evidence.required, lambda x: x.chunk_id) else coalesce(ground_truth_chunk_ids, []) end, lambda x: x)) as chunk_id, 3 as grade from tier3_rag
  union all select id, unnest(list_transform(coalesce(evidence.supporting, []), lambda x: x.chunk_id)), 2 from tier3_rag
  union all select id, unnest(list_transform(coalesce(evidence.hard_negative_candidates, []), lambda x: x.chunk_id)), 1 from tier3_rag) where chunk_id is not null group by id, chunk_id""")
def graded_relevance(s, d):
    return evaluate.grades(evaluate.evidence_ids(table(s, d, "tier3_rag")))


_COMMON_RULES = """case when {q} is null then 'missing question' end, case when version is null then 'missing version' end, case when tier is null then 'missing tier' end, case when category is null then 'missing category' end,
  case when expected_behavior is null then 'missing expected_behavior' end, case when difficulty is null then 'missing difficulty' end, case when split is null then 'missing split' end, case when tags is null then 'missing tags' end, case when provenance is null then 'missing provenance' end,
  case when version is distinct from 'v1' then 'version' end, case when tier is distinct from '{tier}' then 'tier' end,
  case when coalesce(expected_behavior, '') not in ('answer', 'answer_with_citations', 'block', 'chitchat', 'educational_pivot', 'resolve_coreference_then_answer') then 'invalid expected_behavior' end,
  case when coalesce(difficulty, '') not in ('adversarial', 'multi_context', 'reasoning', 'simple') then 'invalid difficulty' end, case when coalesce(split, '') not in ('dev', 'test', 'train') then 'invalid split' end,
  case when tags is null then 'tags must be a list' end, case when coalesce(provenance.source_type, '') not in ('human_seed', 'llm_generated', 'mined_pattern', 'ragas_generated') then 'invalid provenance.source_type' end,
  case when coalesce(provenance.review_status, '') not in ('approved', 'draft', 'rejected') then 'invalid provenance.review_status' end"""
_ROBUST_ERRORS = f"""select id, unnest(list_filter([{_COMMON_RULES.format(q="question", tier="robustness")},
  case when expected_planned_route not in ('chitchat', 'vector', 'web', 'literature', 'future_clinical_db') then 'invalid expected_planned_route' end, case when expected_final_route not in ('chitchat', 'vector', 'web', 'literature', 'future_clinical_db') then 'invalid expected_final_route' end,
  case when expected_behavior = 'block' and coalesce(expected_guardrail_action, '') not in ('crisis_resources', 'safety_refusal') then 'block without action' end,
  case when expected_behavior is distinct from 'block' and expected_guardrail_action is not null then 'action without block' end], lambda x: x is not null)) as error from tier5_robustness"""
_ANCHORS = """case when x is null then 'evidence.{part}[' || i || '] must be an object' when what = 'text' then case when coalesce(x.anchor_text, '') = '' then 'evidence.{part}[' || i || '].anchor_text' end
  else case when len(gold) > 0 and coalesce({test}, {default}) then 'evidence.{part}[' || i || '].chunk_id' end end"""


def _anchor_sql(part: str) -> str:
    other = part == "hard_negative_candidates"
    rule = _ANCHORS.format(part=part, test="list_contains(gold, x.chunk_id)" if other else "not list_contains(gold, x.chunk_id)", default="false" if other else "true")
    return f"""select id, error from (select id, case when x is null and what = 'id' then null else {rule} end as error from (select id, gold, unnest(evidence.{part}) as x, generate_subscripts(evidence.{part}, 1) - 1 as i from r) cross join (values ('text'), ('id')) w(what)) where error is not null"""


_RAG_ERRORS = f"""r as (select *, list_distinct(coalesce(ground_truth_chunk_ids, [])) as gold from tier3_rag),
rag_errors as (select id, unnest(list_filter([{_COMMON_RULES.format(q="user_input", tier="rag")}, 'missing expected_planned_route', 'missing expected_final_route', case when expected_behavior = 'block' then 'block without action' end,
  case when coalesce(len(reference_contexts), 0) = 0 then 'no contexts' end, case when evidence is null then 'no evidence' end, case when evidence is not null and coalesce(len(evidence.required), 0) = 0 then 'evidence.required' end,
  case when evidence is not null and evidence.supporting is null then 'evidence.supporting' end, case when evidence is not null and evidence.hard_negative_candidates is null then 'evidence.hard_negative_candidates' end,
  case when len(gold) > 0 and len(list_filter(list_distinct(list_concat(list_transform(coalesce(evidence.required, []), lambda x: x.chunk_id), list_transform(coalesce(evidence.supporting, []), lambda x: x.chunk_id))), lambda c: c is not null and not list_contains(gold, c))) > 0 then 'evidence outside ground truth' end], lambda x: x is not null)) as error from r
union all {_anchor_sql("required")} union all {_anchor_sql("supporting")} union all {_anchor_sql("hard_negative_candidates")})"""


@query(_ROBUST_ERRORS)
def schema_errors(s, d):
    return evaluate.validation_errors(table(s, d, "tier5_robustness"), "robustness")


@query(f"with {_RAG_ERRORS} select id, error from rag_errors")
def rag_schema_errors(s, d):
    return evaluate.validation_errors(table(s, d, "tier3_rag").withColumnRenamed("user_input", "question"), "rag")


@query(f"""with {_RAG_ERRORS}, a as (select id, tier, category, user_input as question, expected_behavior, tags, provenance.source_type as source, provenance.review_status as review from tier3_rag union all select id, tier, category, question, expected_behavior, tags, provenance.source_type, provenance.review_status from tier5_robustness),
w as (select row_number() over () as k, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(question, '')), '\\s+'), lambda x: x <> '')) as ws from a),
p as (select count(*) as pairs from w x join w y on x.k < y.k and len(x.ws) > 0 and len(y.ws) > 0 and len(list_intersect(x.ws, y.ws)) / (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws))) >= 0.92),
g as (select count(*) as samples, (select count(*) from rag_errors) + (select count(*) from ({_ROBUST_ERRORS})) = 0 as schema_compliance, count(*) filter (tier = 'rag') > 0 and count(*) filter (tier = 'robustness') > 0 as all_tiers_populated,
  count(*) filter (tier = 'guardrail') > 0 and coalesce(avg((expected_behavior = 'block')::int) filter (tier = 'guardrail') between 0.4 and 0.6, false) as tier1_block_ratio, (select pairs from p) / greatest(count(*), 1) <= 0.05 as near_duplicate_rate,
  count(*) filter (source in ('llm_generated', 'ragas_generated') and review = 'draft') = 0 as review_completion, count(*) filter (tier = 'routing') = 0 or count(*) filter (tier = 'routing' and list_contains(tags, 'ambiguous')) > 0 as ambiguous_routing_tagged,
  true as manifest_generated, (select count(*) from (select category from a where tier = 'guardrail' and category in ('harmful_synthesis', 'self_harm_crisis', 'prompt_injection', 'diagnosis_seeking', 'legitimate_sensitive', 'jailbreak_roleplay', 'indirect_harm', 'medical_misinformation', 'dosage_boundary', 'child_emergency', 'professional_impersonation') group by 1 having count(*) >= 4)) = 11 as tier1_category_coverage,
  (select count(*) from (select category from a where tier = 'conversational' and category in ('coreference_resolution', 'fact_recall', 'summary_continuity', 'topic_switching', 'correction_handling', 'progressive_disclosure', 'contradictory_statements', 'clarification_loop') group by 1 having count(*) >= 2)) = 8 as tier4_category_coverage from a)
select *, schema_compliance and all_tiers_populated and tier1_block_ratio and near_duplicate_rate and review_completion and ambiguous_routing_tagged and manifest_generated and tier1_category_coverage and tier4_category_coverage as all_gates from g""")
def quality_gates(s, d):
    rag, robust = table(s, d, "tier3_rag").withColumnRenamed("user_input", "question"), table(s, d, "tier5_robustness")
    cols = ["id", "tier", "category", "question", "expected_behavior", "tags", "provenance"]
    errors = evaluate.validation_errors(rag, "rag").unionByName(evaluate.validation_errors(robust, "robustness"))
    return evaluate.quality_gates(rag.select(*cols).unionByName(robust.select(*cols)), errors, ["rag", "robustness"])


_SETS = r"w as (select id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(user_input, '')), '\s+'), lambda x: x <> ''))) as ws from tier3_rag), c as (select ws, count(*) as n from w where len(ws) > 0 group by ws), cn as (select *, row_number() over (order by ws) as k from c)"


@query(f"""with {_SETS}, l as (select a.k, count(*) as links from cn a join cn b on a.k <> b.k and least(len(a.ws), len(b.ws)) >= 0.92 * greatest(len(a.ws), len(b.ws))
  and len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) >= 0.92 group by a.k)
select w.id, cn.n as class_size, coalesce(links, 0) as links from w join cn on w.ws = cn.ws left join l using (k)""")
def near_duplicate_links(s, d):
    return evaluate.links_per_text(table(s, d, "tier3_rag").select("id", F.col("user_input").alias("text")))


@query()
def context_best_match(s, d):
    t = table(s, d, "tier3_rag")
    contexts = t.select("id", F.posexplode("reference_contexts").alias("place", "text")).where("text is not null")
    cand = t.select("id", F.explode(F.array_distinct("ground_truth_chunk_ids")).alias("chunk_id")).join(table(s, d, "document_chunks").select("chunk_id", "content"), "chunk_id")
    return evaluate.best_context_match(contexts, cand).withColumn("score", r6("score"))


_JT = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({t}, '')), '([a-z0-9]+)', 1), lambda w: length(w) > 2))"


@query(f"""with t as (select id, {_JT.format(t='user_input')} as q, {_JT.format(t='reference')} as a, {_JT.format(t="array_to_string(reference_contexts, ' ')")} as c from tier3_rag),
o as (select *, len(list_intersect(q, a)) as qa, len(list_intersect(a, c)) as ac, len(list_intersect(q, c)) as qc from t)
select id, round(case when qa > 0 then 2.0 * qa / (len(q) + len(a)) else 0 end, 6) as relevance, round(case when len(a) > 0 then ac / len(a) else 0 end, 6) as groundedness, round(case when len(q) > 0 then qc / len(q) else 0 end, 6) as coverage from o""")
def judge_scores(s, d):
    t = table(s, d, "tier3_rag").select("id", X.judge_terms(F.col("user_input")).alias("q"), X.judge_terms(F.col("reference")).alias("a"), X.judge_terms(F.array_join("reference_contexts", " ")).alias("c"))
    q, a, c = F.col("q"), F.col("a"), F.col("c")
    return t.select("id", r6(X.f1(q, a)).alias("relevance"), r6(X.recall(a, c)).alias("groundedness"), r6(X.recall(q, c)).alias("coverage"))


@query("select id from messages where ('0x' || substr(sha256(session_id), 1, 8))::bigint / 4294967295.0 <= 0.2")
def judge_sampling(s, d):
    return metrics.sampled(table(s, d, "messages"), F.col("session_id"), 0.2).select("id")


@query("""with a as (select 'rows_' || coalesce(difficulty, 'none') as metric_name, count(*)::double as metric_value from tier3_rag where split = 'test' group by 1), b as (select 'rows_' || coalesce(difficulty, 'none') as metric_name, count(*)::double as metric_value from tier3_rag where split = 'dev' group by 1)
select coalesce(a.metric_name, b.metric_name) as metric_name, a.metric_value as current, b.metric_value as baseline, a.metric_value - b.metric_value as delta from a full join b on a.metric_name = b.metric_name""")
def baseline_delta(s, d):
    t = table(s, d, "tier3_rag")
    m = lambda split: t.where(F.col("split") == split).groupBy(F.concat(F.lit("rows_"), F.coalesce("difficulty", F.lit("none"))).alias("metric_name")).agg(F.count("*").cast("double").alias("metric_value"))
    return evaluate.deltas(m("test"), m("dev"))


@query("with r as (select event_type, count(*)::double as events, round(avg(value), 6) as mean, max(value) as top from events group by 1) select event_type, metric_name, metric_value from (unpivot r on events, mean, top into name metric_name value metric_value)")
def metric_unpivot(s, d):
    r = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), r6(F.avg("value")).alias("mean"), F.max("value").alias("top"))
    return evaluate.metric_rows(r, ["event_type"])


# Events ------------------------------------------------------------------------------------------------------


@query("select event_type, count(*) as events, round(sum(value), 4) as total, round(avg(value), 6) as mean from events group by 1")
def event_counts(s, d):
    return metrics.counts(table(s, d, "events"), "event_type").select("event_type", "events", F.round("total", 4).alias("total"), r6("mean").alias("mean"))


@query("select user_id, sum((event_type = 'error')::int)::bigint as hits, count(*) as events, round(sum((event_type = 'error')::int) / greatest(count(*), 1), 6) as ratio from events group by 1")
def error_ratio(s, d):
    return metrics.ratio(table(s, d, "events"), F.col("event_type") == "error", "user_id").withColumn("ratio", r6("ratio"))


@query("select event_type, round(avg(value), 6) as mean, median(value) as median, quantile_disc(value, 0.95) as p95 from events group by 1")
def latency_percentiles(s, d):
    return metrics.percentiles(table(s, d, "events"), "event_type", "value").withColumn("mean", r6("mean"))


@query("""with n as (select event_type, value, count(*) over (partition by event_type) as n, row_number() over (partition by event_type order by value) as i from events where value is not null),
p as (select *, 0.95 * (n + 1) as spot, least(greatest(floor(0.95 * (n + 1)), 1), n - 1) as lo from n)
select event_type, round(case when max(n) < 20 then max(value) else max(value) filter (i = lo) + (max(value) filter (i = lo + 1) - max(value) filter (i = lo)) * (max(spot) - max(lo)) end, 6) as p95 from p group by 1""")
def exclusive_p95(s, d):
    return evaluate.exclusive_p95(table(s, d, "events"), "event_type", "value").withColumn("p95", r6("p95"))


@query("select time_bucket(interval 5 minute, ts) as window_start, event_type, count(*) as events, round(avg(value), 6) as mean from events group by all")
def windowed_rate(s, d):
    return metrics.rates(table(s, d, "events")).withColumn("mean", r6("mean"))


@query("select time_bucket(interval 1 hour, ts) as window_start, round(avg((event_type = 'error')::int), 6) as share, count(*) as events from events group by 1 having avg((event_type = 'error')::int) > 0.2")
def slo_breach(s, d):
    e = table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.avg((F.col("event_type") == "error").cast("int")).alias("share"), F.count("*").alias("events"))
    return e.where("share > 0.2").select(F.col("w.start").alias("window_start"), r6("share").alias("share"), "events")


# Relational ---------------------------------------------------------------------------------------------------


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(s, d):
    li = table(s, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


@query("""select n_name, round(sum(o_totalprice), 2) as total, count(*) as orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1""")
def nation_orders(s, d):
    j = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("orders"))
