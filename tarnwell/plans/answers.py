"""Queries from result lists to answers, over article lines, memory, dataset checks and replies of judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.functions import articles as A
from tarnwell.functions import text as X
from tarnwell.operators import align, chunking, context, evaluate, memory, metrics, search
from tarnwell.plans.registry import _CHUNK_DENSE, _FACTS, _JT, _NUMBERED, _numbered, _pages, query, r6
from tarnwell.sources import files
from tarnwell.sources.tables import table
from tarnwell.streaming import live

# Scans --------------------------------------------------------------------------------------------------------


@query("select id, split from tier3_rag where (split is null or split = 'test') and trim(coalesce(user_input, '')) <> '' and coalesce(len(reference_contexts), 0) > 0")
def strict_split_scan(s, d):
    t = table(s, d, "tier3_rag")
    return t.where((F.col("split").isNull() | (F.col("split") == "test")) & (F.trim(F.coalesce("user_input", F.lit(""))) != "") & (F.coalesce(F.size("reference_contexts"), F.lit(0)) > 0)).select("id", "split")


@query("select doc_id, length(trim(text)) as chars from documents where length(trim(text)) > 120")
def article_filter(s, d):
    return table(s, d, "documents").where(F.length(F.trim("text")) > 120).select("doc_id", F.length(F.trim("text")).cast("long").alias("chars"))


@query(r"""with p as (select doc_id as id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '')[1:3] as parts from documents where text is not null)
select id, unnest(generate_series(1, len(parts))) as place, left(unnest(parts), 2000) as text from p""")
def api_texts(s, d):
    return files.api_texts(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), 3).withColumn("place", F.col("place").cast("long"))


@query("""with old as (select chunk_id, doc_id, section, 'old' as version from document_chunks), new as (select chunk_id, 'moved' as doc_id, upper(section) as section, 'new' as version from document_chunks where metadata_json.is_table
  union all select 'new-' || chunk_id, 'moved', section, 'new' from document_chunks where metadata_json.is_table)
select coalesce(n.chunk_id, o.chunk_id) as chunk_id, coalesce(o.doc_id, n.doc_id) as doc_id, case when n.chunk_id is null then o.section else n.section end as section, coalesce(n.version, o.version) as version from old o full join new n on o.chunk_id = n.chunk_id""")
def single_upsert(s, d):
    c = table(s, d, "document_chunks")
    t = c.where("metadata_json.is_table")
    new = t.select("chunk_id", F.upper("section").alias("section")).unionByName(t.select(F.concat(F.lit("new-"), "chunk_id").alias("chunk_id"), "section"))
    old = c.select("chunk_id", "doc_id", "section", F.lit("old").alias("version"))
    return memory.updated(old.withColumnRenamed("version", "v"), new.select("chunk_id", F.lit("moved").alias("doc_id"), "section", F.lit("new").alias("v")), "chunk_id", ["doc_id"]).withColumnRenamed("v", "version")


@query("select count(*) as rows, count(content) as parsed, count(*) filter (trim(coalesce(content, '')) <> '') as chunked, count(embedding) as embedded from document_chunks")
def ingest_counts(s, d):
    return table(s, d, "document_chunks").agg(F.count("*").alias("rows"), F.count("content").alias("parsed"), F.count(F.when(F.trim("content") != "", 1)).alias("chunked"), F.count("embedding").alias("embedded"))


# Predicates and scalar functions --------------------------------------------------------------------------------


@query(r"""with t as (select chunk_id, trim(regexp_replace(split_part(content, chr(10), 1), '\s+', ' ', 'g')) as h from document_chunks where content is not null)
select chunk_id, h <> '' and (length(h) > 150 or regexp_matches(h, '[.;]$') or regexp_matches(lower(h), '^(warning|note|caution|important|tip|example|dosage note) ?:')) as fake from t""")
def fake_headings(s, d):
    return table(s, d, "document_chunks").where("content is not null").select("chunk_id", X.is_fake_heading(F.substring_index("content", "\n", 1)).alias("fake"))


_STANDARD = ", ".join(f"'{h}'" for h in A.STANDARD_HEADINGS)


@query(rf"""with l as (select chunk_id, list_filter(list_transform(regexp_split_to_array(replace(content, chr(12), chr(10)), '\r\n|[\n\r]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as lines from document_chunks where content is not null),
u as (select chunk_id, generate_subscripts(lines, 1) as n, unnest(lines) as x from l),
t as (select *, x not in ({_STANDARD}) and not regexp_matches(x, '^[0-9]+$') and not starts_with(x, 'GALE ENCYCLOPEDIA OF MEDICINE') and length(x) <= 90 and length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) > 0
  and (length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) / greatest(length(regexp_replace(x, '[^\p{{L}}]', '', 'g')), 1) > 0.6 or (regexp_matches(x, '^\p{{Lu}}') and not ends_with(x, '.'))) as title from u)
select chunk_id, count(*) as lines, count(*) filter (title) as titles, count(*) filter (x in ({_STANDARD})) as heading_lines from t group by 1""")
def article_lines(s, d):
    c = table(s, d, "document_chunks").where("content is not null").select("chunk_id", F.explode(A.clean_lines(F.col("content"))).alias("x"))
    return c.groupBy("chunk_id").agg(F.count("*").alias("lines"), F.count(F.when(A.is_title(F.col("x")), 1)).alias("titles"), F.count(F.when(A.is_heading(F.col("x")), 1)).alias("heading_lines"))


@query()
def article_parts(s, d):
    c = table(s, d, "document_chunks").where("content is not null").select("chunk_id", "section", A.clean_lines(F.col("content")).alias("lines"))
    return c.select("chunk_id", A.start_title(F.col("lines")).alias("start_title"), A.footer_title(F.col("lines")).alias("footer_title"), A.headings(F.col("lines")).alias("headings"), A.body_text(F.col("lines"), F.col("section")).alias("body"))


@query("select '/api/session/{id}/messages' as path, count(*) as requests from messages where session_id is not null and session_id <> '' and not contains(session_id, '/') having count(*) > 0")
def request_paths(s, d):
    m = table(s, d, "messages").where("session_id is not null and session_id <> '' and not contains(session_id, '/')")
    return m.groupBy(X.path_template(F.concat(F.lit("/api/session/"), "session_id", F.lit("/messages"))).alias("path")).agg(F.count("*").alias("requests"))


@query("""select chunk_id, md5(case when coalesce(section, '') <> '' and section <> 'Document' then section || chr(10) else '' end || content) as plain,
  md5('[Context: ' || doc_id || ']' || chr(10) || case when coalesce(section, '') <> '' and section <> 'Document' then section || chr(10) else '' end || content) as enriched from document_chunks
where content is not null and coalesce(doc_id, '') <> '' and coalesce(metadata_json.content_type, '') <> 'parent'""")
def embedding_texts(s, d):
    c = table(s, d, "document_chunks").where("content is not null and coalesce(doc_id, '') <> '' and coalesce(metadata_json.content_type, '') <> 'parent'")
    prefix, none = X.embedding_prefix(F.col("section")), F.lit(None).cast("string")
    return c.select("chunk_id", F.md5(X.embedding_text(none, prefix, F.col("content"))).alias("plain"), F.md5(X.embedding_text(none, prefix, F.col("content"), F.col("doc_id"))).alias("enriched"))


@query("""select id, round(case when len(tags) > 0 then len(list_filter(tags, lambda k: contains(lower(coalesce(reference, '')), lower(k)))) / len(tags) else 0 end, 6) as keyword_recall,
  round(len(list_intersect(q, a)) / greatest(len(q), 1), 6) as overlap_ratio, round(case when len(w) > 0 then len(list_intersect(v, w)) / len(w) else 0 end, 6) as lexical_overlap from (
  select *, list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(user_input, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) as q, list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(reference, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) as a,
  list_distinct(list_filter(regexp_split_to_array(lower(coalesce(user_input, '')), '\\s+'), lambda x: length(x) > 2)) as v, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(reference, '')), '\\s+'), lambda x: length(x) > 2)) as w from tier3_rag)""".replace("\\\\s", "\\s"))
def lexical_scores(s, d):
    t = table(s, d, "tier3_rag")
    q, a = F.col("user_input"), F.col("reference")
    return t.select("id", r6(X.keyword_recall(a, F.col("tags"))).alias("keyword_recall"), r6(X.overlap_ratio(X.topic_terms(q), X.topic_terms(a))).alias("overlap_ratio"), r6(X.lexical_overlap(q, a)).alias("lexical_overlap"))


@query("select id, len(list_distinct(list_concat(coalesce(tags, []), coalesce(ground_truth_chunk_ids, []))))::int as merged, coalesce(tags[1], ground_truth_chunk_ids[1]) as first from tier3_rag where len(list_filter(coalesce(tags, []), lambda x: x is null)) = 0")
def merged_lists(s, d):
    t = table(s, d, "tier3_rag").where(~F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda x: x.isNull()))
    m = X.order_kept(F.col("tags"), F.col("ground_truth_chunk_ids"))
    return t.select("id", F.size(m).alias("merged"), F.get(m, F.lit(0)).alias("first"))


@query("select id, len(list_filter(coalesce(reference_contexts, []), lambda x: trim(x) <> ''))::int as contexts, case when len(list_filter(coalesce(reference_contexts, []), lambda x: trim(x) <> '')) > 0 then 'contexts' when len(list_filter(coalesce(tags, []), lambda x: trim(x) <> '')) > 0 then 'tags' else 'none' end as source from tier3_rag")
def extracted_contexts(s, d):
    t = table(s, d, "tier3_rag")
    own, any_ = X.contexts_of(F.col("reference_contexts")), X.contexts_of(F.col("reference_contexts"), F.col("tags"))
    return t.select("id", F.size(own).alias("contexts"), F.when(F.size(own) > 0, "contexts").when(F.size(any_) > 0, "tags").otherwise("none").alias("source"))


@query("""select event_id, case when event_type = 'error' then 'hallucination' when event_type = 'view' then 'irrelevant' when event_type = 'click' then 'unsafe' else 'none' end as failure_category,
  case when event_type = 'signup' then 0 else least(value / 100, 1.0) end as confidence, 1.0::double as grounding_score from events""")
def judgements(s, d):
    flags = {"error": '"has_hallucinations": "Yes", "is_relevant": false', "view": '"is_relevant": "no"', "click": '"failure_category": " Unsafe "', "signup": '"failure_category": "odd"', "purchase": '"is_relevant": 1'}
    part = F.create_map(*[F.lit(x) for kv in flags.items() for x in kv])[F.col("event_type")]
    number = F.when(F.col("event_type") == "signup", F.lit('"none"')).otherwise((F.col("value") / 100).cast("string"))
    raw = F.concat(F.lit("Here: {"), part, F.lit(', "confidence": '), number, F.lit("} as asked"))
    e = table(s, d, "events").select("event_id", X.judgement(raw).alias("j"))
    return e.select("event_id", "j.failure_category", "j.confidence", "j.grounding_score")


@query("select event_id, 2 as parsed, 'e' || event_id as first from events")
def fenced_arrays(s, d):
    e = table(s, d, "events")
    raw = F.concat(F.lit('```json\n[{"question": "e'), F.col("event_id").cast("string"), F.lit('"}, {"question": "x"}]\n```'))
    return e.select("event_id", X.json_array(raw, "struct<question:string>").alias("a")).select("event_id", F.size("a").alias("parsed"), F.get("a", F.lit(0))["question"].alias("first"))


@query(f"""select id, length(content) + case when expected = 'hallucination' then {len(X.CAVEATS["hallucination"])} when expected = 'unsafe' then {len(X.CAVEATS["unsafe"])} else 0 end as chars from
  (select id, coalesce(ground_truth, '') as content, case expected_behavior when 'block' then 'unsafe' when 'educational_pivot' then 'hallucination' else 'none' end as expected from tier5_robustness)""")
def caveats(s, d):
    t = table(s, d, "tier5_robustness")
    failure = F.when(F.col("expected_behavior") == "block", "unsafe").when(F.col("expected_behavior") == "educational_pivot", "hallucination").otherwise("none")
    once = X.with_caveat(F.coalesce("ground_truth", F.lit("")), failure)
    return t.select("id", F.length(X.with_caveat(once, failure)).cast("long").alias("chars"))


@query("select doc_id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S') || case when strftime(ingested_at, '%f') = '000000' then '' else '.' || strftime(ingested_at, '%f') end as iso from documents where ingested_at is not null")
def iso_times(s, d):
    return table(s, d, "documents").where("ingested_at is not null").select("doc_id", X.iso_time(F.col("ingested_at")).alias("iso"))


@query("select id, 'User asked: ' || left(user_input, 200) || chr(10) || 'Key facts mentioned: ' || coalesce(list_reduce(list_transform(tags, lambda t: 'tag=' || t), lambda a, b: a || ', ' || b), '') || chr(10) || 'Answer summary: ' || left(reference, 300) as summary from tier3_rag where user_input is not null and reference is not null and len(tags) > 0")
def turn_summaries(s, d):
    t = table(s, d, "tier3_rag").where("user_input is not null and reference is not null and size(tags) > 0")
    facts = F.transform("tags", lambda x: F.struct(F.lit("tag").alias("key"), x.alias("value")))
    return t.select("id", X.turn_summary(F.col("user_input"), facts, F.col("reference")).alias("summary"))


@query("select difficulty as run_id, case when difficulty = 'simple' then 'pipeline' else 'workflow' end as mode, count(*) as sample_count, case when difficulty = 'simple' then 'abc' else 'unknown' end as git_sha from tier3_rag where difficulty is not null group by 1")
def run_records(s, d):
    g = table(s, d, "tier3_rag").where("difficulty is not null").groupBy(F.col("difficulty").alias("run_id")).agg(F.count("*").cast("string").alias("n"))
    simple = F.concat(F.lit('{"mode": " pipeline ", "sample_count": '), "n", F.lit(', "snapshot_meta": {"git_commit": "abc"}}'))
    report = F.when(F.col("run_id") == "simple", simple).otherwise(F.concat(F.lit('{"case_count": '), "n", F.lit("}")))
    return evaluate.run_record(g.select("run_id", F.lit("workflow").alias("eval_type"), report.alias("report"))).drop("eval_type", "judge_model")


# Context of an answer -------------------------------------------------------------------------------------------


def _ranked_chunks(s, d):
    n = _numbered(s, d)
    tags = chunking.position_tags(n, ["doc_id", "section"], ["chunk_index"])
    return tags.select(F.col("doc_id").alias("qid"), F.col("chunk_index").alias("rank"), "chunk_id", "chunk_position", "section", "page", "content", F.col("doc_id"))


_PLACED = f"""{_NUMBERED}, t as (select *, case when row_number() over s = 1 then 'intro' when lead(1) over s is null then 'conclusion' else 'body' end as pos from n window s as (partition by doc_id, section order by chunk_index)),
p as (select *, row_number() over (partition by doc_id order by case pos when 'intro' then 0 when 'body' then 1 else 2 end, chunk_index) as place from t)"""


@query(f"with {_PLACED} select chunk_id, place from p")
def position_sort(s, d):
    return context.by_position(_ranked_chunks(s, d)).select("chunk_id", F.col("place").cast("long").alias("place"))


_BLOCKS = rf"""{_PLACED}, h as (select *, case when coalesce(section, '') <> '' then section else 'Retrieved evidence' end as header, '<chunk>' || chr(10) || regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') || chr(10) || '</chunk>' as part from p),
b as (select doc_id, header, min(place) as first, count(*) as chunks, '### ' || header || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) order by place) as text from h group by 1, 2),
bn as (select *, row_number() over (partition by doc_id order by first) as block from b)"""


def _blocks(s, d):
    p = context.by_position(_ranked_chunks(s, d))
    none = F.lit(None).cast("string")
    return context.blocks(p.select("qid", "place", none.alias("context_key"), F.col("section").alias("header"), none.alias("summary"), none.alias("parent"), "content"))


@query(f"with {_BLOCKS} select doc_id as qid, block, header, md5(text) as digest from bn")
def context_blocks(s, d):
    return _blocks(s, d).select("qid", F.col("block").cast("long").alias("block"), "header", F.md5("text").alias("digest"))


@query(rf"with {_BLOCKS}, r as (select doc_id, block, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) over (partition by doc_id order by block) + 300 as tokens from bn) select doc_id as qid, block, tokens::bigint as tokens from r where tokens <= 2000")
def token_budget(s, d):
    return context.within_tokens(_blocks(s, d), 2000, 300).select("qid", F.col("block").cast("long").alias("block"), F.col("tokens").cast("long").alias("tokens"))


@query(rf"""with {_NUMBERED}, p as (select doc_id, chunk_index, '[Chunk ' || chunk_index || ' — ' || coalesce(section, 'unknown') || ']' || chr(10) || regexp_replace(left(coalesce(content, ''), 800), '^\s+|\s+$', '', 'g') as part from n where chunk_index <= 5),
r as (select *, sum(length(part)) over (partition by doc_id order by chunk_index) as total from p) select doc_id as qid, md5(string_agg(part, chr(10) || chr(10) order by chunk_index)) as digest from r where total <= 2500 group by 1""")
def character_budget(s, d):
    return context.snippets(_ranked_chunks(s, d), limit=2500).select("qid", F.md5("context").alias("digest"))


@query(f"""with {_NUMBERED}, f as (select doc_id, section, page, min(chunk_index) as first_at from n where coalesce(section, '') <> '' group by all) select doc_id as qid, section, page, row_number() over (partition by doc_id order by first_at) as place from f""")
def citations(s, d):
    return context.citations(_ranked_chunks(s, d)).select("qid", "section", "page", F.col("place").cast("long").alias("place"))


@query(f"""with {_NUMBERED} select doc_id as qid, string_agg('[Source: ' || coalesce(nullif(doc_id, ''), 'medical_source') || ', Page ' || coalesce(page::varchar, 'None') || ', Section: ' || coalesce(section, 'None') || ']', chr(10) order by chunk_index) as text from n where chunk_index <= 5 group by 1""")
def citation_text(s, d):
    return context.citation_lines(_ranked_chunks(s, d).withColumn("source", F.lit(None).cast("string")))


# Searches ---------------------------------------------------------------------------------------------------------


@query(f"""with {_CHUNK_DENSE}, u as (select id from document_chunks where id not in (select id from v) order by id limit 6), z as (select id as qid from v where id % 50 = 0),
a as (select qid, id, sim from dense where rank <= 5 union all select qid, id, 0.0 from z cross join u)
select qid, id, round(sim, 6) as sim from (select *, row_number() over (partition by qid order by round(sim, 9) desc, id) as r from a) where r <= 5""")
def dense_with_nulls(s, d):
    c = table(s, d, "document_chunks").select("id", "embedding")
    return search.dense_topk_with_nulls(c.where("id % 50 = 0").withColumnRenamed("id", "qid"), c, 5, 64).select("qid", "id", r6("sim").alias("sim"))


@query(f"""with {_CHUNK_DENSE}, w as (select id, doc_id from document_chunks) select qid, id, round(sim, 6) as sim, r as rank from (
  select q.id as qid, c.id, list_cosine_similarity(q.e, c.e) as sim, row_number() over (partition by q.id order by round(list_cosine_similarity(q.e, c.e), 9) desc, c.id) as r
  from v q join w x on q.id = x.id join w y on x.doc_id = y.doc_id join v c on c.id = y.id where q.id % 50 = 0 and q.id <> c.id) where r <= 3""")
def episodic_memory(s, d):
    c = table(s, d, "document_chunks").where(search.finite_vector(F.col("embedding"), 64)).select("id", F.col("doc_id").alias("user_id"), "embedding")
    return search.episodic_topk(c.where("id % 50 = 0").withColumnRenamed("id", "qid"), c, 3).select("qid", "id", r6("sim").alias("sim"), F.col("rank").cast("long").alias("rank"))


_WINDOWS = f"""{_NUMBERED}, pages as (select doc_id, page // 5 as win, min(page) as page_start, max(page) as page_end, list(chunk_id) filter (is_table) as ids from n where page is not null group by all),
named as (select distinct p.doc_id, p.win, n.chunk_id from (select doc_id, win, unnest(ids) as chunk_id from pages) p join n using (chunk_id)),
cand as (select doc_id, win, chunk_id, true as aligned from named union all select p.doc_id, p.win, n.chunk_id, false from pages p join n on n.doc_id = p.doc_id and n.page between p.page_start and p.page_end where not exists (select 1 from named x where x.doc_id = p.doc_id and x.win = p.win))"""


@query(f'with {_WINDOWS} select doc_id, win::bigint as "window", chunk_id, aligned from cand')
def window_candidates(s, d):
    n = _numbered(s, d).where("page is not null")
    w = n.groupBy("doc_id", F.floor(F.col("page") / 5).alias("window")).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.collect_list(F.when(F.col("is_table"), F.col("chunk_id"))).alias("chunk_ids"))
    return search.candidates_by_window(w, n.select("doc_id", "chunk_id", "page"))


@query("select count(*) as total, count(*) filter (hit) as aligned, count(*) filter (not hit) as unaligned from (select doc_id, page, exists(select 1 from document_chunks c where c.doc_id = p.doc_id and c.page between p.page and p.page + 1 and c.metadata_json.is_table) as hit from (select distinct doc_id, page from document_chunks where doc_id is not null and page is not null) p)")
def alignment_summary(s, d):
    c = table(s, d, "document_chunks").where("doc_id is not null and page is not null")
    tables = c.where("metadata_json.is_table").select("doc_id", F.explode(F.array("page", F.col("page") - 1)).alias("page")).distinct().withColumn("hit", F.lit(1))
    p = c.select("doc_id", "page").distinct().join(tables, ["doc_id", "page"], "left")
    return p.agg(F.count("*").alias("total"), F.count("hit").alias("aligned"), (F.count("*") - F.count("hit")).alias("unaligned"))


# Memory -----------------------------------------------------------------------------------------------------------


@query("select id, row_number() over (partition by session_id order by created_at nulls last, id) as place from messages")
def history_order(s, d):
    return memory.history(table(s, d, "messages")).select("id", F.col("place").cast("long").alias("place"))


@query("select session_id, last_active from sessions order by last_active desc nulls last, session_id limit 20")
def latest_sessions(s, d):
    return memory.latest(table(s, d, "sessions"), 20, "session_id", by="last_active").select("session_id", "last_active")


@query("select event_id, coalesce(event_type, '') as event_type from events order by ts desc nulls last, event_id limit 20")
def recent_runs(s, d):
    return memory.latest(table(s, d, "events"), 20, "event_id", by="ts").select("event_id", F.coalesce("event_type", F.lit("")).alias("event_type"))


@query("select id from (select id, row_number() over (partition by session_id order by created_at desc nulls last, id desc) as r from messages) where r <= 50")
def cache_ring(s, d):
    return live.ring(table(s, d, "messages"), "session_id", 50, F.desc_nulls_last("created_at"), F.desc("id")).select("id")


@query("""select session_id, key, value, confidence from (select session_id, trim(fact_key) as key, trim(fact_value) as value, coalesce(confidence, 1.0) as confidence, row_number() over (partition by session_id, trim(fact_key), trim(fact_value) order by id) as r
  from user_facts where trim(fact_key) <> '' and trim(fact_value) <> '') where r = 1""")
def facts_by_value(s, d):
    f = table(s, d, "user_facts").select("session_id", F.col("fact_key").alias("key"), F.col("fact_value").alias("value"), "confidence", F.col("id").alias("place"))
    return memory.first_facts(f)


@query(f"""with {_FACTS} select distinct session_id, key, value, 1.0::double as confidence from (select session_id, key, max(value) over (partition by session_id, key) as value from merged where key = 'age' union all select session_id, key, value from merged where key in ('allergy', 'condition'))""")
def state_facts(s, d):
    return memory.state_facts(memory.core_state(memory.merged_facts(table(s, d, "user_facts")))).drop("place")


@query(f"""with {_FACTS}, l as (select session_id, string_agg(value, ', ' order by value) filter (key = 'condition') as c, string_agg(value, ', ' order by value) filter (key = 'allergy') as a, max(value) filter (key = 'age') as age from merged group by 1)
select session_id, concat_ws(chr(10), 'Session goal: care', case when coalesce(c, a) is not null then 'Medical context: ' || concat_ws('; ', 'conditions: ' || c, 'allergies: ' || a) end, 'Key findings: ' || age) as text from l""")
def summary_text(s, d):
    st = memory.core_state(memory.merged_facts(table(s, d, "user_facts")))
    found = F.when(F.col("age").isNotNull(), F.array("age")).otherwise(F.array().cast("array<string>"))
    return st.select("session_id", memory.summary_text(F.lit("care"), {"conditions": F.col("conditions"), "allergies": F.col("allergies")}, found, F.array().cast("array<string>")).alias("text"))


@query("""select session_id as qid, '**Relevant past context from prior sessions:**' || chr(10) || string_agg('- ' || coalesce('[' || strftime(created_at, '%b %d') || '] ', '') || content, chr(10) order by r) as text from
  (select session_id, created_at, coalesce(content, '') as content, row_number() over (partition by session_id order by created_at desc nulls last, id desc) as r from messages where session_id is not null) where r <= 3 group by 1""")
def episodes_text(s, d):
    m = memory.recent_turns(table(s, d, "messages").where("session_id is not null"), 3)
    return memory.episodes_text(m.select(F.col("session_id").alias("qid"), "rank", F.coalesce("content", F.lit("")).alias("summary"), "created_at"))


@query("select id from user_facts where coalesce(confidence, 0.7) >= 0.6 and trim(fact_key) <> '' and trim(fact_value) <> ''")
def storable_facts(s, d):
    f = table(s, d, "user_facts").select("id", F.col("fact_key").alias("key"), F.col("fact_value").alias("value"), "confidence")
    return memory.storable_facts(f).select("id")


# Dataset checks and scores ------------------------------------------------------------------------------------------


@query("select 'T3-' || lpad((top + row_number() over (order by id))::varchar, greatest(4, length((top + row_number() over (order by id))::varchar))::int, '0') as new_id, id from tier5_robustness cross join (select coalesce(max(try_cast(regexp_extract(id, '^T3-(\\d+)$', 1) as bigint)), 0) as top from tier3_rag)".replace("\\\\d", "\\d"))
def next_ids(s, d):
    return evaluate.next_ids(table(s, d, "tier5_robustness").select("id"), table(s, d, "tier3_rag"), "T3-", "id").select("new_id", "id")


@query()
def accepted_questions(s, d):
    new, old = table(s, d, "tier5_robustness").select("id", F.col("question").alias("text")), table(s, d, "tier3_rag").select(F.col("user_input").alias("text"))
    return evaluate.accepted(new, old).select("id")


@query("select round(avg(confidence) filter (not isnan(confidence)), 6) as confidence, count(confidence) filter (not isnan(confidence)) as confidence_scored_count from user_facts")
def scored_means(s, d):
    return evaluate.scored_means(table(s, d, "user_facts"), ["confidence"]).withColumn("confidence", r6("confidence"))


@query(f"""with t as (select id, reference_contexts as ctx, {_JT.format(t='user_input')} as q, {_JT.format(t='reference')} as a, {_JT.format(t="array_to_string(reference_contexts, ' ')")} as c from tier3_rag),
o as (select *, len(list_intersect(q, a)) as qa, len(list_intersect(a, c)) as ac, len(list_intersect(q, c)) as qc, len(list_filter(list_transform(ctx, lambda x: len(list_intersect({_JT.format(t='x')}, list_concat(q, a))) > 0), lambda x: x)) as hits from t)
select id, round(case when qa > 0 then 2.0 * qa / (len(q) + len(a)) else 0 end, 6) as answer_relevance, round(case when len(a) > 0 then ac / len(a) else 0 end, 6) as groundedness, round(case when coalesce(len(ctx), 0) > 0 then hits / len(ctx) else 0 end, 6) as context_precision, round(case when len(q) > 0 then qc / len(q) else 0 end, 6) as context_coverage from o""")
def live_judge(s, d):
    p = table(s, d, "tier3_rag").select("id", F.col("user_input").alias("question"), F.col("reference").alias("answer"), F.col("reference_contexts").alias("contexts"))
    return evaluate.judged(p).select("id", *[r6(c).alias(c) for c in ("answer_relevance", "groundedness", "context_precision", "context_coverage")])


@query("""with a as (select lower(coalesce(content, '')) as t, coalesce(content, '') as raw from messages where lower(trim(role)) = 'assistant'),
r as (select 100 * avg((length(t) > 20)::int) as success, 100 * avg(regexp_matches(t, 'disease|symptoms|treatment|diagnosis|medication|condition|patient|doctor|therapy|chronic|acute')::int) as terms, 100 * avg(regexp_matches(t, 'consult|doctor|professional|physician')::int) as disclaimer,
  100 * avg((not regexp_matches(t, 'i don''t know|i''m not sure'))::int) as complete, 100 * avg(contains(raw, 'Source:')::int) as sourced from a)
select round(success, 6) as success, round(terms, 6) as terms, round(disclaimer, 6) as disclaimer, round(complete, 6) as complete, round(sourced, 6) as sourced, round(0.3 * terms + 0.3 * disclaimer + 0.3 * complete + 0.1 * sourced, 6) as quality from r""")
def answer_rates(s, d):
    a = evaluate.answer_rates(table(s, d, "messages").where("lower(trim(role)) = 'assistant'").select(F.col("content").alias("answer")))
    return a.select(*[r6(c).alias(c) for c in a.columns])


@query("""with c as (select event_type as label, unnest([10.0, 25.0, 50.0, 100.0, 250.0, 'inf'::double]) as le from (select distinct event_type from events)),
b as (select label, le, (select count(*) from events e where e.event_type = c.label and e.value <= c.le) as n from c),
w as (select *, coalesce(lag(le) over p, 0) as lo, coalesce(lag(n) over p, 0) as below, max(n) over (partition by label) as total from b window p as (partition by label order by le)),
f as (select * from (select *, row_number() over (partition by label order by le) as r from w where n >= 0.95 * total) where r = 1)
select label, round(case when isinf(le) then lo else lo + (le - lo) * (0.95 * total - below) / greatest(n - below, 1) end, 6) as quantile from f""")
def histogram_p95(s, d):
    b = metrics.bucketed(table(s, d, "events"), "event_type", "value", [10.0, 25.0, 50.0, 100.0, 250.0])
    return metrics.histogram_quantile(b, 0.95).withColumn("quantile", r6("quantile"))


@query()
def table_payloads(s, d):
    c = table(s, d, "document_chunks").where("content is not null")
    none = F.lit(None).cast("string")
    return chunking.table_payloads(c.select(F.col("chunk_id").alias("id"), F.col("content").alias("markdown"), none.alias("html"), F.col("content").alias("text"), "section", none.alias("caption"))).select("id", "quality", "source", F.md5("embedded").alias("digest"))


@query()
def section_headings(s, d):
    n = _numbered(s, d)
    head = n.withColumns({"element_index": F.col("chunk_index"), "element_type": F.when(F.col("is_table"), "heading").otherwise("text"), "text": F.col("section")}).drop("section")
    return chunking.sections(head).select("chunk_id", "section_no", "section")


@query()
def aligned_articles(s, d):
    w = align.windows(_pages(s, d))
    return w.join(align.aligned(w, table(s, d, "document_chunks")).groupBy("doc_id", "window").agg(F.count("*").alias("chunks")), ["doc_id", "window"], "left").select("doc_id", "window", F.coalesce("chunks", F.lit(0)).alias("chunks"))
