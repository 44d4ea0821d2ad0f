"""The queries of this package, over whole tables, and the SQL that some of them can be compared with."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import conversations, encode, forms, leaks, neighbours, overlap, pairs, pii, scans, splitting
from tarnwell.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages")
    turns = conversations.turns_of(conversations.linked_messages(messages, content=False))
    return conversations.session_verdicts(messages, turns).where("reason is not null").select("session_id")


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_messages(table(spark, d, "messages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_chunks(table(spark, d, "document_chunks")).select("chunk_id", F.col("level").alias("boundary"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_chunks(table(spark, d, "document_chunks")).select("chunk_id", "section", "level", F.inline("pieces"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(table(spark, d, "document_chunks")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise_found(scans.texts_of(table(spark, d, "document_chunks"), table(spark, d, "tier3_rag")))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(scans.texts_of(table(spark, d, "document_chunks"), table(spark, d, "tier3_rag")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs.question_answer_pairs(table(spark, d, "tier3_rag"), table(spark, d, "tier5_robustness"))
    return pairs.defects(rows, table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "tier5_robustness"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "tier5_robustness")
    return overlap.overlap_report(records, overlap.cross_split_pairs(records))


def _surrogate_key(spark: SparkSession) -> str:
    """The session's key of surrogates, one of its own if none is set."""
    name = "spark.tarnwell.surrogateKey"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(16))
    return spark.conf.get(name)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii_found(pii.texts_of(table(spark, d, "messages"), table(spark, d, "user_facts")), _surrogate_key(spark))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(pii.texts_of(table(spark, d, "messages"), table(spark, d, "user_facts")))


def p7_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return pii.with_surrogates(pii.texts_of(table(spark, d, "messages"), table(spark, d, "user_facts")), _surrogate_key(spark))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.same_looking_pairs(table(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return forms.with_form(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "form")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_conversations, p2_found, p2_pieces, p3_found, p4_found, p4_repaired, p5_found, p6_found, p6_report,
        p7_found, p7_redacted, p7_surrogates, p8_ids, p9_found, p10_found, p10_forms,
    )
}


SQL: dict[str, str] = {
    "p1_found": rf"""
with m as (
  select session_id, id, created_at, content,
    case when r in ('user', 'human') then 'user' when r in ('assistant', 'ai', 'bot') then 'assistant' when r in ('system', 'tool') then 'ignored' else 'unknown' end as speaker,
    not coalesce(regexp_matches(content, '[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]'), false) as blank,
    coalesce(regexp_matches(lower(content), '^(\[generation_error: .*\]|\[stream aborted .*\]|\(response could not be generated\)|error \d+: .*|internal error, .*)$'), false) as notice
  from (select *, lower(regexp_replace(coalesce(role, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) as r from messages)
),
timed as (select * from m where created_at is not null and speaker in ('user', 'assistant') and (not blank or speaker = 'assistant')),
numbered as (select *, row_number() over (partition by session_id, speaker, content order by created_at, id) as n from timed where not blank),
recursive_kept as (
  with recursive k as (
    select session_id, speaker, content, n, created_at as kept_at, true as kept, id, created_at, notice from numbered where n = 1
    union all
    select x.session_id, x.speaker, x.content, x.n, case when x.created_at - k.kept_at > interval 10 minute then x.created_at else k.kept_at end,
      x.created_at - k.kept_at > interval 10 minute, x.id, x.created_at, x.notice
    from k join numbered x on x.session_id = k.session_id and x.speaker = k.speaker and x.content = k.content and x.n = k.n + 1
  ) select * from k where kept
),
kept as (
  select session_id, id, created_at, speaker, not notice as answer from recursive_kept
  union all select session_id, id, created_at, speaker, false from timed where blank
),
marked as (select *, case when lag(speaker) over w is distinct from speaker then 1 else 0 end as opens from kept window w as (partition by session_id order by created_at, id)),
turned as (select *, sum(opens) over (partition by session_id order by created_at, id rows unbounded preceding) as turn from marked),
turns as (select session_id, turn, min(speaker) as speaker, bool_or(answer) as answered from turned group by all),
verdict as (
  select session_id, arg_min(speaker, turn) = 'assistant' or arg_max(speaker, turn) = 'user' or bool_or(speaker = 'assistant' and not answered) as bad from turns group by session_id
),
flags as (
  select session_id, bool_or(speaker = 'unknown' and not blank) or bool_or(speaker <> 'ignored' and not blank and created_at is null) as bad from m where session_id is not null group by session_id
)
select f.session_id from flags f left join verdict v using (session_id) where f.bad or v.session_id is null or v.bad
""",
    "p2_found": r"""
with c as (select chunk_id, regexp_replace(content, '^\s+|\s+$', '', 'g') as t from document_chunks where content is not null),
s as (
  select chunk_id,
    list_max(list_transform(regexp_split_to_array(t, '[^\S\n]*\n[^\S\n]*\n\s*'), lambda x: length(trim(x)))) as paragraph,
    list_max(list_transform(regexp_split_to_array(t, '\n'), lambda x: length(trim(x, E' \t\r\u00a0')))) as line,
    list_max(list_transform(regexp_split_to_array(regexp_replace(t, '([.!?])\s+', E'\\1\n', 'g'), '\n'), lambda x: length(trim(x, E' \t\r\u00a0')))) as sentence,
    list_max(list_transform(regexp_split_to_array(t, '\s+'), lambda x: length(x))) as word
  from c where length(t) > 1800
)
select chunk_id, case when paragraph <= 1800 then 'paragraph' when line <= 1800 then 'line' when sentence <= 1800 then 'sentence' when word <= 1800 then 'word' else 'none' end as boundary from s
""",
    "p3_found": r"""
with v as (
  select id, embedding::double[] as e from document_chunks
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
r as (
  select a.id as a, b.id as b, row_number() over (partition by a.id order by round(list_cosine_similarity(a.e, b.e), 12) desc, b.id) as n
  from v a join v b on a.id <> b.id
)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from r where n <= 5
""",
}
