"""Sessions, history, facts and summaries: ordered reads and upserts with stated precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.text import preview
from tarnwell.operators.search import topk


def previews(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, created_at, last_active, preview: the start of the earliest user message, null without one."""
    user = messages.where(F.lower(F.trim("role")) == "user").groupBy("session_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("first_text"))
    return sessions.join(user, "session_id", "left").select("session_id", "created_at", "last_active", preview(F.col("first_text")).alias("preview"))


def recent_turns(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each session with place 1 for the newest; order is time, then id."""
    return topk(messages, "session_id", n, F.desc_nulls_last("created_at"), F.desc("id"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *precedence: Column) -> DataFrame:
    """One row for each key of both tables: the one that comes first by ``precedence``, else the new one.

    ``precedence`` orders the rows of a key; a table's rows are told apart by ``is_new``. Columns are those of ``old``.
    """
    both = old.withColumn("is_new", F.lit(False)).unionByName(new.select(*old.columns).withColumn("is_new", F.lit(True)))
    return topk(both, keys, 1, *precedence, F.desc("is_new")).drop("is_new", "rank")


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Purge and replace: the rows of ``new`` and those of ``old`` whose doc_id and chunk_id don't occur in it."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").join(new.select("chunk_id").distinct(), "chunk_id", "left_anti").select(*new.columns).unionByName(new)


def merged_facts(facts: DataFrame) -> DataFrame:
    """session_id, key, value, confidence: per folded key the surest fact, the later one on a tie.

    Keys and values are trimmed, blank ones dropped; a null confidence counts as 0.
    """
    f = facts.select("session_id", F.lower(F.trim("fact_key")).alias("key"), F.trim("fact_value").alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "created_at", "id")
    f = f.where("key <> '' and value <> '' and session_id is not null")
    return topk(f, ["session_id", "key"], 1, F.desc("confidence"), F.desc("created_at"), F.desc("id")).select("session_id", "key", "value", "confidence")


def core_state(merged: DataFrame) -> DataFrame:
    """session_id, age, allergies, conditions from merged facts."""
    pick = lambda k: F.sort_array(F.collect_set(F.when(F.col("key") == k, F.col("value"))))
    return merged.groupBy("session_id").agg(F.max(F.when(F.col("key") == "age", F.col("value"))).alias("age"), pick("allergy").alias("allergies"), pick("condition").alias("conditions"))


def summary_fields(text: Column) -> Column:
    """struct<goal, findings, questions> of a summary with one labelled line each."""
    line = lambda label: F.trim(F.regexp_extract(text, rf"(?m)^\s*{label}:(.*)$", 1))
    items = lambda c: F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(line("Session goal").alias("goal"), items(line("Key findings")).alias("findings"), items(line("Open questions")).alias("questions"))


def bounded_append(items: Column, new: Column, n: int) -> Column:
    """The last n of an array with one more element; nothing if n isn't positive."""
    if n <= 0:
        return F.slice(items, 1, 0)
    both = F.concat(items, F.array(new))
    return F.slice(both, -F.least(F.lit(n), F.size(both)), n)


def history(messages: DataFrame) -> DataFrame:
    """``messages`` with ``place`` in its session by created_at, then id; rows without a time come last."""
    return topk(messages, "session_id", 1 << 30, F.asc_nulls_last("created_at"), F.asc("id")).withColumnRenamed("rank", "place")


def latest(rows: DataFrame, n: int, *ties: str, by: str = "created_at") -> DataFrame:
    """The n newest rows, sorted; ties by the given columns. Only n rows a task leave it."""
    return rows.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def updated(old: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by ``key``: known keys are overwritten but for the ``kept`` columns, others added.

    Of several new rows of a key the last by column ``version`` counts, if there is one.
    """
    once = topk(new, key, 1, F.desc("version")).drop("rank", "version") if "version" in new.columns else new
    o, n = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != key], F.lit(True).alias("_old")), once.select(key, *[F.col(c).alias(f"_n_{c}") for c in old.columns if c != key], F.lit(True).alias("_new"))
    both = o.join(n, key, "full")
    pick = lambda c: F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & F.lit(c in kept)), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}"))
    return both.select(*[F.col(key) if c == key else pick(c).alias(c) for c in old.columns])


def first_facts(*sources: DataFrame) -> DataFrame:
    """session_id, key, value, confidence: each trimmed (key, value) of a session once, from the first source and place that has it.

    Every source is ``(session_id, key, value, confidence, place)``; blank keys and values are left out, a null confidence is 1.
    """
    both = None
    for n, s in enumerate(sources):
        part = s.select("session_id", F.trim("key").alias("key"), F.trim("value").alias("value"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.lit(n).alias("source"), "place").where("key <> '' and value <> ''")
        both = part if both is None else both.unionByName(part)
    return topk(both, ["session_id", "key", "value"], 1, F.asc("source"), F.asc("place")).select("session_id", "key", "value", "confidence")


def state_facts(state: DataFrame) -> DataFrame:
    """session_id, key, value, confidence 1 of ``core_state`` rows: age, then allergies, then conditions, by place."""
    fact = lambda k: lambda v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    age = F.when(F.coalesce("age", F.lit("")) != "", F.array(F.struct(F.lit("age").alias("key"), F.col("age").alias("value")))).otherwise(F.array())
    all_ = F.concat(age, F.transform("allergies", fact("allergy")), F.transform("conditions", fact("condition")))
    return state.select("session_id", F.posexplode(all_).alias("place", "f")).select("session_id", "f.key", "f.value", F.lit(1.0).alias("confidence"), "place")


def summary_text(goal: Column, context: dict[str, Column], findings: Column, questions: Column, trajectory: Column | None = None) -> Column:
    """The labelled lines of a summary; ``context`` maps a kind of entity to its array. Empty parts are left out."""
    filled = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    line = lambda label, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{label}: "), body))
    entities = F.concat_ws("; ", *[F.when(F.size(filled(c)) > 0, F.concat(F.lit(f"{k}: "), F.array_join(filled(c), ", "))) for k, c in context.items()])
    parts = [line("Session goal", goal), line("Medical context", entities), line("Key findings", F.array_join(filled(findings), "; ")), line("Open questions", F.array_join(filled(questions), "; "))]
    return F.concat_ws("\n", *parts, *([] if trajectory is None else [line("Trajectory", trajectory)]))


def summary_context(text: Column) -> Column:
    """map<kind, array<value>> of the line ``Medical context: kind: a, b; kind: c`` of a summary."""
    line = F.trim(F.regexp_extract(text, r"(?m)^\s*Medical context:(.*)$", 1))
    parts = F.filter(F.split(line, ";"), lambda x: F.contains(x, F.lit(":")))
    entry = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.filter(F.transform(F.split(F.regexp_replace(x, "^[^:]*:", ""), ","), lambda v: F.trim(v)), lambda v: v != "").alias("v"))
    return F.map_from_entries(F.transform(parts, entry))


def episodes_text(episodes: DataFrame) -> DataFrame:
    """qid, text: one dated line for each of ``episodes(qid, rank, summary, created_at)`` under a heading."""
    line = F.concat(F.lit("- "), F.coalesce(F.concat(F.lit("["), F.date_format("created_at", "MMM dd"), F.lit("] ")), F.lit("")), "summary")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return episodes.groupBy("qid").agg(F.concat(F.lit("**Relevant past context from prior sessions:**\n"), F.array_join(lines, "\n")).alias("text"))


def storable_facts(facts: DataFrame, least: float = 0.6) -> DataFrame:
    """Facts sure enough to keep, with a key and a value; a null confidence counts as 0.7."""
    return facts.where((F.coalesce("confidence", F.lit(0.7)) >= least) & (F.trim("key") != "") & (F.trim("value") != ""))
