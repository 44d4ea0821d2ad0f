"""From result lists to the text that answers are made of: order, blocks, budgets and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions.text import token_count
from tarnwell.operators.search import topk

PROMPT_TOKENS = 14_800
SNIPPETS, SNIPPET_CHARS, CONTEXT_CHARS = 5, 800, 4_000


def position_key(position: Column) -> Column:
    """0 for intro, 1 for body or nothing, 2 for the rest."""
    p = F.coalesce(position, F.lit("body"))
    return F.when(p == "intro", 0).when(p == "body", 1).otherwise(2)


def by_position(ranked: DataFrame) -> DataFrame:
    """``ranked(qid, rank, chunk_position, ..)`` with ``place``: introductions first, conclusions last, else by rank."""
    return ranked.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(position_key(F.col("chunk_position")), "rank")))


def blocks(placed: DataFrame) -> DataFrame:
    """qid, block, header, text: the chunks of a result list grouped under their headers.

    ``placed(qid, place, context_key, header, summary, parent, content)``. Groups stand where their first chunk does; the
    parent's text replaces the chunk's, a summary goes before it. Result lists are as small as the search's k.
    """
    header = F.coalesce(F.nullif("header", F.lit("")), F.lit("Retrieved evidence"))
    shown = F.coalesce(F.nullif("parent", F.lit("")), F.coalesce("content", F.lit("")))
    part = F.concat_ws("\n", F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("[Context: "), "summary", F.lit("]"))), F.concat(F.lit("<chunk>\n"), F.regexp_replace(shown, r"^\s+|\s+$", ""), F.lit("\n</chunk>")))
    p = placed.select("qid", "place", header.alias("header"), F.coalesce(F.nullif("context_key", F.lit("")), header).alias("key"), part.alias("part"))
    g = p.groupBy("qid", "key").agg(F.min("place").alias("first"), F.min_by("header", "place").alias("header"), F.sort_array(F.collect_list(F.struct("place", "part"))).alias("parts"))
    text = F.concat_ws("\n\n", F.concat(F.lit("### "), F.col("header")), F.transform("parts", lambda x: x["part"]))
    return g.select("qid", F.row_number().over(W.partitionBy("qid").orderBy("first")).alias("block"), "header", text.alias("text"))


def within_tokens(parts: DataFrame, limit: int = PROMPT_TOKENS, fixed: int = 0) -> DataFrame:
    """The first rows of ``parts(qid, block, text)`` whose words, with ``fixed`` ones around them, stay within the limit.

    The first row that goes over it ends the list, also if a later one would fit.
    """
    running = F.sum(token_count(F.col("text"))).over(W.partitionBy("qid").orderBy("block").rowsBetween(W.unboundedPreceding, 0))
    return parts.withColumn("tokens", running + F.lit(fixed)).where(F.col("tokens") <= limit)


def snippets(ranked: DataFrame, n: int = SNIPPETS, chars: int = SNIPPET_CHARS, limit: int = CONTEXT_CHARS) -> DataFrame:
    """qid, context: the first chunks of ``ranked(qid, rank, section, content)``, cut, numbered and within ``limit`` characters.

    Blank lines between them don't count; the first that goes over the limit ends the list.
    """
    cut = F.regexp_replace(F.substring(F.coalesce("content", F.lit("")), 1, chars), r"^\s+|\s+$", "")
    part = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit(" — "), F.coalesce("section", F.lit("unknown")), F.lit("]\n"), cut)
    p = ranked.where(F.col("rank") <= n).select("qid", "rank", part.alias("part"))
    kept = p.withColumn("total", F.sum(F.length("part")).over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))).where(F.col("total") <= limit)
    return kept.groupBy("qid").agg(F.concat_ws("\n\n", F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"])).alias("context"))


def citations(ranked: DataFrame) -> DataFrame:
    """qid, section, page, doc_id, place: each section and page of a result list once, by rank; chunks without a section give none."""
    first = topk(ranked.where(F.coalesce("section", F.lit("")) != "").withColumnRenamed("rank", "at"), ["qid", "section", "page"], 1, F.asc("at")).drop("rank")
    return first.select("qid", "section", "page", "doc_id", F.row_number().over(W.partitionBy("qid").orderBy("at")).alias("place"))


def citation_lines(ranked: DataFrame, n: int = 5) -> DataFrame:
    """qid, text: one line for each of the first n chunks with its source, page and section."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(F.lit("[Source: "), F.coalesce(F.nullif("doc_id", F.lit("")), F.nullif("source", F.lit("")), F.lit("medical_source")), F.lit(", Page "), show("page"), F.lit(", Section: "), show("section"), F.lit("]"))
    return ranked.where(F.col("rank") <= n).groupBy("qid").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])).alias("text"))
