"""Article windows over pages and their alignment with chunks by page range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions.text import topic_terms
from tarnwell.operators.search import topk


def normal_heading(c: Column) -> Column:
    """Lower case with single blanks for all but letters and digits of ASCII; null for null, or if nothing is left."""
    t = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.when(t != "", t)


def windows(pages: DataFrame) -> DataFrame:
    """Runs of adjacent pages with one title: doc_id, window, title, page_start, page_end, body, headings.

    ``pages(doc_id, page, title, body, headings)``, headings (array of string) may be left out; a page without a title takes
    over the last one, one with neither body nor headings is left out and breaks the run.
    """
    w = W.partitionBy("doc_id").orderBy("page")
    p = pages.withColumn("title", F.last("title", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("title").isNotNull() & ((F.coalesce("body", F.lit("")) != "") | (F.coalesce(F.size("headings"), F.lit(0)) > 0 if "headings" in pages.columns else F.lit(False))))
    same = F.coalesce((F.lag("title").over(w) == F.col("title")) & (F.lag("page").over(w) == F.col("page") - 1), F.lit(False))
    p = p.withColumn("window", F.sum((~same).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    body = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("page", "body"))), lambda x: F.nullif(x["body"], F.lit(""))))
    headings = [F.array_distinct(F.flatten(F.collect_set("headings"))).alias("headings")] if "headings" in pages.columns else []
    return p.groupBy("doc_id", "window").agg(F.first("title").alias("title"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), body.alias("body"), *headings)


def aligned(wins: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """doc_id, window, chunk_id, score, rank: the k best chunks on or next to the pages of each window.

    Score: 6 on a page of the window, 2 next to it; 3 more for a section that is one of the window's headings, 2 for a
    word of the title, 1 for two words of the body. Windows without headings give none of the 3.
    The pages of a window are exploded without its text, so the range join is an equality join that spreads over the
    pages; texts are joined to the pairs by id.
    """
    headings = F.transform("headings", normal_heading) if "headings" in wins.columns else F.array().cast("array<string>")
    pages = wins.select("doc_id", "window", F.explode(F.sequence(F.col("page_start") - 1, F.col("page_end") + 1)).alias("page"))
    ids = pages.join(chunks.select("doc_id", "page", "chunk_id"), ["doc_id", "page"])
    w = wins.select("doc_id", "window", "page_start", "page_end", headings.alias("h"), topic_terms(F.col("title")).alias("t"), topic_terms(F.col("body")).alias("b"))
    c = chunks.select("doc_id", "chunk_id", normal_heading(F.col("section")).alias("s"), topic_terms(F.concat_ws(" ", "content", "section")).alias("c"))
    pair = ids.join(w, ["doc_id", "window"]).join(c, ["doc_id", "chunk_id"])
    on = F.col("page").between(F.col("page_start"), F.col("page_end"))
    score = F.when(on, 6).otherwise(2) + F.when(F.array_contains("h", F.col("s")), 3).otherwise(0) + F.when(F.arrays_overlap("t", "c"), 2).otherwise(0) + F.when(F.size(F.array_intersect("b", "c")) >= 2, 1).otherwise(0)
    return topk(pair.select("doc_id", "window", "chunk_id", "page", score.alias("score")), ["doc_id", "window"], k, F.desc("score"), F.asc("page"), F.asc("chunk_id"))
