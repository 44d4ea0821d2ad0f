"""One object over the tables of a chat store: sessions, history, deletion, and the slots for models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import chunking, memory, search
from tarnwell.sources.tables import table

#: Tables that belong to a session and go with it; long-term memory stays.
SESSION_TABLES = ("messages", "summaries", "user_facts", "sessions")


@dataclass
class Engine:
    """``tables`` maps names to DataFrames. ``embed`` maps a series of texts to a series of vectors, ``rerank`` and
    ``judge`` map DataFrames to DataFrames; each may be left out."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    embed: Callable[[pd.Series], pd.Series] | None = None
    rerank: Callable[[DataFrame], DataFrame] = search.reranked
    judge: Callable[[DataFrame], DataFrame] | None = None

    @classmethod
    def over(cls, spark: SparkSession, folder: str, names: tuple[str, ...] = ("messages", "sessions", "user_facts", "document_chunks"), **slots) -> Engine:
        return cls(spark, {n: table(spark, folder, n) for n in names}, **slots)

    def history(self, session_id: str) -> DataFrame:
        return self.tables["messages"].where(F.col("session_id") == session_id).orderBy("created_at", "id")

    def sessions(self) -> DataFrame:
        return memory.previews(self.tables["sessions"], self.tables["messages"]).orderBy(F.desc_nulls_last("last_active"), "session_id")

    def delete(self, session_ids: DataFrame) -> Engine:
        """The engine without the sessions of ``session_ids(session_id)`` and all that belongs to them."""
        kept = {n: t.join(session_ids.select("session_id").distinct(), "session_id", "left_anti") if n in SESSION_TABLES else t for n, t in self.tables.items()}
        return Engine(self.spark, kept, self.embed, self.rerank, self.judge)

    def embedded(self, texts: DataFrame, text_col: str = "text", dim: int | None = None) -> DataFrame:
        """``texts`` with ``embedding`` from the slot, in Arrow batches; a vector of another length than ``dim`` is an error."""
        if self.embed is None:
            raise ValueError("no embed slot")
        embed = self.embed

        @F.pandas_udf("array<float>")
        def run(column: pd.Series) -> pd.Series:
            out = embed(column.fillna(""))
            if dim is not None and any(len(v) != dim for v in out):
                raise ValueError(f"a vector isn't of length {dim}")
            return out

        return texts.withColumn("embedding", run(F.col(text_col)))

    def search(self, queries: DataFrame, k: int, dim: int) -> DataFrame:
        """qid, id, score, rank: hybrid search of ``queries(qid, text)`` over the chunks, 2k from each side."""
        c = self.tables["document_chunks"]
        q = queries if "embedding" in queries.columns else self.embedded(queries, "text", dim)
        dense = search.dense_topk(q.select("qid", "embedding"), c.select("id", "embedding"), 2 * k, dim)
        sparse = search.bm25_topk(q.select("qid", "text"), c.select("id", F.col("content").alias("text")), 2 * k)
        return search.fused(dense, sparse, k)


def register(spark: SparkSession) -> None:
    """Make ``chunk_text(text)`` a table function of SQL: chunk_index, content, tokens of a text packed to the budget."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, content string, tokens int")
    class ChunkText:
        def eval(self, text: str):
            for i, (piece, _, _) in enumerate(chunking.pack([(p, None) for p in (text or "").split("\n\n")])):
                yield i, piece, chunking.words(piece)

    spark.udtf.register("chunk_text", ChunkText)
