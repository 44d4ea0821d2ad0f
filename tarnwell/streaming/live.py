"""Streaming counterparts: windowed rates, threshold breaches, recent turns, exact cache with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream over the parquet file or folder ``folder/name.parquet``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").load(f"{folder}/{name}.parquet*", format="parquet")


def rates(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str = "5 minutes") -> DataFrame:
    """Counts and means per event-time window; rows later than ``late`` are dropped."""
    from tarnwell.operators.metrics import rates as batch

    return batch(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width, slide)


def breaches(events: DataFrame, kind: str, share: float, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Windows in which the share of events of a kind is above ``share``."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width).alias("w")).agg(F.avg((F.col("event_type") == kind).cast("double")).alias("share"), F.count("*").alias("events"))
    return g.where(F.col("share") > share).select(F.col("w.start").alias("window_start"), "share", "events")


def recent(messages: DataFrame, n: int = 12, ttl_ms: int = 12 * 3600 * 1000) -> DataFrame:
    """The last n messages of each session as they come; a session silent for ``ttl_ms`` of processing time is forgotten.

    ``messages(session_id, id, content)`` → session_id, turns (array of content, oldest first).
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            held = (held + [x or "" for x in pdf.sort_values("id")["content"]])[-n:]
        state.update((held,))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "turns": [held]})

    return messages.groupBy("session_id").applyInPandasWithState(step, "session_id string, turns array<string>", "turns array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def first_seen(rows: DataFrame, key: str, ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """An exact cache on a stream: the first row of each key within ``ttl`` passes."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def core_states(facts: DataFrame, ttl_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """The state of each session as its facts come: the last age, and allergies and conditions in order, each once.

    ``facts(session_id, id, key, value)`` → session_id, age, allergies, conditions; a session silent for ``ttl_ms`` is forgotten.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        age, allergies, conditions = state.get if state.exists else (None, [], [])
        lists = {"allergy": list(allergies), "condition": list(conditions)}
        for pdf in batches:
            for k, v in pdf.sort_values("id")[["key", "value"]].itertuples(index=False):
                k, v = (k or "").strip().lower(), (v or "").strip()
                if v and k == "age":
                    age = v
                elif v and k in lists and v not in lists[k]:
                    lists[k].append(v)
        state.update((age, lists["allergy"], lists["condition"]))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "age": [age], "allergies": [lists["allergy"]], "conditions": [lists["condition"]]})

    kinds = "age string, allergies array<string>, conditions array<string>"
    return facts.groupBy("session_id").applyInPandasWithState(step, f"session_id string, {kinds}", kinds, "update", GroupStateTimeout.ProcessingTimeTimeout)


def to_table(rows: DataFrame, path: str, checkpoint: str):
    """Start a query that appends every micro-batch once to a parquet table; ``since`` reads it by cursor."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is retried replaces itself

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def since(spark: SparkSession, path: str, cursor: int) -> DataFrame:
    """The rows of the batches after ``cursor``, each with its batch: what a client that has read up to there is sent next."""
    return spark.read.parquet(path).where(F.col("batch") > cursor)


def ring(rows: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The last n rows of each group by ``order``, as a cache of n entries holds them."""
    from tarnwell.operators.search import topk

    return topk(rows, group, n, *order).drop("rank")
