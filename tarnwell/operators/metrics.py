"""Counters, ratios, quantiles and samples over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("events"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def ratio(events: DataFrame, part: Column, group: str) -> DataFrame:
    """Share of ``part`` in each group, over at least 1."""
    return events.groupBy(group).agg(F.sum(part.cast("long")).alias("hits"), F.count("*").alias("events")).withColumn("ratio", F.col("hits") / F.greatest("events", F.lit(1)))


BRACKET = 5e-4  # share of the values on either side of a rank that are looked at; the approximation errs by a fifth of it


def order_statistics(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """group, n and the values at ``ranks`` (1 is the least; expressions over n) of each group, exact; nulls don't count.

    Approximate percentiles bracket every rank, aggregated before the shuffle; only the values within a bracket are
    counted and ordered, so no group is sorted as a whole. A null rank has a null value.
    """
    v = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    size = v.groupBy("g").agg(F.count("*").alias("n"))
    spots = size.select("g", "n", *[F.least(F.greatest(r.cast("long"), F.lit(1)), F.col("n")).alias(f"r_{k}") for k, r in ranks.items()])
    # the approximate value at many even shares, of which the two around a rank make its bracket
    shares = [i / 1000 for i in range(1001)]
    marks = v.groupBy("g").agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), 10_000).alias("m"))
    around = []
    for k in ranks:
        share = F.col(f"r_{k}") / F.col("n")
        lo = F.get("m", F.greatest(F.floor((share - BRACKET) * 1000).cast("int"), F.lit(0)))
        hi = F.get("m", F.least(F.ceil((share + BRACKET) * 1000).cast("int"), F.lit(1000)))
        around.append(F.struct(F.lit(k).alias("k"), F.col(f"r_{k}").alias("r"), F.when(share <= 2 * BRACKET, F.lit(float("-inf"))).otherwise(lo.cast("double")).alias("lo"), F.when(share >= 1 - 2 * BRACKET, F.lit(float("inf"))).otherwise(hi.cast("double")).alias("hi")))
    want = spots.join(marks, "g").select("g", F.explode(F.array(*around)).alias("x")).where("x.r is not null").select("g", "x.*")
    vw = v.join(want, "g")
    below = vw.groupBy("g", "k").agg(F.count(F.when(F.col("v") < F.col("lo"), 1)).alias("below"))
    inside = vw.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy("g", "k", "r", "v").agg(F.count("*").alias("c"))
    run = inside.withColumn("upto", F.sum("c").over(W.partitionBy("g", "k").orderBy("v"))).join(below, ["g", "k"])
    hit = run.where(F.col("below") + F.col("upto") >= F.col("r")).groupBy("g", "k").agg(F.min("v").alias("v"))
    wide = hit.groupBy("g").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ranks])
    return size.join(wide, "g", "left").select(F.col("g").alias(group), "n", *ranks)


def percentiles(events: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median and nearest-rank 95th percentile."""
    n = F.col("n")
    ranks = {"a": F.floor((n + 1) / 2), "b": F.floor(n / 2) + 1, "p95": F.ceil(F.lit(0.95) * n)}
    found = order_statistics(events, group, value, ranks).select(group, ((F.col("a") + F.col("b")) / 2).alias("median"), "p95")
    return events.groupBy(group).agg(F.avg(value).alias("mean")).join(found, group, "left")


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """label, quantile of cumulative ``buckets(label, le, count)``: linear within the bucket that the rank falls into.

    ``le`` is the upper bound, the last one infinite; a rank in the last bucket gives the bound before it. Without counts it is null.
    """
    w = W.partitionBy("label").orderBy("le")
    b = buckets.withColumns({"lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "before": F.coalesce(F.lag("count").over(w), F.lit(0)), "total": F.max("count").over(W.partitionBy("label"))})
    rank = q * F.col("total")
    first = b.where((F.col("count") >= rank) & (F.col("total") > 0)).groupBy("label").agg(F.min_by(F.struct("lo", "le", "before", "count", "total"), "le").alias("x"))
    at = F.when(F.col("x.le") == float("inf"), F.col("x.lo")).otherwise(F.col("x.lo") + (F.col("x.le") - F.col("x.lo")) * (q * F.col("x.total") - F.col("x.before")) / F.greatest(F.col("x.count") - F.col("x.before"), F.lit(1)))
    return buckets.select("label").distinct().join(first.select("label", at.alias("quantile")), "label", "left")


def bucketed(events: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """label, le, count: cumulative counts of the values up to each bound and to infinity."""
    edges = [*bounds, float("inf")]
    sums = events.groupBy(F.col(label).alias("label")).agg(*[F.count(F.when(F.col(value) <= e, 1)).alias(f"b{i}") for i, e in enumerate(edges)])
    return sums.select("label", F.explode(F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("count")) for i, e in enumerate(edges)])).alias("x")).select("label", "x.*")


def rates(events: DataFrame, width: str = "5 minutes", slide: str = "5 minutes") -> DataFrame:
    """window_start, event_type, events, mean per event-time window; the same expression runs on a stream."""
    return events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("events"), F.avg("value").alias("mean")).select(F.col("w.start").alias("window_start"), "event_type", "events", "mean")


def sampled(rows: DataFrame, key: Column, share: float) -> DataFrame:
    """The rows whose key falls within the share; the same key is always in or out."""
    place = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return rows.where(place <= share)
