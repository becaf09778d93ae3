"""Item-level queries over snapshots (ts seconds, item_id, price, quantity): the declared vocabulary of
the archive's query types, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400


def snapshot_query(rows: DataFrame, item: int) -> DataFrame:
    """All items of the snapshots that hold an item (a semi-join; the few times broadcast by AQE)."""
    return rows.join(rows.filter(F.col("item_id") == item).select("ts").distinct(), "ts", "left_semi")


def history(rows: DataFrame, items: list[int] | None = None, low: int | None = None, high: int | None = None, limit: int = 0) -> DataFrame:
    """Items' samples (all items if none are named) in a time range with the change from the one before; the newest of each if limited."""
    w = W.partitionBy("item_id").orderBy("ts")
    found = rows if items is None else rows.filter(F.col("item_id").isin(items))
    if low is not None:
        found = found.filter(F.col("ts") >= low)
    if high is not None:
        found = found.filter(F.col("ts") <= high)
    found = found.withColumn("change", F.col("price") - F.lag("price").over(w))
    if limit:
        newest = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("ts")))
        found = found.withColumn("_n", newest).filter(F.col("_n") <= limit).drop("_n")
    return found


def stats(rows: DataFrame) -> DataFrame:
    """Per item: samples, min, max, average, volatility (deviation over mean) and trend (last over first)."""
    first, last = F.min_by("price", "ts"), F.max_by("price", "ts")
    return rows.groupBy("item_id").agg(
        F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean"),
        F.when(F.avg("price") != 0, F.coalesce(F.stddev_samp("price"), F.lit(0.0)) / F.avg("price")).otherwise(0.0).alias("volatility"),
        F.when(first != 0, (last - first) / first).otherwise(0.0).alias("trend"))


def movers(rows: DataFrame, most: int = 10) -> DataFrame:
    """The largest gainers and losers by relative change, ranked."""
    s = stats(rows).filter("n > 1")
    up = s.orderBy(F.desc(F.round("trend", 9)), "item_id").limit(most).withColumn("side", F.lit("gainer"))
    down = s.orderBy(F.round("trend", 9), "item_id").limit(most).withColumn("side", F.lit("loser"))
    return up.union(down).select("side", "item_id", "trend")


def sentiment(rows: DataFrame) -> DataFrame:
    """Shares of items that rose, fell and stood."""
    s = stats(rows).filter("n > 1")
    return s.agg(F.count("*").alias("items"), F.count_if(F.col("trend") > 0).alias("rising"), F.count_if(F.col("trend") < 0).alias("falling"))


def activity(rows: DataFrame, now: int | None = None, half_life: int = 90 * DAY) -> DataFrame:
    """Samples weighted by age with a half-life, over the largest such weight: a score within 0 to 1."""
    latest = rows.agg((F.max("ts") if now is None else F.lit(now)).alias("now"))
    weight = F.pow(F.lit(2.0), -(F.col("now") - F.col("ts")) / float(half_life))
    per = rows.crossJoin(F.broadcast(latest)).groupBy("item_id").agg(F.sum(weight).alias("w"))
    top = per.agg(F.max("w").alias("top"))
    return per.crossJoin(F.broadcast(top)).select("item_id", F.when(F.col("top") > 0, F.col("w") / F.col("top")).otherwise(0.0).alias("score"))


def sparse(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Samples of (item_id, low, high) requests."""
    return rows.join(F.broadcast(wanted), "item_id").filter("ts BETWEEN low AND high").drop("low", "high")


def windows(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding event-time window and kind; events: (ts timestamp, kind, value)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_seconds("w.start").alias("start"), "kind", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Per key: sessions closed by a gap."""
    return events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("key", F.unix_micros("w.start").alias("start_us"), "n")


def as_of(left: DataFrame, right: DataFrame, by: str = "key") -> DataFrame:
    """left (key, ts) with the newest right (key, ts, value) at or before it: one union and one
    window, no range join."""
    both = left.select(by, "ts", F.lit(1).alias("_side"), F.lit(None).cast(right.schema["value"].dataType).alias("value"), F.struct("*").alias("_row")).unionByName(
        right.select(by, "ts", F.lit(0).alias("_side"), "value"), allowMissingColumns=True)
    w = W.partitionBy(by).orderBy("ts", "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("value", ignorenulls=True).over(w)).filter("_side = 1").select("_row.*", "as_of")
