"""Archive, item, window, bandit and streaming queries with their oracles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tideline.operators import bandit, folds, market
from tideline.plans.fold_queries import _ITEMS
from tideline.session import table
from tideline.sources import archive
from tideline.sources.views import mutations, observations, outcomes, snapshots, with_views
from tideline.streaming import live


def _folder(s, name):
    """A fresh folder in the session's shared checkpoint folder, or in local mode a temporary one."""
    base = s.sparkContext.getCheckpointDir() or s.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tideline-")
    return f"{base}/{name}-{uuid.uuid4()}"


def _archived(s, d):
    path = _folder(s, "archive")
    archive.write(snapshots(s, d), path, segment_bytes=1 << 17)
    return path


def _events(s, d):
    return table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.concat(F.lit("user:"), F.col("user_id")).alias("key"), (F.col("value") + 0.0).alias("value"))


def _streamed(s, d, since=None):
    """The behaviour fold run as a stream over the observations, one micro-batch of files; with ``since``, started from
    the batch fold of those before."""
    live.store(s)
    base = _folder(s, "stream")
    rows = observations(s, d).select("key", "ts", "seq", "value", F.col("k").cast("double").alias("k"))
    initial = None
    if since is not None:
        initial = live.restorable(folds.behavior(rows.filter(F.col("ts") < since))).checkpoint() if s.sparkContext.getCheckpointDir() else live.restorable(folds.behavior(rows.filter(F.col("ts") < since)))
        rows = rows.filter(F.col("ts") >= since)
    rows.write.parquet(base + "/in")
    stream = s.readStream.schema("key string, ts bigint, seq bigint, value double, k double").parquet(base + "/in")
    q = (live.behavior(stream, initial).writeStream.outputMode("update").option("checkpointLocation", base + "/ck").trigger(availableNow=True)
         .foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out/{n}")).start())
    q.awaitTermination()
    return s.read.parquet(base + "/out/*")


_FULL = ("key", "last_write", "write_count", "velocity", "ema", "low", "high", "streak", "streak_record", "signs")


def _whole(df):
    return df.select(*[_r(c).alias(c) if c in ("velocity", "ema") else c for c in _FULL], F.round("mean", 9).alias("mean"), *[_r(c).alias(c) for c in ("volatility", "deviation", "z", "entropy")])


def _upkept(s, d):
    """A mutation stream in four files, a micro-batch each, applied to a bucketed table."""
    base = _folder(s, "upkeep")
    log = mutations(s, d)
    log.withColumn("_f", F.col("lsn") % 4).repartition(4, "_f").drop("_f").write.parquet(base + "/in")
    schema = s.read.parquet(base + "/in").schema
    stream = s.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(base + "/in")
    live.upkeep(stream, base + "/table", base + "/ck", 16).trigger(availableNow=True).start().awaitTermination()
    return live.held(s, base + "/table")


def _r(c):
    return F.round(c, 6)


QUERIES = {
    "archive_roundtrip": lambda s, d: archive.read(s, _archived(s, d)).select("ts", "item_id", "price", "quantity"),
    "archive_query_pruned": lambda s, d: archive.query(s, _archived(s, d), 17).select("ts", "item_id", "price", "quantity"),
    "archive_verify": lambda s, d: archive.verify_all(s, _archived(s, d)).agg(F.bool_and("valid").alias("valid")),
    "snapshot_query_item": lambda s, d: market.snapshot_query(snapshots(s, d), 17),
    "item_history": lambda s, d: market.history(snapshots(s, d)).select("item_id", "ts", "price", _r("change").alias("change")),
    "item_history_limited": lambda s, d: market.history(snapshots(s, d), limit=3).select("item_id", "ts", "price"),
    "item_stats": lambda s, d: market.stats(snapshots(s, d)).select("item_id", "n", "low", "high", F.round("mean", 8).alias("mean"), _r("volatility").alias("volatility"), _r("trend").alias("trend")),
    "market_movers": lambda s, d: market.movers(snapshots(s, d)).select("side", "item_id", _r("trend").alias("trend")),
    "market_sentiment": lambda s, d: market.sentiment(snapshots(s, d)),
    "activity_score": lambda s, d: market.activity(snapshots(s, d)).select("item_id", _r("score").alias("score")),
    "sparse_query": lambda s, d: market.sparse(snapshots(s, d), s.createDataFrame([(5, 0, 800_000_000), (23, 900_000_000, 2_000_000_000)], "item_id bigint, low bigint, high bigint")),
    "window_tumbling": lambda s, d: market.windows(_events(s, d), "6 hours").select("start", "kind", "n", _r("total").alias("total")),
    "window_sliding": lambda s, d: market.windows(_events(s, d), "6 hours", "2 hours").select("start", "kind", "n"),
    "window_sessions": lambda s, d: market.sessions(_events(s, d), "4 hours"),
    "as_of_join": lambda s, d: market.as_of(
        observations(s, d).filter("event_type = 'purchase'").select("key", "ts", "seq"),
        observations(s, d).filter("event_type = 'view'").select("key", F.col("ts"), F.col("seq").alias("value"))),
    "bandit_choices": lambda s, d: bandit.choose(outcomes(s, d).select(F.col("domain").alias("task"), F.col("candidate_id").alias("arm"), (F.col("result") == "success").alias("success"), (F.col("seq") % 40).alias("age_days"))),
    "stream_behavior_parity": lambda s, d: _streamed(s, d).select("key", "last_write", "write_count", "velocity", "ema"),
    "stream_behavior_full": lambda s, d: _whole(_streamed(s, d)),
    "stream_behavior_restored": lambda s, d: _whole(_streamed(s, d, 1_705_000_000_000)),
    "stream_upkeep": lambda s, d: _upkept(s, d).select("key", "lsn", "ts", "op"),
}

_FULL_SQL = f"""WITH {_ITEMS.replace("{", "{{").replace("}", "}}")}, g AS (SELECT key, ts, seq, sign(delta)::INT AS sg FROM o WHERE delta <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) - row_number() OVER (PARTITION BY key, sg ORDER BY ts, seq) AS island,
        row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS back FROM g),
      i AS (SELECT key, sg, island, count(*) AS n, min(back) AS back FROM r GROUP BY ALL), s AS (SELECT key, arg_min(sg * n, back)::BIGINT AS streak, max(n) AS streak_record FROM i GROUP BY key),
      e AS (SELECT key, count(*) AS signs, count(*) FILTER (sg > 0) / count(*) AS p FROM r WHERE back <= 32 GROUP BY key)
      SELECT b.key, last_write, write_count, round(velocity, 6) AS velocity, round(ema, 6) AS ema, low, high, streak, streak_record, signs, round(volatility, 6) AS volatility, round(mean, 9) AS mean,
        round(deviation, 6) AS deviation, round(CASE WHEN deviation > 0 THEN (last - mean) / deviation ELSE 0 END, 6) AS z,
        round(CASE WHEN signs < 2 OR p IN (0, 1) THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END, 6) AS entropy
      FROM b JOIN s USING (key) JOIN e USING (key) {{also}}"""
_ST = """g AS (SELECT item_id, count(*) AS n, min(price) AS low, max(price) AS high, avg(price) AS mean, coalesce(stddev_samp(price), 0) / avg(price) AS volatility,
      (arg_max(price, ts) - arg_min(price, ts)) / arg_min(price, ts) AS trend FROM snapshots GROUP BY item_id)"""
ORACLES = {n: with_views(q) for n, q in {
    "archive_roundtrip": "SELECT ts, item_id, price, quantity FROM snapshots",
    "archive_query_pruned": "SELECT ts, item_id, price, quantity FROM snapshots WHERE ts IN (SELECT ts FROM snapshots WHERE item_id = 17)",
    "archive_verify": "SELECT true AS valid",
    "snapshot_query_item": "SELECT ts, item_id, price, quantity FROM snapshots WHERE ts IN (SELECT ts FROM snapshots WHERE item_id = 17)",
    "item_history": """SELECT item_id, ts, price, round(price - lag(price) OVER (PARTITION BY item_id ORDER BY ts), 6) AS change FROM snapshots""",
    "item_history_limited": "SELECT item_id, ts, price FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC) AS k FROM snapshots) WHERE k <= 3",
    "item_stats": f"WITH {_ST} SELECT item_id, n, low, high, round(mean, 8) AS mean, round(volatility, 6) AS volatility, round(trend, 6) AS trend FROM g",
    "market_movers": f"""WITH {_ST}, u AS (SELECT 'gainer' AS side, item_id, trend FROM g WHERE n > 1 ORDER BY round(trend, 9) DESC, item_id LIMIT 10),
        l AS (SELECT 'loser' AS side, item_id, trend FROM g WHERE n > 1 ORDER BY round(trend, 9), item_id LIMIT 10) SELECT side, item_id, round(trend, 6) AS trend FROM (SELECT * FROM u UNION ALL SELECT * FROM l)""",
    "market_sentiment": f"WITH {_ST} SELECT count(*) AS items, count(*) FILTER (trend > 0) AS rising, count(*) FILTER (trend < 0) AS falling FROM g WHERE n > 1",
    "activity_score": """WITH w AS (SELECT item_id, sum(pow(2.0, -(m - ts) / 7776000.0)) AS w FROM (SELECT *, max(ts) OVER () AS m FROM snapshots) GROUP BY item_id)
        SELECT item_id, round(w / max(w) OVER (), 6) AS score FROM w""",
    "sparse_query": "SELECT item_id, ts, price, quantity FROM snapshots WHERE (item_id = 5 AND ts BETWEEN 0 AND 800000000) OR (item_id = 23 AND ts BETWEEN 900000000 AND 2000000000)",
    "window_tumbling": """SELECT epoch_us(ts) // 21600000000 * 21600 AS start, event_type AS kind, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""",
    "window_sliding": """SELECT (epoch_us(ts) // 7200000000 - k) * 7200 AS start, event_type AS kind, count(*) AS n FROM events, range(3) r(k) GROUP BY 1, 2""",
    "window_sessions": """WITH e AS (SELECT 'user:' || user_id AS key, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 14400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t) AS i FROM e) SELECT key, min(t) AS start_us, count(*) AS n FROM s GROUP BY key, i""",
    "as_of_join": """WITH p AS (SELECT key, ts, seq FROM observations WHERE event_type = 'purchase'), v AS (SELECT key, ts, seq FROM observations WHERE event_type = 'view')
        SELECT p.key, p.ts, p.seq, v.seq AS as_of FROM p ASOF LEFT JOIN v ON p.key = v.key AND p.ts >= v.ts""",
    "stream_behavior_full": _FULL_SQL.format(also=""),
    "stream_behavior_restored": _FULL_SQL.format(also="WHERE last_write >= 1705000000000"),
    "stream_upkeep": "SELECT key, unnest(arg_max({'lsn': lsn, 'ts': ts, 'op': op}, {'a': ts, 'b': lsn})) FROM mutations GROUP BY key",
    "stream_behavior_parity": """WITH o AS (SELECT *, greatest(1, ts - lag(ts) OVER w)::DOUBLE AS dt, row_number() OVER w AS i FROM observations WINDOW w AS (PARTITION BY key ORDER BY ts, seq))
        SELECT key, max(ts) AS last_write, count(*) AS write_count, list_reduce(list_prepend(1.0::DOUBLE, list(3600000.0 / dt ORDER BY ts, seq) FILTER (i > 1)), lambda a, x: 0.35::DOUBLE * x + (1 - 0.35::DOUBLE) * a) AS velocity,
        list_reduce(list(value ORDER BY ts, seq), lambda a, x: 0.3::DOUBLE * x + (1 - 0.3::DOUBLE) * a) AS ema FROM o GROUP BY key""",
}.items()}
