"""Behaviour, anomaly, forecast and confidence queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import folds as fo
from tideline.sources.views import observations, outcomes, with_views


def _b(s, d):
    return fo.behavior(observations(s, d))


def _l(s, d):
    return fo.labelled(_b(s, d))


def _judged(s, d):
    """Outcomes as verdicts on insights: kinds and keys are derived from the order data."""
    o = outcomes(s, d)
    return fo.outcomes_judged(o.select(
        "seq", F.concat_ws("|", F.col("domain"), F.col("candidate_id")).alias("key"), F.when(F.col("seq") % 3 == 0, "alert").otherwise("promote").alias("insight"),
        F.when(F.col("result") == "success", "followed_success").when(F.col("result") == "partial", "ignored_validated").otherwise("followed_failure").alias("result")))


def _r(c):
    return F.round(c, 6)


QUERIES = {
    "behavior_velocity": lambda s, d: _b(s, d).select("key", "last_write", "write_count", "velocity"),
    "behavior_ema": lambda s, d: _b(s, d).select("key", F.col("value.ema").alias("value_ema"), F.col("k.ema").alias("k_ema")),
    "behavior_volatility": lambda s, d: _b(s, d).select("key", _r("volatility").alias("volatility")),
    "behavior_welford_z": lambda s, d: _b(s, d).select("key", F.round("value.mean", 9).alias("mean"), _r("value.deviation").alias("deviation"), _r("value.z").alias("z")),
    "behavior_minmax": lambda s, d: _b(s, d).select("key", F.col("value.min").alias("low"), F.col("value.max").alias("high"), (F.col("value.max") - F.col("value.min")).alias("spread")),
    "behavior_direction": lambda s, d: _b(s, d).select("key", F.col("value.direction").alias("direction"), F.col("k.direction").alias("k_direction")),
    "behavior_magnitude": lambda s, d: _b(s, d).select("key", F.col("value.magnitude").alias("magnitude")),
    "behavior_streak": lambda s, d: _b(s, d).select("key", "streak", "streak_record"),
    "behavior_entropy": lambda s, d: _b(s, d).select("key", _r("entropy").alias("entropy"), F.size("signs").cast("bigint").alias("n_signs")),
    "behavior_lifecycle": lambda s, d: _l(s, d).select("key", "lifecycle"),
    "behavior_lifecycle_changes": lambda s, d: fo.label_changes(fo.trace(observations(s, d))),
    "behavior_reads": lambda s, d: fo.read_frequency(observations(s, d).filter("event_type = 'view'")),
    "behavior_bootstrap": lambda s, d: fo.bootstrap(
        s.range(6).select(F.concat(F.lit("new:"), F.col("id").cast("string")).alias("key"), (F.col("id") % 4).alias("group")),
        _b(s, d).withColumn("group", F.substring("key", 6, 9).cast("bigint") % 3)).select(
            "key", _r("velocity").alias("velocity"), _r("volatility").alias("volatility"), "write_count", "lifecycle"),
    "insights_by_lifecycle": lambda s, d: fo.insights(_l(s, d), "stable").select("key", "last_write", "velocity"),
    "anomalies": lambda s, d: fo.anomalies(fo.trace(observations(s, d))).select("key", "ts", "seq", _r("expected").alias("expected"), "actual", _r("z").alias("z"), "severity"),
    "anomaly_severity": lambda s, d: fo.anomalies(fo.trace(observations(s, d))).groupBy("severity").agg(F.count("*").alias("n")),
    "anomalies_since": lambda s, d: fo.anomalies(fo.trace(observations(s, d))).filter("ts >= 1706000000000").select("key", "ts", "seq"),
    "recommendations": lambda s, d: fo.recommendations(_l(s, d)).select("key", "type", _r("confidence").alias("confidence")),
    "recommendation_expiry": lambda s, d: fo.alerts(fo.anomalies(fo.trace(observations(s, d)))).filter("expires_at >= 1706500000000").select(
        "key", "seq", _r("confidence").alias("confidence"), "expires_at"),
    "forecasts": lambda s, d: fo.forecasts(_b(s, d)).select("key", "h", _r("forecast").alias("forecast"), _r("confidence").alias("confidence")),
    "confidence_accuracy": lambda s, d: fo.confidence(_judged(s, d)).select("type", "scope", "total", "correct", _r("accuracy").alias("accuracy"),
                                                                          _r("recent_accuracy").alias("recent_accuracy"), _r("calibration").alias("calibration")),
    "confidence_flags": lambda s, d: fo.confidence(_judged(s, d)).select("type", "scope", "disabled", "reliable"),
}

_STEPS = """o AS (SELECT *, greatest(1, ts - lag(ts) OVER w)::DOUBLE AS dt, row_number() OVER w AS i,
        (value - lag(value) OVER w) + (k - lag(k) OVER w) AS delta FROM observations WINDOW w AS (PARTITION BY key ORDER BY ts, seq))"""
_ITEMS = f"""{_STEPS}, v AS (SELECT key, max(ts) AS last_write, count(*) AS write_count, list(value ORDER BY ts, seq) AS xs, list(k::DOUBLE ORDER BY ts, seq) AS ks,
        list_reduce(list_prepend(1.0::DOUBLE, list(3600000.0 / dt ORDER BY ts, seq) FILTER (i > 1)), lambda a, x: 0.35::DOUBLE * x + (1 - 0.35::DOUBLE) * a) AS velocity,
        coalesce(stddev_samp(dt) FILTER (i > 1), 0) AS volatility FROM o GROUP BY key),
      b AS (SELECT *, list_reduce(xs, lambda a, x: 0.3::DOUBLE * x + (1 - 0.3::DOUBLE) * a) AS ema, list_reduce(ks, lambda a, x: 0.3::DOUBLE * x + (1 - 0.3::DOUBLE) * a) AS k_ema,
        list_avg(xs) AS mean, coalesce(list_stddev_samp(xs), 0) AS deviation, list_min(xs) AS low, list_max(xs) AS high, xs[-1] AS last, ks[-1] AS k_last FROM v)"""
_DIR = "CASE WHEN {x} > {e} * 1.005::DOUBLE THEN 'up' WHEN {x} < {e} * 0.995::DOUBLE THEN 'down' ELSE 'flat' END"
_LIFE = """CASE WHEN idle > 2592000000 THEN 'dead' WHEN idle > 604800000 THEN 'dormant' WHEN velocity > 0.5 THEN CASE WHEN write_count < 10 THEN 'emerging' ELSE 'active' END
        WHEN velocity < 0.05 THEN 'declining' ELSE 'stable' END"""
_SIGNS = f"""{_STEPS}, g AS (SELECT key, ts, seq, sign(delta)::INT AS sg FROM o WHERE delta <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) - row_number() OVER (PARTITION BY key, sg ORDER BY ts, seq) AS island,
        row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS back FROM g)"""
_TRACE = f"""{_STEPS}, t0 AS (SELECT key, ts, seq, value, i, stddev_samp(value) OVER p AS sd, avg(value) OVER p AS mean, list(value) OVER p AS xs,
        list(CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 3600000.0 / dt END) OVER p AS vs, ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, seq) AS gap
        FROM o WINDOW p AS (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
      t AS (SELECT *, list_reduce(xs, lambda a, x: 0.3::DOUBLE * x + (1 - 0.3::DOUBLE) * a) AS ema, list_reduce(vs, lambda a, x: 0.35::DOUBLE * x + (1 - 0.35::DOUBLE) * a) AS velocity,
        CASE WHEN sd > 0 THEN (value - mean) / sd ELSE 0 END AS z FROM t0),
      n AS (SELECT *, CASE WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3 THEN 'high' WHEN abs(z) >= 2.5 THEN 'medium' ELSE 'low' END AS severity FROM t WHERE abs(z) >= 2)"""
_JUDGED = """j AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN 'anomaly' ELSE 'recommendation' END AS type, domain AS scope, result IN ('success', 'partial') AS ok FROM outcomes),
      q AS (SELECT *, row_number() OVER w AS i, sum(ok::INT) OVER w AS c, row_number() OVER (PARTITION BY type, scope ORDER BY seq DESC) AS back FROM j
        WINDOW w AS (PARTITION BY type, scope ORDER BY seq))"""

ORACLES = {n: with_views(q) for n, q in {
    "behavior_velocity": f"WITH {_ITEMS} SELECT key, last_write, write_count, velocity FROM b",
    "behavior_ema": f"WITH {_ITEMS} SELECT key, ema AS value_ema, k_ema FROM b",
    "behavior_volatility": f"WITH {_ITEMS} SELECT key, round(volatility, 6) AS volatility FROM b",
    "behavior_welford_z": f"WITH {_ITEMS} SELECT key, round(mean, 9) AS mean, round(deviation, 6) AS deviation, round(CASE WHEN deviation > 0 THEN (last - mean) / deviation ELSE 0 END, 6) AS z FROM b",
    "behavior_minmax": f"WITH {_ITEMS} SELECT key, low, high, high - low AS spread FROM b",
    "behavior_direction": f"WITH {_ITEMS} SELECT key, {_DIR.format(x='last', e='ema')} AS direction, {_DIR.format(x='k_last', e='k_ema')} AS k_direction FROM b",
    "behavior_magnitude": f"WITH {_ITEMS} SELECT key, CASE WHEN high > low THEN abs(last - ema) / (high - low) ELSE 0 END AS magnitude FROM b",
    "behavior_streak": f"""WITH {_SIGNS}, i AS (SELECT key, sg, island, count(*) AS n, min(back) AS back FROM r GROUP BY ALL)
        SELECT key, arg_min(sg * n, back)::BIGINT AS streak, max(n) AS streak_record FROM i GROUP BY key""",
    "behavior_entropy": f"""WITH {_SIGNS}, i AS (SELECT key, count(*) AS n_signs, count(*) FILTER (sg > 0) / count(*) AS p FROM r WHERE back <= 32 GROUP BY key)
        SELECT key, n_signs, round(CASE WHEN n_signs < 2 OR p IN (0, 1) THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END, 6) AS entropy FROM i""",
    "behavior_lifecycle": f"WITH {_ITEMS} SELECT key, {_LIFE} AS lifecycle FROM (SELECT *, max(last_write) OVER () - last_write AS idle FROM b)",
    "behavior_lifecycle_changes": f"""WITH {_TRACE}, l AS (SELECT key, ts, seq, CASE WHEN i = 1 THEN 'emerging' WHEN gap > 2592000000 THEN 'resurrected'
        WHEN velocity > 0.5 THEN CASE WHEN i < 10 THEN 'emerging' ELSE 'active' END WHEN velocity < 0.05 THEN 'declining' ELSE 'stable' END AS label FROM t),
        p AS (SELECT *, lag(label) OVER (PARTITION BY key ORDER BY ts, seq) AS label_before FROM l)
        SELECT key, ts, seq, label_before, label FROM p WHERE label_before IS DISTINCT FROM label""",
    "behavior_reads": """WITH o AS (SELECT key, ts, seq, greatest(1, ts - lag(ts) OVER w)::DOUBLE AS dt, row_number() OVER w AS i FROM observations WHERE event_type = 'view' WINDOW w AS (PARTITION BY key ORDER BY ts, seq))
        SELECT key, count(*) AS reads, list_reduce(list_prepend(0.35::DOUBLE, list(3600000.0 / dt ORDER BY ts, seq) FILTER (i > 1)),
          lambda a, x: 0.35::DOUBLE * x + (1 - 0.35::DOUBLE) * a) AS frequency FROM o GROUP BY key""",
    "behavior_bootstrap": f"""WITH {_ITEMS}, p AS (SELECT substr(key, 6)::BIGINT % 3 AS g, avg(velocity) AS v, avg(volatility) AS o, avg(write_count) AS n FROM b GROUP BY 1)
        SELECT 'new:' || i AS key, round(coalesce(v, 0), 6) AS velocity, round(coalesce(o, 0), 6) AS volatility, floor(coalesce(n, 0))::BIGINT AS write_count, 'emerging' AS lifecycle
        FROM range(6) x(i) LEFT JOIN p ON i % 4 = g""",
    "insights_by_lifecycle": f"WITH {_ITEMS} SELECT key, last_write, velocity FROM (SELECT *, max(last_write) OVER () - last_write AS idle FROM b) WHERE {_LIFE} = 'stable'",
    "anomalies": f"WITH {_TRACE} SELECT key, ts, seq, round(ema, 6) AS expected, value AS actual, round(z, 6) AS z, severity FROM n",
    "anomaly_severity": f"WITH {_TRACE} SELECT severity, count(*) AS n FROM n GROUP BY severity",
    "anomalies_since": f"WITH {_TRACE} SELECT key, ts, seq FROM n WHERE ts >= 1706000000000",
    "recommendations": f"""WITH {_SIGNS}, i AS (SELECT key, sg, island, count(*) AS c, min(back) AS back FROM r GROUP BY ALL),
        s AS (SELECT key, abs(arg_min(sg * c, back)) AS s FROM i GROUP BY key),
        v AS (SELECT key, max(ts) AS last_write, count(*) AS write_count,
          list_reduce(list_prepend(1.0::DOUBLE, list(3600000.0 / dt ORDER BY ts, seq) FILTER (i > 1)), lambda a, x: 0.35::DOUBLE * x + (1 - 0.35::DOUBLE) * a) AS velocity FROM o GROUP BY key),
        l AS (SELECT key, velocity, {_LIFE} AS life FROM (SELECT *, max(last_write) OVER () - last_write AS idle FROM v))
        SELECT key, 'promote' AS type, round(least(1.0, velocity / 5), 6) AS confidence FROM l WHERE life = 'active' AND velocity > 2
        UNION ALL SELECT key, 'demote', 0.6 FROM l WHERE life = 'declining' UNION ALL SELECT key, 'investigate', 0.8 FROM l WHERE life = 'resurrected'
        UNION ALL SELECT key, 'investigate_streak', round(least(1.0, s / 20), 6) FROM s WHERE s >= 5""",
    "recommendation_expiry": f"WITH {_TRACE} SELECT key, seq, round(least(1.0, abs(z) / 5), 6) AS confidence, ts + 86400000 AS expires_at FROM n WHERE ts + 86400000 >= 1706500000000",
    "forecasts": f"""WITH {_ITEMS}, d AS (SELECT *, {_DIR.format(x='last', e='ema')} AS dir, CASE WHEN high > low THEN abs(last - ema) / (high - low) ELSE 0 END AS m FROM b)
        SELECT key, h, round(ema + CASE dir WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END * m * (high - low) * h, 6) AS forecast,
          round(CASE WHEN high > low THEN 0.8 ELSE 0.3 END * exp(-0.1 * h), 6) AS confidence FROM d, range(1, 6) x(h)""",
    "confidence_accuracy": f"""WITH {_JUDGED} SELECT type, scope, count(*) AS total, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 6) AS accuracy,
        round(avg(ok::INT) FILTER (back <= 50), 6) AS recent_accuracy, round(least(1.0, avg(ok::INT) * 1.1), 6) AS calibration FROM q GROUP BY type, scope""",
    "confidence_flags": f"""WITH {_JUDGED}, e AS (SELECT *, CASE WHEN c / i < 0.5 AND i >= 20 THEN true WHEN c / i >= 0.6 THEN false END AS d,
        CASE WHEN c / i > 0.95 AND i > 50 THEN true WHEN c / i <= 0.9 THEN false END AS h FROM q)
        SELECT type, scope, coalesce(arg_max(d, i) FILTER (d IS NOT NULL), false) AS disabled, coalesce(arg_max(h, i) FILTER (h IS NOT NULL), false) AS reliable FROM e GROUP BY type, scope""",
}.items()}
