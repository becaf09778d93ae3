"""Block metrics, integer transforms and health queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import blocks as bl
from tideline.sources.views import observations, with_views

SIZE = 250


def _rows(s, d):
    """Two streams cut into blocks by event number: the values, and the whole-number property."""
    o = observations(s, d)
    cut = F.floor(F.col("seq") / SIZE).cast("bigint").alias("block")
    return o.select(F.lit("value").alias("stream"), cut, "seq", F.col("value").alias("x")).union(
        o.select(F.lit("k").alias("stream"), cut, "seq", F.col("k").cast("double")))


def _ints(s, d):
    o = observations(s, d)
    cut = F.floor(F.col("seq") / SIZE).cast("bigint").alias("block")
    return o.select(F.lit("k").alias("stream"), cut, "seq", F.col("k").alias("x")).union(o.select(F.lit("ts").alias("stream"), cut, "seq", F.col("ts")))


def _blocks(s, d):
    """Metrics with a stand-in compression ratio: values over distinct values, log-damped."""
    return bl.metrics(_rows(s, d)).withColumn("ratio", F.round(1 / F.greatest(F.lit(0.01), F.col("unique_ratio")), 9))


def _event_blocks(s, d):
    """Small blocks of each event type with a ratio that swings with the values, so that every state is met."""
    o = observations(s, d).withColumn("block", F.floor(F.col("seq") / 40).cast("bigint"))
    return o.groupBy(F.col("event_type").alias("stream"), "block").agg(
        F.round(F.avg(F.col("value")) / 20, 9).alias("ratio"), (F.count_distinct(F.floor("k")) / F.count("*")).alias("unique_ratio"),
        (F.count_distinct(F.col("k") % 7) / F.count("*")).alias("unique_delta_ratio"))


def _rounded(df, keep):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c in keep or not keep])


_X = f"""x AS (SELECT 'value' AS stream, seq // {SIZE} AS block, seq, value AS x FROM observations UNION ALL SELECT 'k', seq // {SIZE}, seq, k::DOUBLE FROM observations)"""
_D = """d0 AS (SELECT *, x - lag(x) OVER w AS d FROM x WINDOW w AS (PARTITION BY stream, block ORDER BY seq)),
      d1 AS (SELECT *, d - lag(d) OVER w AS dd, coalesce(sign(d) * sign(lag(d) OVER w) < 0, false) AS flip, coalesce(avg(abs(d)) OVER (PARTITION BY stream, block), 0) AS md
        FROM d0 WINDOW w AS (PARTITION BY stream, block ORDER BY seq))"""
_M = f"""{_X}, {_D}, m AS (SELECT stream, block, count(*) AS n, count(DISTINCT x) / count(*) AS unique_ratio, count(*) FILTER (x = 0) / count(*) AS zero_ratio,
        coalesce(avg(abs(d)), 0) AS mean_abs_delta, list_sort(list(abs(d)) FILTER (d IS NOT NULL))[floor(count(d) * 0.9)::INT + 1] AS p90_abs_delta,
        count(*) FILTER (flip) / (count(d) - 1) AS sign_flip_rate, greatest(count(*) FILTER (d >= 0), count(*) FILTER (d <= 0)) / count(d) AS monotonicity,
        count(*) FILTER (abs(d) > 5 * md) / count(d) AS outlier_share, count(DISTINCT d) / count(d) AS unique_delta_ratio, count(DISTINCT dd) / count(dd) AS unique_dod_ratio,
        count(*) FILTER (dd = 0) / count(dd) AS zero_dod_ratio, coalesce(avg(abs(dd)), 0) AS mean_abs_dod,
        list_sort(list(abs(dd)) FILTER (dd IS NOT NULL))[floor(count(dd) * 0.9)::INT + 1] AS p90_abs_dod FROM d1 GROUP BY stream, block)"""
_NAMES = ("unique_ratio", "zero_ratio", "mean_abs_delta", "p90_abs_delta", "sign_flip_rate", "monotonicity", "outlier_share", "unique_delta_ratio",
          "unique_dod_ratio", "zero_dod_ratio", "mean_abs_dod", "p90_abs_dod")
_REGIME = "CASE WHEN monotonicity > 0.9 OR unique_ratio < 0.05 THEN 'ORDERED' WHEN (sign_flip_rate > 0.4 AND unique_ratio > 0.8) OR outlier_share > 0.1 THEN 'CHAOTIC' ELSE 'MIXED' END"
_I = f"""x AS (SELECT 'k' AS stream, seq // {SIZE} AS block, seq, k AS x FROM observations UNION ALL SELECT 'ts', seq // {SIZE}, seq, ts FROM observations)"""

QUERIES = {
    "block_metrics": lambda s, d: _rounded(bl.metrics(_rows(s, d)), ()),
    "block_regime": lambda s, d: bl.metrics(_rows(s, d)).select("stream", "block", bl.regime().alias("regime")),
    "block_worst10": lambda s, d: bl.worst(_blocks(s, d)).select("stream", "block", "ratio"),
    "time_dod": lambda s, d: bl.differences(_ints(s, d).filter("stream = 'ts'")).select("block", "seq", "d", "dd"),
    "value_delta": lambda s, d: bl.differences(_ints(s, d).filter("stream = 'k'")).select("block", "seq", "x", "d"),
    "value_restored": lambda s, d: bl.inverse_differences(bl.differences(_ints(s, d))).select("stream", "seq", "restored"),
    "value_rle_runs": lambda s, d: bl.runs(_ints(s, d).withColumn("x", F.col("x") % 2)),
    "integer_codec_sizes": lambda s, d: bl.integer_sizes(_ints(s, d)),
    "health_gates": lambda s, d: bl.gates(_blocks(s, d)).select("stream", "block", "gated"),
    "health_routes": lambda s, d: bl.health(_blocks(s, d)).select("stream", "block", "route", "reason", "state", "quarantined", F.round("baseline", 6).alias("baseline"), F.round("deviation", 6).alias("deviation")),
    "health_segments": lambda s, d: bl.anomaly_segments(bl.health(_blocks(s, d))),
    "health_routes_by_event": lambda s, d: bl.health(_event_blocks(s, d)).select("stream", "block", "route", "reason", "state"),
    "health_segments_by_event": lambda s, d: bl.anomaly_segments(bl.health(_event_blocks(s, d))),
}
_GATE = f"""{_M}, h AS (SELECT stream, block, round(1 / greatest(0.01, unique_ratio), 9) AS ratio, unique_ratio, unique_delta_ratio FROM m)"""
_EVENT_GATE = """h AS (SELECT event_type AS stream, seq // 40 AS block, round(avg(value) / 20, 9) AS ratio, count(DISTINCT k) / count(*) AS unique_ratio,
        count(DISTINCT k % 7) / count(*) AS unique_delta_ratio FROM observations GROUP BY ALL)"""
#: The monitor, a block of every stream a step.
_FOLD = """b AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY block) AS i FROM h),
      f AS (SELECT DISTINCT stream, 0::BIGINT AS i, NULL::BIGINT AS block, NULL::DOUBLE AS ratio, NULL::DOUBLE AS u, 'CORE' AS route, NULL::VARCHAR AS reason, 'OK' AS state, false AS q,
          2.0::DOUBLE AS base, 0.5::DOUBLE AS dev, 0.5::DOUBLE AS uniq, 0.0::DOUBLE AS frozen, 0::BIGINT AS good, NULL::VARCHAR AS cause, NULL::BOOLEAN AS probe FROM h
        UNION ALL
        SELECT stream, i, block, ratio, u, CASE WHEN state IN ('OK', 'ANOMALY_END') THEN 'CORE' ELSE 'QUARANTINE' END, reason, state, state IN ('ANOMALY_START', 'ANOMALY_MID'),
          CASE WHEN NOT learns THEN base WHEN i = 1 THEN ratio ELSE 0.1::DOUBLE * ratio + 0.9::DOUBLE * base END,
          CASE WHEN NOT learns THEN dev WHEN i = 1 THEN 0.1::DOUBLE * ratio ELSE 0.1::DOUBLE * abs(ratio - base) + 0.9::DOUBLE * dev END,
          CASE WHEN NOT learns THEN uniq WHEN i = 1 THEN u ELSE 0.1::DOUBLE * u + 0.9::DOUBLE * uniq END,
          CASE state WHEN 'ANOMALY_START' THEN base WHEN 'ANOMALY_END' THEN 0 ELSE frozen END,
          CASE WHEN state IN ('ANOMALY_START', 'ANOMALY_END') THEN 0 WHEN p THEN good + 1 WHEN NOT p THEN 0 ELSE good END,
          CASE WHEN state = 'ANOMALY_START' THEN coalesce(c, 'unknown') END, CASE WHEN state = 'ANOMALY_MID' THEN p END
        FROM (SELECT *, state = 'OK' AND u <= 0.8 AS learns FROM (
          SELECT *, CASE WHEN NOT q THEN CASE WHEN gate THEN 'entropy_gate' ELSE c END WHEN p AND good >= 2 AND NOT gate THEN 'recovery_match' WHEN gate THEN 'entropy_gate'
              WHEN p THEN 'recovery_pending' WHEN NOT p THEN 'recovery_probe_fail' ELSE 'quarantine_active' END AS reason,
            CASE WHEN NOT q AND NOT gate AND c IS NULL THEN 'OK' WHEN NOT q THEN 'ANOMALY_START' WHEN p AND good >= 2 AND NOT gate THEN 'ANOMALY_END' ELSE 'ANOMALY_MID' END AS state
          FROM (SELECT f.stream, b.i, b.block, b.ratio, b.unique_ratio AS u, f.q, f.base, f.dev, f.uniq, f.frozen, f.good, b.unique_ratio > 0.85 AND b.unique_delta_ratio > 0.85 AS gate,
              CASE WHEN b.ratio < f.base - 3 * least(f.dev, 0.9::DOUBLE * f.base / 3) THEN 'ratio_drop' WHEN b.unique_ratio > 1.5 * f.uniq AND b.unique_ratio > 0.5 AND b.ratio < f.base THEN 'entropy_burst' END AS c,
              CASE WHEN f.q AND b.block % 4 = 0 THEN b.ratio >= coalesce(nullif(f.frozen, 0), f.base) - 10 * greatest(f.dev, 0.1) END AS p
            FROM f JOIN b ON f.stream = b.stream AND b.i = f.i + 1)))),
      y AS (SELECT *, count(*) FILTER (state = 'ANOMALY_START') OVER (PARTITION BY stream ORDER BY block) AS segment, max(block) OVER (PARTITION BY stream) AS final FROM f WHERE i > 0)"""
_SEGMENTS = """SELECT stream, segment, min(block) AS first, coalesce(max(block) FILTER (state = 'ANOMALY_END'), max(final)) AS last, count(*) FILTER (q) AS blocks, max(cause) AS cause,
        min(ratio) FILTER (q) AS worst, max(u) FILTER (q) AS most_unique, count(probe) AS probes, count(*) FILTER (probe) AS good_probes FROM y WHERE state <> 'OK' GROUP BY stream, segment"""
ORACLES = {n: with_views(q) for n, q in {
    "health_routes": f"WITH RECURSIVE {_GATE}, {_FOLD} SELECT stream, block, route, reason, state, q AS quarantined, round(base, 6) AS baseline, round(dev, 6) AS deviation FROM y",
    "health_segments": f"WITH RECURSIVE {_GATE}, {_FOLD} {_SEGMENTS}",
    "health_routes_by_event": f"WITH RECURSIVE {_EVENT_GATE}, {_FOLD} SELECT stream, block, route, reason, state FROM y",
    "health_segments_by_event": f"WITH RECURSIVE {_EVENT_GATE}, {_FOLD} {_SEGMENTS}",
    "block_metrics": f"WITH {_M} SELECT stream, block, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NAMES) + " FROM m",
    "block_regime": f"WITH {_M} SELECT stream, block, {_REGIME} AS regime FROM m",
    "block_worst10": f"WITH {_GATE} SELECT stream, block, ratio FROM h ORDER BY ratio, stream, block LIMIT 10",
    "time_dod": f"""WITH {_I}, a AS (SELECT *, x - lag(x) OVER w AS d FROM x WHERE stream = 'ts' WINDOW w AS (PARTITION BY block ORDER BY seq))
        SELECT block, seq, d, d - lag(d) OVER (PARTITION BY block ORDER BY seq) AS dd FROM a""",
    "value_delta": f"WITH {_I} SELECT block, seq, x, x - lag(x) OVER (PARTITION BY block ORDER BY seq) AS d FROM x WHERE stream = 'k'",
    "value_restored": f"WITH {_I} SELECT stream, seq, x::BIGINT AS restored FROM x",
    "value_rle_runs": f"""WITH {_I}, y AS (SELECT stream, block, seq, x % 2 AS x FROM x), i AS (SELECT *, row_number() OVER (PARTITION BY stream, block ORDER BY seq)
        - row_number() OVER (PARTITION BY stream, block, x ORDER BY seq) AS g FROM y), r AS (SELECT stream, block, x, g, count(*) AS n FROM i GROUP BY ALL)
        SELECT stream, block, count(*) AS runs, sum(ceil(n / 255))::BIGINT AS tokens, max(n) AS longest FROM r GROUP BY ALL""",
    "health_gates": f"WITH {_GATE} SELECT stream, block, unique_ratio > 0.85 AND unique_delta_ratio > 0.85 AS gated FROM h",
    "integer_codec_sizes": f"""WITH {_I}, a AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY stream, block ORDER BY seq), x) AS d FROM x),
        z AS (SELECT *, CASE WHEN x >= 0 THEN x * 2 ELSE -x * 2 - 1 END AS zx, CASE WHEN d >= 0 THEN d * 2 ELSE -d * 2 - 1 END AS zd FROM a),
        w AS (SELECT stream, block, count(*) AS n, sum(ceil(length(bin(zd)) / 7))::BIGINT AS varint, max(length(bin(zx))) AS w, max(length(bin(zd))) AS dw,
          length(bin(max(x) - min(x))) AS fw, count(DISTINCT x) AS u FROM z GROUP BY ALL),
        s AS (SELECT stream, block, varint, 1 + ceil(n * w / 8)::BIGINT AS bitpack, 1 + ceil(n * dw / 8)::BIGINT AS delta_bitpack, 9 + ceil(n * fw / 8)::BIGINT AS frame,
          CASE WHEN u <= 256 THEN u * 8 + n END AS dictionary, n * 8 AS fixed FROM w)
        SELECT *, CASE least(varint, bitpack, delta_bitpack, frame, dictionary, fixed) WHEN varint THEN 'varint' WHEN bitpack THEN 'bitpack' WHEN delta_bitpack THEN 'delta_bitpack'
          WHEN frame THEN 'frame' WHEN dictionary THEN 'dictionary' ELSE 'fixed' END AS codec, least(varint, bitpack, delta_bitpack, frame, dictionary, fixed) AS bytes FROM s""",
}.items()}
