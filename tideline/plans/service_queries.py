"""Record archives, service aggregates, published artefacts and runtime policies, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import blocks as bl
from tideline.operators import correlate as co
from tideline.operators import folds as fo
from tideline.operators import infer as inf
from tideline.operators import policy as po
from tideline.operators import state as st
from tideline.plans.block_queries import _EVENT_GATE, _FOLD, _event_blocks
from tideline.plans.extra_queries import _folder
from tideline.sources import records as rc
from tideline.plans.fold_queries import _SIGNS, _TRACE
from tideline.plans.state_queries import _FLUSH
from tideline.sources.views import mutations, observations, outcomes, with_views

FIELDS = {"value": "numeric", "k": "numeric", "kind": "categorical"}
PASSWORD = "correct horse"


def _r(c):
    return F.round(c, 6)


def _records(s, d):
    """Hourly snapshots of the users seen in them, with a field that is sometimes absent."""
    hour = F.floor(F.col("ts") / 3_600_000).cast("bigint")
    return observations(s, d).groupBy(hour.alias("ts"), F.col("key").alias("item_key")).agg(
        F.when(F.max("k") % 5 != 0, F.round(F.sum("value"), 6)).alias("value"), F.max("k").cast("double").alias("k"), F.max("event_type").alias("kind"))


def _archive(s, d, **options):
    path = _folder(s, "records")
    rc.write(_records(s, d), path, FIELDS, segment_rows=2_000, parts=3, **options)
    return path


def _typed(s, d):
    known = rc.dictionary(observations(s, d), "event_type")
    return rc.decoded(rc.coded(observations(s, d).select("seq", "event_type"), "event_type", known), "event_type", known)


def _sized(s, d):
    rows = bl.health(_event_blocks(s, d)).select("stream", "route", F.lit(320).cast("bigint").alias("in_bytes"), F.floor(320 / F.greatest(F.col("ratio"), F.lit(0.1))).cast("bigint").alias("out_bytes"))
    return bl.telemetry(rows, "stream")


def _published(s, d):
    i = F.substring("candidate_id", 2, 2).cast("double")
    stats = inf.outcome_stats(outcomes(s, d))
    ranked = inf.rank(stats.select("domain", "candidate_id", (i / 7).alias("_i")), stats)
    return inf.publish(ranked.select("domain", "candidate_id", F.round("score", 9).alias("score"), F.round("confidence", 9).alias("confidence"), "rank"), 1)


def _insights(s, d):
    found = fo.alerts(fo.anomalies(fo.trace(observations(s, d))))
    return found.select((F.col("seq") * 10).alias("insight_id"), "key", F.lit("alert").alias("type"), F.round("confidence", 6).alias("confidence"))


def _verdicts(s, d):
    return outcomes(s, d).select((F.col("seq") % 10_000 * 10).alias("insight_id"), "seq", "result")


def _pressure(s, d):
    return observations(s, d).select(F.lit("all").alias("log"), "seq", F.col("event_type").isin("view", "click", "purchase").alias("begins"))


def _attempts(s, d):
    error = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "signup", "refused")
    return observations(s, d).select(F.col("seq").alias("op"), (F.col("k") % 4 + 1).cast("int").alias("attempt"), error.alias("error"))


QUERIES = {
    "records_roundtrip": lambda s, d: rc.read(s, _archive(s, d)),
    "records_query": lambda s, d: rc.query(s, _archive(s, d), "user:17"),
    "records_sealed_roundtrip": lambda s, d: rc.read(s, _archive(s, d, password=PASSWORD, preset="max_ratio"), PASSWORD),
    "records_sealed_query": lambda s, d: rc.query(s, _archive(s, d, password=PASSWORD), "user:17", PASSWORD),
    "records_verify": lambda s, d: rc.verify(s, _archive(s, d, password=PASSWORD), PASSWORD).agg(F.bool_and("valid").alias("valid"), F.count("*").alias("parts")),
    "dictionary_decode": _typed,
    "encoder_telemetry": lambda s, d: _sized(s, d).select("stream", "blocks", "quarantine_blocks", "core_in_bytes", "core_out_bytes", "quarantine_in_bytes", "quarantine_out_bytes",
                                                          _r("core_ratio").alias("core_ratio"), _r("quarantine_rate").alias("quarantine_rate")),
    "state_checkpoint": lambda s, d: st.checkpoint(mutations(s, d)),
    "checkpoint_due": lambda s, d: st.checkpoint_due(mutations(s, d).withColumn("log", F.substring_index("key", "|", 2)), 10, 5 * 86_400_000),
    "flush_segments": lambda s, d: st.flushed(_logs(s, d), st.flush_points(_logs(s, d), 400, 3)).select("log", "flush", "system", "key", "ts", "lsn"),
    "service_health": lambda s, d: st.service_health(mutations(s, d), 2000),
    "extract_signal": lambda s, d: mutations(s, d).select("lsn", _r(co.signal(F.col("num"), F.col("str"))).alias("signal"),
                                                          F.round(co.signal(F.map_filter("num", lambda k, v: F.lit(False)), F.col("str")), 9).alias("text_signal")),
    "infer_published": lambda s, d: _published(s, d).select("key", "op", _r(F.col("num")["score"]).alias("score"), F.col("str")["recommended_candidate_id"].alias("recommended"), F.col("str")["ranking"].alias("ranking")),
    "infer_defaults": lambda s, d: inf.default_candidates(s, ["compression", "storage", "default"]),
    "infer_seed": lambda s, d: inf.seed(
        outcomes(s, d).groupBy(F.col("domain").alias("scope")).agg(F.create_map(F.lit("n"), F.count("*").cast("double"), F.lit("w"), F.lit(1.0)).alias("values"), F.lit(3).cast("bigint").alias("version")),
        s.createDataFrame([("1-URGENT", {"w": 2.0}, 1), ("2-HIGH", {"z": 5.0}, 9)], "scope string, values map<string,double>, version bigint")).select(
            "scope", F.col("values")["n"].alias("n"), F.col("values")["w"].alias("w"), F.col("values")["z"].alias("z"), "version"),
    "insight_outcomes": lambda s, d: fo.insight_outcomes(_insights(s, d), _verdicts(s, d)),
    "recommendations_of": lambda s, d: fo.chosen(fo.recommendations(fo.labelled(fo.behavior(observations(s, d)))), "investigate_streak").select("key", "type", _r("confidence").alias("confidence")),
    "backpressure": lambda s, d: po.backpressure(_pressure(s, d), 40, 10).select("seq", "pending", "admitted", "active"),
    "retries": lambda s, d: po.retries(_attempts(s, d)).select("op", "attempt", "next", "delay_ms"),
}


def _logs(s, d):
    return mutations(s, d).withColumn("log", F.substring_index("key", "|", 2))


_RECORDS = """x AS (SELECT ts // 3600000 AS ts, key AS item_key, CASE WHEN max(k) % 5 <> 0 THEN round(sum(value), 6) END AS value, max(k)::DOUBLE AS k, max(event_type) AS kind FROM observations GROUP BY 1, 2)"""
_WHOLE = f"WITH {_RECORDS} SELECT * FROM x"
_HOLDING = f"WITH {_RECORDS} SELECT * FROM x WHERE ts IN (SELECT ts FROM x WHERE item_key = 'user:17')"
_S = """s AS (SELECT domain, candidate_id, count(*) AS pulls, count(*) FILTER (result = 'success') AS successes, avg(CASE result WHEN 'success' THEN 1 WHEN 'partial' THEN 0.35 ELSE 0 END) AS f FROM outcomes GROUP BY ALL),
      i AS (SELECT domain, candidate_id, round(0.65 * (successes + 3) / (pulls + 4) + 0.35 * greatest(0, least(1, 0.45 + 0.5 * f)), 12) AS score FROM s),
      r AS (SELECT domain, string_agg(candidate_id, ',' ORDER BY score DESC, candidate_id) AS ranking, max(score) AS score FROM i GROUP BY domain)"""
_JSON = """'{"value":' || CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END || ',"k":' || k::BIGINT || ',"event_type":"' || event_type || '"}'"""
ORACLES = {n: with_views(q) for n, q in {
    "records_roundtrip": _WHOLE, "records_sealed_roundtrip": _WHOLE, "records_query": _HOLDING, "records_sealed_query": _HOLDING,
    "records_verify": "SELECT true AS valid, 3 AS parts",
    "dictionary_decode": "SELECT seq, event_type FROM observations",
    "encoder_telemetry": f"""WITH RECURSIVE {_EVENT_GATE}, {_FOLD}, o AS (SELECT *, floor(320 / greatest(ratio, 0.1))::BIGINT AS b FROM y)
        SELECT stream, count(*) AS blocks, count(*) FILTER (route <> 'CORE') AS quarantine_blocks, count(*) FILTER (route = 'CORE') * 320 AS core_in_bytes, coalesce(sum(b) FILTER (route = 'CORE'), 0)::BIGINT AS core_out_bytes,
          count(*) FILTER (route <> 'CORE') * 320 AS quarantine_in_bytes, coalesce(sum(b) FILTER (route <> 'CORE'), 0)::BIGINT AS quarantine_out_bytes,
          round(coalesce(count(*) FILTER (route = 'CORE') * 320 / sum(b) FILTER (route = 'CORE'), 0), 6) AS core_ratio, round(count(*) FILTER (route <> 'CORE') / count(*), 6) AS quarantine_rate FROM o GROUP BY stream""",
    "state_checkpoint": f"""WITH l AS (SELECT key, unnest(arg_max({{'ts': ts, 'lsn': lsn, 'op': op, 'value': value, 'k': k, 'event_type': event_type}}, {{'a': ts, 'b': lsn}})) FROM mutations GROUP BY key)
        SELECT substr(md5(key), 1, 3) AS bucket, count(*) AS keys, max(lsn) AS max_lsn, sha256(string_agg(key || '|' || ts || '|' || op || '|' || {_JSON}, chr(10) ORDER BY key)) AS hash FROM l GROUP BY 1""",
    "checkpoint_due": """WITH RECURSIVE m AS (SELECT split_part(key, '|', 1) || '|' || split_part(key, '|', 2) AS log, lsn, ts, row_number() OVER (PARTITION BY split_part(key, '|', 2) ORDER BY lsn) AS i FROM mutations),
        f AS (SELECT log, i, lsn, ts, 1::BIGINT AS n, ts AS since, NULL::VARCHAR AS reason FROM m WHERE i = 1 UNION ALL
          SELECT m.log, m.i, m.lsn, m.ts, CASE WHEN due THEN 0 ELSE c END, CASE WHEN due THEN m.ts ELSE since END, CASE WHEN due THEN CASE WHEN c >= 10 THEN 'ops' ELSE 'time' END END
          FROM (SELECT f.log, f.i, f.n + 1 AS c, f.since FROM f) f JOIN m ON m.log = f.log AND m.i = f.i + 1, LATERAL (SELECT c >= 10 OR m.ts - since >= 432000000 AS due))
        SELECT log, lsn, ts, reason FROM f WHERE reason IS NOT NULL""",
    "service_health": """WITH l AS (SELECT key, unnest(arg_max({'op': op, 'tier': tier}, {'a': ts, 'b': lsn})) FROM mutations GROUP BY key)
        SELECT count(*) FILTER (op = 'PUT') AS keys, count(*) FILTER (op = 'PUT' AND tier = 'hot') AS hot, count(*) FILTER (op = 'PUT' AND tier = 'warm') AS warm, count(*) FILTER (op = 'PUT' AND tier = 'cold') AS cold,
          count(*) FILTER (op <> 'PUT') AS tombstones, (SELECT count(*) FROM mutations) AS entries, (SELECT max(lsn) FROM mutations) AS max_lsn, (SELECT max(ts) FROM mutations) AS last_write,
          (SELECT count(*) FROM mutations WHERE lsn > 2000) AS since_checkpoint, CASE WHEN (SELECT count(*) FROM mutations WHERE lsn > 2000) > 10000 THEN 'degraded' ELSE 'ok' END AS status FROM l""",
    "extract_signal": """SELECT lsn, round((value + k) / 2, 6) AS signal, round(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(event_type, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) / 4294967295, 9) AS text_signal FROM mutations""",
    "infer_published": f"""WITH {_S} SELECT '_infer|policy|' || domain AS key, 'PUT' AS op, round(round(score, 9), 6) AS score, split_part(ranking, ',', 1) AS recommended, NULL AS ranking FROM r UNION ALL
        SELECT '_infer|decision|' || substr(sha256(domain || '|' || ranking), 1, 16), 'PUT', NULL, split_part(ranking, ',', 1), ranking FROM r""",
    "insight_outcomes": f"""WITH {_TRACE}, a AS (SELECT seq * 10 AS insight_id, key, round(least(1.0, abs(z) / 5), 6) AS confidence FROM n)
        SELECT o.seq % 10000 * 10 AS insight_id, o.seq, a.key, CASE WHEN a.key IS NOT NULL THEN 'alert' END AS type, a.confidence, o.result, CASE WHEN a.key IS NULL THEN 'unknown insight' END AS error
        FROM outcomes o LEFT JOIN a ON a.insight_id = o.seq % 10000 * 10""",
    "recommendations_of": f"""WITH {_SIGNS}, i AS (SELECT key, sg, island, count(*) AS c, min(back) AS back FROM r GROUP BY ALL), s AS (SELECT key, abs(arg_min(sg * c, back)) AS s FROM i GROUP BY key)
        SELECT key, 'investigate_streak' AS type, round(least(1.0, s / 20), 6) AS confidence FROM s WHERE s >= 5""",
    "flush_segments": f"""WITH RECURSIVE p AS ({_FLUSH.format(log="split_part(key, '|', 1) || '|' || split_part(key, '|', 2)", bytes=400, dirty=3).replace("j AS (SELECT", "(WITH RECURSIVE j AS (SELECT", 1)})),
        b AS (SELECT *, coalesce(lag(lsn) OVER (PARTITION BY log ORDER BY flush), -1) AS low FROM p),
        m AS (SELECT *, split_part(key, '|', 1) || '|' || split_part(key, '|', 2) AS log FROM mutations),
        g AS (SELECT b.log, b.flush, m.key, unnest(arg_max({{'ts': m.ts, 'lsn': m.lsn, 'op': m.op}}, m.lsn)) FROM m JOIN b ON m.log = b.log AND m.lsn > b.low AND m.lsn <= b.lsn GROUP BY b.log, b.flush, m.key)
        SELECT log, flush, false AS system, key, ts, lsn FROM g WHERE op = 'PUT'""",
    "infer_defaults": "SELECT * FROM (VALUES ('compression', 'balanced'), ('compression', 'max_ratio'), ('compression', 'low_latency'), ('storage', 'balanced'), ('storage', 'read_heavy'), ('storage', 'write_heavy')) v(domain, candidate_id)",
    "infer_seed": """SELECT domain AS scope, count(*)::DOUBLE AS n, CASE domain WHEN '1-URGENT' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, CASE domain WHEN '2-HIGH' THEN 5.0 END::DOUBLE AS z,
        CASE domain WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 9 ELSE 3 END AS version FROM outcomes GROUP BY domain""",
    "retries": """SELECT seq AS op, (k % 4 + 1)::INT AS attempt, CASE WHEN event_type NOT IN ('error', 'signup') THEN 'done' WHEN event_type = 'error' AND k % 4 < 2 THEN 'retry' ELSE 'failed' END AS next,
        CASE WHEN event_type = 'error' AND k % 4 < 2 THEN (100 * pow(2, k % 4))::BIGINT ELSE 0 END AS delay_ms FROM observations""",
}.items()}
