"""Queries over the mutation log and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import state as st
from tideline.sources.views import DAY_MS, mutations, with_views

_LATEST = """l AS (SELECT key, unnest(arg_max({'ts': ts, 'lsn': lsn, 'op': op, 'value': value, 'k': k, 'event_type': event_type, 'tier': tier},
        {'a': ts, 'b': lsn})) FROM mutations GROUP BY key), c AS (SELECT * FROM l WHERE op = 'PUT')"""


def _state(s, d):
    return st.current(mutations(s, d))


def _flat(df):
    return df.select("key", "ts", "lsn", "tier", F.col("num")["value"].alias("value"), F.col("num")["k"].alias("k"), F.col("str")["event_type"].alias("event_type"))


def _segments(s, d):
    return mutations(s, d).filter("tier = 'warm'").withColumn("segment", F.floor(F.col("lsn") / 500).cast("bigint"))


def _rotation(s, d):
    segs = _segments(s, d).groupBy("segment").agg(F.max("ts").alias("newest"), F.count("*").alias("n"))
    now = segs.agg(F.max("newest").alias("now"))
    return st.rotate(segs.crossJoin(F.broadcast(now)), F.col("now"), 5 * DAY_MS, 12 * DAY_MS).drop("now")


def _requests(s, d):
    """The batches sent twice under keys that collide: some retries are true, some changed."""
    b = st.batches(mutations(s, d))
    again = b.select((F.col("batch") % 400).alias("idempotency_key"), (F.col("batch") + 1_000_000).alias("seq"), "request_hash")
    once = b.select((F.col("batch") % 400).alias("idempotency_key"), F.col("batch").alias("seq"), "request_hash")
    return st.admit(once.union(again))


_B = """b AS (SELECT lsn // 10 AS batch, count(*) AS n, sha256(string_agg(lsn || '|' || op || '|' || key, chr(10) ORDER BY lsn)) AS request_hash FROM mutations GROUP BY 1)"""
_SEG = "s AS (SELECT *, lsn // 500 AS segment FROM mutations WHERE tier = 'warm')"

QUERIES = {
    "state_scan_summary": lambda s, d: st.scan_summary(_state(s, d).withColumn("prefix", F.substring_index("key", "|", 2)), "prefix"),
    "state_current": lambda s, d: _flat(_state(s, d)),
    "state_scan_page": lambda s, d: _flat(st.scan(_state(s, d), "u|1", limit=100)),
    "state_scan_cursor": lambda s, d: _flat(st.scan(_state(s, d), "u|", tiers=("hot", "warm"), cursor="u|12|1", limit=50)),
    "state_count_prefix": lambda s, d: st.count_prefix(_state(s, d), "u|2"),
    "state_latest_by_prefix": lambda s, d: st.latest_by_prefix(_state(s, d), "u|3"),
    "state_tier_stats": lambda s, d: _state(s, d).groupBy("tier").agg(F.count("*").alias("n")),
    "state_get": lambda s, d: _flat(st.get(mutations(s, d), "u|7|2")),
    "state_deleted_keys": lambda s, d: st.latest(mutations(s, d)).filter("op = 'DELETE'").select("key", "ts", "lsn"),
    "state_tombstones": lambda s, d: st.tombstones(mutations(s, d)),
    "state_schema": lambda s, d: st.infer_schema(_state(s, d)),
    "state_remap_tiers": lambda s, d: st.remap(_state(s, d), s.createDataFrame([("warm", "archive")], "tier string, new_tier string")).groupBy("tier").agg(F.count("*").alias("n")),
    "putmany_dedup": lambda s, d: _requests(s, d).groupBy("outcome").agg(F.count("*").alias("n")),
    "putmany_conflicts": lambda s, d: _requests(s, d).filter("outcome = 'conflict'").select("idempotency_key", "seq", "request_hash"),
    "wal_replay_from_checkpoint": lambda s, d: _flat(st.replay(mutations(s, d), 2000)),
    "compaction_result": lambda s, d: st.compact(_segments(s, d)).select("key", "ts", "lsn", "op", "versions", "segments"),
    "rotation_plan": _rotation,
    "flush_points": lambda s, d: st.flush_points(mutations(s, d).withColumn("log", F.substring_index("key", "|", 2)), 400, 3),
    "degraded_buffer_resolution": lambda s, d: st.resolve_buffer(mutations(s, d).filter("lsn % 2 = 0"), mutations(s, d).filter("lsn % 2 <> 0")),
}
_C = f"WITH {_LATEST} "
#: The buffer as a list of (key, size), a write of every log a step.
_FLUSH = """j AS (SELECT {log} AS log, lsn, op, key, strlen(key) + 32 + strlen('{{"value":' || CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END
          || ',"k":' || k::BIGINT || ',"event_type":"' || event_type || '"}}') AS size FROM mutations),
      n AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY lsn) AS i FROM j),
      f AS (SELECT DISTINCT log, 0::BIGINT AS i, NULL::BIGINT AS lsn, 0::BIGINT AS flush, NULL::VARCHAR AS reason, 0::BIGINT AS bytes, 0::BIGINT AS records, []::STRUCT(key VARCHAR, size BIGINT)[] AS held FROM n
        UNION ALL
        SELECT log, i, lsn, flush + (reason IS NOT NULL)::INT, reason, bytes, records, CASE WHEN reason IS NULL THEN held ELSE [] END FROM (
          SELECT *, CASE WHEN op <> 'PUT' THEN NULL WHEN bytes > {bytes} THEN 'size' WHEN records > {dirty} THEN 'dirty' END AS reason FROM (
            SELECT *, coalesce(list_sum(list_transform(held, lambda x: x.size)), 0)::BIGINT AS bytes, len(held) AS records FROM (
              SELECT n.log, n.i, n.lsn, n.op, f.flush, list_concat(list_filter(f.held, lambda x: x.key <> n.key), CASE WHEN n.op = 'PUT' THEN [{{'key': n.key, 'size': n.size::BIGINT}}] ELSE [] END) AS held
              FROM f JOIN n ON f.log = n.log AND n.i = f.i + 1))))
      SELECT log, flush, lsn, reason, bytes, records FROM f WHERE reason IS NOT NULL"""
ORACLES = {n: with_views(q) for n, q in {
    "state_scan_summary": _C + """SELECT split_part(key, '|', 1) || '|' || split_part(key, '|', 2) AS prefix, count(*) AS n, min(ts) AS oldest, max(ts) AS newest,
        arg_max(key, {'a': ts, 'b': key COLLATE "en"}) AS latest_key, count(*) FILTER (tier = 'hot') AS hot, count(*) FILTER (tier = 'warm') AS warm,
        count(*) FILTER (tier = 'cold') AS cold FROM c GROUP BY 1""",
    "state_current": _C + "SELECT key, ts, lsn, tier, value, k, event_type FROM c",
    "state_scan_page": _C + "SELECT key, ts, lsn, tier, value, k, event_type FROM c WHERE starts_with(key, 'u|1') ORDER BY key COLLATE \"en\" LIMIT 100",
    "state_scan_cursor": _C + """SELECT key, ts, lsn, tier, value, k, event_type FROM c WHERE tier IN ('hot', 'warm') AND key COLLATE "en" > 'u|12|1'
        ORDER BY key COLLATE "en" LIMIT 50""",
    "state_count_prefix": _C + "SELECT count(*) AS n FROM c WHERE starts_with(key, 'u|2')",
    "state_latest_by_prefix": _C + "SELECT key, ts, tier FROM c WHERE starts_with(key, 'u|3') ORDER BY ts DESC, key DESC LIMIT 1",
    "state_tier_stats": _C + "SELECT tier, count(*) AS n FROM c GROUP BY tier",
    "state_get": _C + "SELECT key, ts, lsn, tier, value, k, event_type FROM c WHERE key = 'u|7|2'",
    "state_deleted_keys": _C + "SELECT key, ts, lsn FROM l WHERE op = 'DELETE'",
    "state_tombstones": _C + "SELECT '_sys|tombstone|' || replace(key, '|', '%7C') AS key, ts, lsn FROM l WHERE op = 'DELETE'",
    "state_schema": _C + "SELECT f[1] AS field, f[2] AS kind, count(*) AS keys FROM (SELECT unnest([['value', 'numeric'], ['k', 'numeric'], ['event_type', 'categorical']]) AS f FROM c) GROUP BY ALL",
    "state_remap_tiers": _C + "SELECT CASE tier WHEN 'warm' THEN 'archive' ELSE tier END AS tier, count(*) AS n FROM c GROUP BY 1",
    "putmany_dedup": f"""WITH {_B}, r AS (SELECT batch % 400 AS idempotency_key, batch AS seq, request_hash FROM b UNION ALL SELECT batch % 400, batch + 1000000, request_hash FROM b),
        o AS (SELECT *, CASE WHEN seq = min(seq) OVER w THEN 'applied' WHEN request_hash = first_value(request_hash) OVER (w ORDER BY seq) THEN 'deduplicated' ELSE 'conflict' END AS outcome
        FROM r WINDOW w AS (PARTITION BY idempotency_key)) SELECT outcome, count(*) AS n FROM o GROUP BY outcome""",
    "putmany_conflicts": f"""WITH {_B}, r AS (SELECT batch % 400 AS idempotency_key, batch AS seq, request_hash FROM b UNION ALL SELECT batch % 400, batch + 1000000, request_hash FROM b)
        SELECT idempotency_key, seq, request_hash FROM (SELECT *, first_value(request_hash) OVER (PARTITION BY idempotency_key ORDER BY seq) AS h FROM r) WHERE h <> request_hash""",
    "wal_replay_from_checkpoint": _C + "SELECT key, ts, lsn, tier, value, k, event_type FROM c",
    "compaction_result": f"""WITH {_SEG} SELECT key, unnest(arg_max({{'ts': ts, 'lsn': lsn, 'op': op}}, {{'a': ts, 'b': lsn}})), count(*) AS versions, count(DISTINCT segment) AS segments
        FROM s GROUP BY key""",
    "rotation_plan": f"""WITH {_SEG}, g AS (SELECT segment, max(ts) AS newest, count(*) AS n FROM s GROUP BY 1), h AS (SELECT *, max(newest) OVER () - newest AS age FROM g)
        SELECT segment, newest, n, CASE WHEN age > {12 * DAY_MS} THEN 'expire' WHEN age > {5 * DAY_MS} THEN 'to_cold' ELSE 'keep' END AS action FROM h""",
    "flush_points": f"WITH RECURSIVE {_FLUSH.format(log="split_part(key, '|', 1) || '|' || split_part(key, '|', 2)", bytes=400, dirty=3)}",
    "degraded_buffer_resolution": """SELECT b.key, b.lsn, b.ts, CASE WHEN k.key IS NULL THEN 'applied' ELSE 'discarded' END AS outcome
        FROM mutations b LEFT JOIN (SELECT DISTINCT key FROM mutations WHERE lsn % 2 <> 0) k ON b.key = k.key WHERE b.lsn % 2 = 0""",
}.items()}
