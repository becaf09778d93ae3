"""Inference, audit, retention, telemetry and session queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import infer as inf
from tideline.operators import ledger as le

from tideline.sources.views import DAY_MS, PROMPT_EPOCH, mutations, observations, outcomes, prompts, snapshots, with_views


def _r(c):
    return F.round(c, 6)


def _stats(s, d):
    return inf.outcome_stats(outcomes(s, d))


def _candidates(s, d, *extra):
    """A domain's seven candidates, with made-up but fixed request features."""
    i = F.substring("candidate_id", 2, 2).cast("double")
    return _stats(s, d).select("domain", "candidate_id", *[e(i).alias(n) for n, e in extra])


def _ranked(domain, *extra):
    return lambda s, d: inf.rank(_candidates(s, d, *extra), _stats(s, d), domain).select("domain", "candidate_id", _r("score").alias("score"), _r("confidence").alias("confidence"), "rank")


def _presets(s, d, names, domain, features):
    stats = _stats(s, d).withColumn("candidate_id", F.element_at(F.array(*map(F.lit, names)), (F.substring("candidate_id", 2, 2).cast("int") % len(names)) + 1))
    stats = stats.groupBy("domain", "candidate_id").agg(*[F.sum(c).alias(c) for c in ("pulls", "successes", "failures")], *[F.avg(c).alias(c) for c in ("avg_latency", "avg_cost", "avg_feedback")])
    rows = stats.select("domain", "candidate_id", *[F.lit(v).alias(n) for n, v in features.items()])
    return inf.rank(rows, stats, domain).select("domain", "candidate_id", _r("score").alias("score"), "rank")


def _audit(s, d):
    return mutations(s, d).select(F.substring_index("key", "|", 2).alias("log"), F.col("lsn").alias("seq"), "ts", F.lit("svc").alias("actor"), F.col("op").alias("action"),
                                  F.col("key").alias("target"), F.concat(F.lit("v="), F.col("num")["k"].cast("bigint").cast("string")).alias("payload"))


def _tampered(s, d):
    """The chain with every 97th payload changed and every 89th entry cut."""
    c = le.chain(_audit(s, d))
    return c.filter("seq % 89 <> 0").withColumn("payload", F.when(F.col("seq") % 97 == 0, "v=forged").otherwise(F.col("payload")))


def _verdict(df):
    return df.select("log", "total", F.array_join(F.transform("corrupted", lambda x: x.cast("string")), ",").alias("corrupted"), "chain_broken", "valid")


def _merkle(s, d):
    return le.merkle(mutations(s, d).select(F.lit("all").alias("log"), (F.col("lsn") - F.lit(0)).alias("i"), F.sha2(F.concat_ws("|", F.col("lsn").cast("string"), "key"), 256).alias("hash")), 8)


def _retained(s, d):
    return le.retain(prompts(s, d), PROMPT_EPOCH)


def _ops(s, d):
    m = observations(s, d)
    op = F.when(F.col("event_type").isin("purchase", "signup"), "write").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "scan").otherwise("flush")
    return m.select(F.col("key").alias("scope"), op.alias("op"), F.col("k").alias("bytes"))


def _decisions(s, d):
    return outcomes(s, d).filter("seq % 3 <> 0").select(F.col("seq").alias("decision_id"), (F.col("ts") - F.col("seq") % 5 * 1000).alias("ts"))


def _points(s, d):
    return observations(s, d).select(F.lit("value").alias("name"), F.col("event_type").alias("label"), F.col("k").cast("double").alias("value"), "ts", "seq")


def _session(s, d):
    """Monthly parts of the snapshots as a manifest; month 30's link is broken by hand."""
    w = snapshots(s, d).groupBy(F.floor(F.col("ts") / 2592000).cast("bigint").alias("seq")).agg(F.count("*").alias("n"))
    own = le.part_hash(F.col("seq").cast("string"), F.col("n").cast("string"))
    from pyspark.sql import Window as W
    start = F.lag(own, 1, le.ZERO_HASH).over(W.orderBy("seq"))
    first = F.min("seq").over(W.partitionBy(F.lit(1)))
    return w.select(F.lit("s").alias("session"), "seq", "n", F.when(F.col("seq") - first == 30, F.lit("x")).otherwise(start).alias("start_hash"), own.alias("end_hash"))


QUERIES = {
    "outcome_stats": lambda s, d: _stats(s, d).select("domain", "candidate_id", "pulls", "successes", "failures", _r("avg_latency").alias("avg_latency"), _r("avg_cost").alias("avg_cost"), _r("avg_feedback").alias("avg_feedback")),
    "feedback_scores": lambda s, d: outcomes(s, d).select("seq", inf.feedback(F.col("result")).alias("score")),
    "infer_default": _ranked("default"),
    "infer_provider": _ranked("provider", ("latency", lambda i: F.when(i < 4, i * 400)), ("cost", lambda i: F.when(i > 1, i / 10))),
    "infer_plan": _ranked("plan", ("plan_confidence", lambda i: i / 7), ("risk", lambda i: 1 - i / 8), ("cost", lambda i: F.when(i < 5, i / 9))),
    "infer_compression": lambda s, d: _presets(s, d, inf.PRESETS, "compression", {"reads": 10, "writes": 3, "ratio": 12.0}),
    "infer_storage": lambda s, d: _presets(s, d, ("balanced", "read_heavy", "write_heavy"), "storage", {"reads": 10, "writes": 3, "scans": 7}),
    "infer_preferences": lambda s, d: inf.preferences(outcomes(s, d)),
    "infer_recommendations": lambda s, d: inf.recent(outcomes(s, d).filter("seq % 2 = 0").select(F.col("seq").alias("id"), "ts"), outcomes(s, d).filter("seq % 2 = 1").select(F.col("seq").alias("id"), "ts"), 20),
    "decision_ids": lambda s, d: outcomes(s, d).select("seq", inf.decision_id(F.col("domain"), F.col("candidate_id"), F.col("ts").cast("string")).alias("decision_id")),
    "scope_profile": lambda s, d: inf.scope_profile(_ops(s, d)).select("scope", "writes", "reads", "scans", "flushes", _r("avg_payload").alias("avg_payload")),
    "outcome_linkage": lambda s, d: inf.linkage(_decisions(s, d), outcomes(s, d).select(F.col("seq").alias("decision_id"), "seq", "ts")),
    "audit_chain": lambda s, d: le.chain(_audit(s, d)).select("log", "seq", "prev_hash", "hash"),
    "audit_verify": lambda s, d: _verdict(le.verify(le.chain(_audit(s, d)))),
    "audit_tampered": lambda s, d: _verdict(le.verify(_tampered(s, d))),
    "merkle_checkpoints": _merkle,
    "retention_tiers": lambda s, d: le.tier_stats(_retained(s, d)),
    "retention_distilled": lambda s, d: _retained(s, d).filter("tier = 'distilled'").select("key", "ts", "content", "content_hash", "token_count"),
    "retention_weekly": lambda s, d: le.weekly(_retained(s, d).filter("tier = 'distilled'")),
    "retention_emergency": lambda s, d: le.purge(prompts(s, d), F.lit(PROMPT_EPOCH), 60_000),
    "retention_retrieve": lambda s, d: le.retrieve(_retained(s, d), "c|7|1"),
    "telemetry_counters": lambda s, d: le.counters(_points(s, d)),
    "telemetry_gauges": lambda s, d: le.gauges(_points(s, d)),
    "telemetry_histogram": lambda s, d: le.histograms(_points(s, d), (1, 5, 10, 25, 50, 100)).select("name", "label", "n", "total", "low", "high", F.explode("buckets").alias("b")).select("name", "label", "n", "total", "low", "high", "b.le", F.col("b.n").alias("le_n")),
    "event_ring": lambda s, d: le.ring(observations(s, d).select("seq", F.col("event_type").alias("kind"), "key"), 512, "error", 40),
    "error_slugs": lambda s, d: observations(s, d).select(le.slug(F.concat_ws(" / ", F.upper("event_type"), F.lit("Code"), (F.col("k") % 3).cast("string"))).alias("slug")).groupBy("slug").agg(F.count("*").alias("n")),
    "session_chain_check": lambda s, d: le.session_check(_session(s, d)).select("session", "seq", "linked"),
    "session_orphans": lambda s, d: le.session_check(_session(s, d)).filter("orphaned").select("session", "seq", "n"),
}

_S = """s AS (SELECT domain, candidate_id, count(*) AS pulls, count(*) FILTER (result = 'success') AS successes, count(*) FILTER (result <> 'success') AS failures,
      sum(latency_ms) / count(*) AS avg_latency, sum(cost_score) / count(*) AS avg_cost, avg(CASE result WHEN 'success' THEN 1 WHEN 'partial' THEN 0.35 ELSE 0 END) AS avg_feedback FROM outcomes GROUP BY ALL),
      i AS (SELECT *, substr(candidate_id, 2)::DOUBLE AS i, (successes + 3) / (pulls + 4) AS bandit, greatest(0, least(1, 0.35 + least(pulls, 25) / 35 + 0.15 * avg_feedback)) AS confidence FROM s)"""


def _rank(score, source="i"):
    return f"""q AS (SELECT *, greatest(0, least(1, {score})) AS score FROM {source}) SELECT domain, candidate_id, round(score, 6) AS score, round(confidence, 6) AS confidence,
        row_number() OVER (PARTITION BY domain ORDER BY round(score, 12) DESC, candidate_id) AS rank FROM q"""


def _preset(names, score):
    pick = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names))
    return f"""WITH {_S}, p AS (SELECT domain, CASE i::INT % {len(names)} {pick} END AS candidate_id, sum(pulls) AS pulls, sum(successes) AS successes FROM i GROUP BY ALL),
        q AS (SELECT *, (successes + 3) / (pulls + 4) AS bandit FROM p), z AS (SELECT *, {score} AS score FROM q)
        SELECT domain, candidate_id, round(score, 6) AS score, row_number() OVER (PARTITION BY domain ORDER BY round(score, 12) DESC, candidate_id) AS rank FROM z"""


_A = """a AS (SELECT split_part(key, '|', 1) || '|' || split_part(key, '|', 2) AS log, lsn AS seq, lsn || '|' || ts || '|svc|' || op || '|' || key || '|v=' || k::BIGINT AS line FROM mutations),
      l AS (SELECT *, list(line) OVER (PARTITION BY log ORDER BY seq ROWS UNBOUNDED PRECEDING) AS lines FROM a),
      h AS (SELECT log, seq, line, list_reduce(list_prepend(repeat('0', 64), lines), lambda x, y: sha256(y || '|' || x)) AS hash FROM l),
      c AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY log ORDER BY seq), repeat('0', 64)) AS prev_hash FROM h)"""
_T = f"""t AS (SELECT *, {PROMPT_EPOCH} - ts AS age, sha256(content) AS content_hash, strlen(content) AS b, CASE WHEN {PROMPT_EPOCH} - ts >= {30 * DAY_MS} THEN 'distilled' WHEN {PROMPT_EPOCH} - ts >= {7 * DAY_MS} THEN 'compressed' ELSE 'raw' END AS tier FROM prompts)"""
_SESSION = """p AS (SELECT ts // 2592000 AS seq, count(*) AS n FROM snapshots GROUP BY 1), e AS (SELECT *, sha256(seq || '|' || n) AS end_hash, seq - min(seq) OVER () AS k FROM p),
      c AS (SELECT 's' AS session, seq, n, k <> 30 AS linked FROM e)"""
ORACLES = {n: with_views(q) for n, q in {
    "outcome_stats": f"WITH {_S} SELECT domain, candidate_id, pulls, successes, failures, round(avg_latency, 6) AS avg_latency, round(avg_cost, 6) AS avg_cost, round(avg_feedback, 6) AS avg_feedback FROM s",
    "feedback_scores": "SELECT seq, CASE result WHEN 'success' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS score FROM outcomes",
    "infer_default": f"WITH {_S}, " + _rank("0.65 * bandit + 0.35 * greatest(0, least(1, 0.45 + 0.5 * avg_feedback))"),
    "infer_provider": f"WITH {_S}, " + _rank("""0.5 * bandit + 0.3 * greatest(0, least(1, 1 - coalesce(CASE WHEN i < 4 THEN i * 400 END, avg_latency) / 5000))
        + 0.2 * greatest(0, least(1, 1 - coalesce(CASE WHEN i > 1 THEN i / 10 END, avg_cost)))"""),
    "infer_plan": f"WITH {_S}, " + _rank("0.35 * bandit + 0.3 * i / 7 + 0.2 * (i / 8) + 0.15 * greatest(0, least(1, 1 - coalesce(CASE WHEN i < 5 THEN i / 9 END, avg_cost)))"),
    "infer_compression": _preset(inf.PRESETS, """(0.55 * bandit + 0.25 * CASE candidate_id WHEN 'low_latency' THEN 1 WHEN 'balanced' THEN 0.6 ELSE 0.25 END
        + 0.12 * CASE candidate_id WHEN 'max_ratio' THEN 1 WHEN 'balanced' THEN 0.55 ELSE 0.25 END + 0.15 * CASE candidate_id WHEN 'low_latency' THEN 1 WHEN 'balanced' THEN 0.7 ELSE 0.4 END) / 1.07"""),
    "infer_storage": _preset(("balanced", "read_heavy", "write_heavy"), """0.4 * bandit + 0.25 * CASE candidate_id WHEN 'read_heavy' THEN 1 ELSE 0.4 END + 0.25 * 0.6
        + 0.1 * CASE candidate_id WHEN 'balanced' THEN 0.8 ELSE 0.5 END"""),
    "infer_preferences": "SELECT domain, arg_max(candidate_id, {'a': ts, 'b': seq}) AS preferred FROM outcomes WHERE result = 'success' GROUP BY domain",
    "infer_recommendations": """WITH a AS (SELECT 'decision' AS kind, seq AS id, ts FROM outcomes WHERE seq % 2 = 0 ORDER BY ts DESC, seq DESC LIMIT 20),
        b AS (SELECT 'policy' AS kind, seq AS id, ts FROM outcomes WHERE seq % 2 = 1 ORDER BY ts DESC, seq DESC LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b""",
    "decision_ids": "SELECT seq, substr(sha256(domain || '|' || candidate_id || '|' || ts), 1, 16) AS decision_id FROM outcomes",
    "scope_profile": """SELECT key AS scope, count(*) FILTER (event_type IN ('purchase', 'signup')) AS writes, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type = 'click') AS scans,
        count(*) FILTER (event_type = 'error') AS flushes, round(avg(k) FILTER (event_type IN ('purchase', 'signup')), 6) AS avg_payload FROM observations GROUP BY key""",
    "outcome_linkage": "SELECT seq AS decision_id, seq, seq % 3 <> 0 AS linked, CASE WHEN seq % 3 <> 0 THEN (seq % 5)::DOUBLE END AS lag_s FROM outcomes",
    "audit_chain": f"WITH {_A} SELECT log, seq, prev_hash, hash FROM c",
    "audit_verify": f"WITH {_A} SELECT log, count(*) AS total, '' AS corrupted, false AS chain_broken, true AS valid FROM c GROUP BY log",
    "audit_tampered": f"""WITH {_A}, k AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY log ORDER BY seq), repeat('0', 64)) <> prev_hash AS broken FROM c WHERE seq % 89 <> 0)
        SELECT log, count(*) AS total, coalesce(string_agg(seq::VARCHAR, ',' ORDER BY seq) FILTER (seq % 97 = 0), '') AS corrupted, bool_or(broken) AS chain_broken,
          count(*) FILTER (seq % 97 = 0) = 0 AND NOT bool_or(broken) AS valid FROM k GROUP BY log""",
    "merkle_checkpoints": """WITH x AS (SELECT lsn // 8 AS run, list(sha256(lsn || '|' || key) ORDER BY lsn) AS h FROM mutations GROUP BY 1 HAVING count(*) = 8)
        SELECT 'all' AS log, run, sha256(sha256(sha256(h[1] || h[2]) || sha256(h[3] || h[4])) || sha256(sha256(h[5] || h[6]) || sha256(h[7] || h[8]))) AS root FROM x""",
    "retention_tiers": f"WITH {_T} SELECT tier, count(*) AS n, sum(CASE WHEN tier = 'distilled' THEN 64 ELSE b END)::BIGINT AS bytes, min(ts) AS oldest, max(ts) AS newest FROM t GROUP BY tier",
    "retention_distilled": f"WITH {_T} SELECT key, ts, NULL AS content, content_hash, token_count FROM t WHERE tier = 'distilled'",
    "retention_weekly": f"WITH {_T} SELECT ts // {7 * DAY_MS} AS week, task, count(*) AS n, sum(token_count)::BIGINT AS tokens, min(ts) AS first, max(ts) AS last FROM t WHERE tier = 'distilled' GROUP BY 1, 2 HAVING count(*) > 1",
    "retention_emergency": f"""WITH {_T}, p AS (SELECT *, CASE WHEN tier = 'raw' AND age > {3 * DAY_MS} THEN 1 WHEN tier = 'compressed' AND age > {15 * DAY_MS} THEN 2 END AS step FROM t),
        f AS (SELECT *, (SELECT sum(b) FROM t) - coalesce(sum(b) OVER (ORDER BY step, ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM p WHERE step IS NOT NULL)
        SELECT key, ts, tier, b AS bytes, step FROM f WHERE rest >= 54000""",
    "retention_retrieve": f"WITH {_T} SELECT key, ts, tier, content_hash FROM t WHERE key = 'c|7|1'",
    "telemetry_counters": "SELECT 'value' AS name, event_type AS label, sum(k)::DOUBLE AS total, count(*) AS n FROM observations GROUP BY event_type",
    "telemetry_gauges": "SELECT 'value' AS name, event_type AS label, arg_max(k::DOUBLE, {'a': ts, 'b': seq}) AS last FROM observations GROUP BY event_type",
    "telemetry_histogram": """SELECT 'value' AS name, event_type AS label, count(*) AS n, sum(k)::DOUBLE AS total, min(k)::DOUBLE AS low, max(k)::DOUBLE AS high, le::DOUBLE AS le,
        count(*) FILTER (k <= le) AS le_n FROM observations, (VALUES (1), (5), (10), (25), (50), (100)) b(le) GROUP BY event_type, le""",
    "event_ring": "SELECT seq, event_type AS kind, key FROM (SELECT * FROM observations ORDER BY seq DESC LIMIT 512) WHERE event_type = 'error' ORDER BY seq DESC LIMIT 40",
    "error_slugs": "SELECT event_type || '_code_' || (k % 3) AS slug, count(*) AS n FROM observations GROUP BY 1",
    "session_chain_check": f"WITH {_SESSION} SELECT session, seq, linked FROM c",
    "session_orphans": f"WITH {_SESSION} SELECT session, seq, n FROM c WHERE seq >= (SELECT min(seq) FROM c WHERE NOT linked)",
}.items()}
