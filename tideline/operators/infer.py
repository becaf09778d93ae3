"""Deterministic candidate scoring with outcome feedback.

Outcome rows are (seq, domain, candidate_id, result, latency_ms, cost_score). Statistics
are ordinary partial aggregates; scoring is a join with them and one expression; ranking is
a window over a domain's candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.scalars import clamp, sha256

SUCCESS, HALF, FAILURE = ("success", "ok", "true"), ("partial", "retry"), ("timeout", "error", "fail", "failed")
PRESETS = ("balanced", "max_ratio", "low_latency")


def feedback(result: F.Column) -> F.Column:
    return F.when(result.isin(*SUCCESS), 1.0).when(result.isin(*HALF), 0.35).when(result.isin(*FAILURE), 0.0).otherwise(0.1)


POLICIES = ("balanced", "read_heavy", "write_heavy")


def default_candidates(spark, domains: list[str]) -> DataFrame:
    """(domain, candidate_id): what a domain ranks if a request names none: presets of compression, policies of storage."""
    own = {"compression": PRESETS, "storage": POLICIES}
    return spark.createDataFrame([(d, c) for d in domains for c in own.get(d, ())], "domain string, candidate_id string")


def publish(ranked: DataFrame, ts: F.Column | int, first_lsn: int = 0) -> DataFrame:
    """Ranked candidates as hidden rows of a mutation log: a policy a domain with its best candidate and score,
    and a decision with the ranking. Equal inputs give equal rows; the log's last writer wins."""
    ts = F.lit(ts).cast("bigint") if isinstance(ts, int) else ts
    best = ranked.groupBy("domain").agg(F.min_by(F.struct("candidate_id", "score", "confidence"), "rank").alias("b"), F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))).alias("r"))
    order = F.array_join(F.transform("r", lambda x: x["candidate_id"]), ",")
    policy = best.select("domain", F.concat(F.lit("_infer|policy|"), F.col("domain")).alias("key"), F.create_map(F.lit("score"), "b.score", F.lit("confidence"), "b.confidence").alias("num"),
                         F.create_map(F.lit("recommended_candidate_id"), F.col("b.candidate_id")).alias("str"))
    decision = best.select("domain", F.concat(F.lit("_infer|decision|"), decision_id(F.col("domain"), order)).alias("key"), F.create_map(F.lit("candidates"), F.size("r").cast("double")).alias("num"),
                           F.create_map(F.lit("recommended_candidate_id"), F.col("b.candidate_id"), F.lit("ranking"), order).alias("str"))
    return policy.union(decision).select(F.lit(first_lsn).cast("bigint").alias("lsn"), ts.alias("ts"), F.lit("PUT").alias("op"), "key", "num", "str", F.lit("hot").alias("tier"))


def outcome_stats(rows: DataFrame) -> DataFrame:
    """Per (domain, candidate): successes, failures, and averages over all outcomes, an absent
    metric counting in the divisor as it does in a running average that skips it."""
    n = F.count("*")
    return rows.groupBy("domain", "candidate_id").agg(
        n.alias("pulls"), F.count_if(F.col("result").isin(*SUCCESS)).alias("successes"), F.count_if(~F.col("result").isin(*SUCCESS)).alias("failures"),
        (F.coalesce(F.sum("latency_ms"), F.lit(0.0)) / n).alias("avg_latency"), (F.coalesce(F.sum("cost_score"), F.lit(0.0)) / n).alias("avg_cost"),
        (F.sum(feedback(F.col("result"))) / n).alias("avg_feedback"))


def _bandit() -> F.Column:
    return (F.coalesce("successes", F.lit(0)) + 3) / (F.coalesce("pulls", F.lit(0)) + 4)


def _c(name: str, *defaults) -> F.Column:
    return F.coalesce(F.col(name), *[F.col(d) if isinstance(d, str) else F.lit(float(d)) for d in defaults])


def components(domain: str) -> list[tuple[float, F.Column]]:
    """(weight, component) of a domain's score; columns of the candidate and its statistics."""
    if domain == "provider":
        return [(0.5, _bandit()), (0.3, clamp(1 - _c("latency", "avg_latency", 2500) / 5000)), (0.2, clamp(1 - _c("cost", "avg_cost", 0.5)))]
    if domain == "plan":
        return [(0.35, _bandit()), (0.3, clamp(_c("plan_confidence", 0.5))), (0.2, clamp(1 - _c("risk", 0.5))), (0.15, clamp(1 - _c("cost", "avg_cost", 0.5)))]
    if domain == "compression":
        suggested = F.when(F.col("reads") > F.greatest(F.lit(1), 2 * F.col("writes")), "low_latency").when((F.col("ratio") > 0) & (F.col("ratio") < 20), "max_ratio").otherwise("balanced")
        match = lambda best, mid, low: F.when(F.col("candidate_id") == best, 1.0).when(F.col("candidate_id") == "balanced", mid).otherwise(low)
        fast, tight = suggested == "low_latency", suggested == "max_ratio"
        return [(0.55, _bandit()), (F.when(fast, 0.25).otherwise(0.08), match("low_latency", 0.6, 0.25)), (F.when(tight, 0.25).otherwise(0.12), match("max_ratio", 0.55, 0.25)),
                (0.15, F.when(F.col("candidate_id") == suggested, 1.0).when(F.col("candidate_id") == "balanced", 0.7).otherwise(0.4))]
    if domain == "storage":
        scans, writes = F.col("scans") > F.greatest(F.lit(1), F.col("writes")), F.col("writes") >= F.greatest(F.lit(1), F.col("reads"))
        fit = lambda flag, name: F.when(flag & (F.col("candidate_id") == name), 1.0).when(flag, 0.4).otherwise(0.6)
        return [(0.4, _bandit()), (0.25, fit(scans, "read_heavy")), (0.25, fit(writes, "write_heavy")), (0.1, F.when(F.col("candidate_id") == "balanced", 0.8).otherwise(0.5))]
    return [(0.65, _bandit()), (0.35, clamp(0.45 + 0.5 * _c("avg_feedback", 0)))]


def rank(candidates: DataFrame, stats: DataFrame, domain: str = "default") -> DataFrame:
    """candidates (domain, candidate_id, ...) with score, confidence and rank: highest score
    first, equal ones by id in Unicode order."""
    parts = components(domain)
    joined = candidates.join(stats, ["domain", "candidate_id"], "left")
    weight = lambda w: w if isinstance(w, F.Column) else F.lit(w)
    top, under = F.lit(0.0), F.lit(0.0)
    for w, c in parts:
        top, under = top + weight(w) * c, under + weight(w)
    pulls = F.coalesce(F.col("successes") + F.col("failures"), F.lit(0))
    made = joined.withColumn("score", clamp(top / under)).withColumn(
        "confidence", clamp(F.lit(0.35) + F.least(pulls, F.lit(25)) / 35.0 + 0.15 * F.coalesce("avg_feedback", F.lit(0.0))))
    order = W.partitionBy("domain").orderBy(F.desc(F.round("score", 12)), F.collate("candidate_id", "UNICODE"))
    return made.withColumn("rank", F.row_number().over(order).cast("bigint"))


def scope_profile(ops: DataFrame) -> DataFrame:
    """Operation rows (scope, op, bytes) -> counts by kind and mean payload."""
    kinds = ("write", "read", "scan", "flush")
    return ops.groupBy("scope").agg(*[F.count_if(F.col("op") == k).alias(k + "s" if k != "flush" else "flushes") for k in kinds],
                                    F.avg(F.when(F.col("op") == "write", F.col("bytes"))).alias("avg_payload"))


def linkage(decisions: DataFrame, results: DataFrame) -> DataFrame:
    """Outcomes with their decision if it is known: whether linked, and the lag in seconds."""
    d = decisions.select("decision_id", F.col("ts").alias("decided"))
    return (results.join(d, "decision_id", "left").select(
        "decision_id", "seq", F.col("decided").isNotNull().alias("linked"),
        F.when(F.col("decided").isNotNull(), F.greatest(F.lit(0.0), (F.col("ts") - F.col("decided")) / 1000)).alias("lag_s")))


def preferences(rows: DataFrame) -> DataFrame:
    """The candidate of each domain's latest success."""
    return rows.filter(F.col("result").isin(*SUCCESS)).groupBy("domain").agg(F.max_by("candidate_id", F.struct("ts", "seq")).alias("preferred"))


def decision_id(*parts: F.Column) -> F.Column:
    """The first 16 hex digits of a hash over the request and an explicit instant."""
    return F.substring(sha256(*parts), 1, 16)


def seed(profiles: DataFrame, seeds: DataFrame) -> DataFrame:
    """Profiles (scope, values map, version) overlaid with seeds: the version grows at least by one."""
    s = seeds.select("scope", F.col("values").alias("_v"), F.col("version").alias("_n"))
    merged = F.map_filter("values", lambda k, v: ~F.coalesce(F.map_contains_key("_v", k), F.lit(False)))
    return profiles.join(s, "scope", "left").select(
        "scope", F.when(F.col("_v").isNull(), F.col("values")).otherwise(F.map_concat(merged, "_v")).alias("values"),
        F.when(F.col("_n").isNull(), F.col("version")).otherwise(F.greatest(F.col("version") + 1, F.col("_n"))).alias("version"))


def recent(decisions: DataFrame, policies: DataFrame, most: int) -> DataFrame:
    """The newest decisions and half as many newest policies, newest first."""
    a = decisions.orderBy(F.desc("ts"), F.desc("id")).limit(most)
    b = policies.orderBy(F.desc("ts"), F.desc("id")).limit(most // 2)
    return a.select(F.lit("decision").alias("kind"), "id", "ts").union(b.select(F.lit("policy"), "id", "ts")).orderBy(F.desc("ts"), "kind", "id")
