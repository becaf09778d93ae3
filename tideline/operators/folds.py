"""Ordered per-key folds over observations (key, ts ms, seq, value, k).

``behavior`` folds each key's writes in order of (ts, seq) with one JVM ``aggregate`` over
a sorted array: one shuffle, no Python. ``trace`` gives the state after every write, for
anomalies and label changes, by an Arrow function per key that runs in linear time.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.scalars import clamp

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
ALPHA, TREND = 0.35, 0.3
HIGH, LOW, DORMANT_MS, DEAD_MS = 0.5, 0.05, 7 * DAY_MS, 30 * DAY_MS
SIGNS = 32


def lifecycle(velocity: F.Column, writes: F.Column, idle_ms: F.Column) -> F.Column:
    """The label at evaluation time."""
    return (F.when(idle_ms > DEAD_MS, "dead").when(idle_ms > DORMANT_MS, "dormant")
            .when(velocity > HIGH, F.when(writes < 10, "emerging").otherwise("active"))
            .when(velocity < LOW, "declining").otherwise("stable"))


def ordered(obs: DataFrame) -> DataFrame:
    """(key, items): the writes of each key in order."""
    item = F.struct("ts", "seq", "value", F.col("k").cast("double").alias("k"))
    return obs.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _double(x) -> F.Column:
    return F.lit(float(x))


def behavior(obs: DataFrame) -> DataFrame:
    """One row per key: velocity, volatility, the fields' trend statistics, streak and signs.

    velocity: 1 at the first write, then .35 * (hours^-1) + .65 * previous, an interval
    counting at least 1 ms. volatility: sample deviation of intervals. Per field: EMA with
    .3, mean, sample deviation, z of the last value, min, max. streak: run of equal signs of
    the summed field changes, zeros leaving it; signs: the last 32 non-zero ones."""
    first = F.element_at("items", 1)

    def field(x):
        v = x.cast("double")
        return F.struct(v.alias("last"), v.alias("ema"), v.alias("mean"), _double(0).alias("m2"), v.alias("min"), v.alias("max"))

    zero = F.struct(
        first["ts"].alias("ts"), _double(1).alias("velocity"), F.lit(1).cast("bigint").alias("n"), _double(0).alias("dt_mean"), _double(0).alias("dt_m2"),
        field(first["value"]).alias("value"), field(first["k"]).alias("k"), F.lit(0).cast("bigint").alias("streak"), F.lit(0).cast("bigint").alias("record"),
        F.expr("CAST(array() AS array<int>)").alias("signs"))

    def moved(f, x, n):
        mean = f["mean"] + (x - f["mean"]) / n
        return F.struct(x.alias("last"), (F.lit(TREND) * x + F.lit(1 - TREND) * f["ema"]).alias("ema"), mean.alias("mean"),
                        (f["m2"] + (x - f["mean"]) * (x - mean)).alias("m2"), F.least(f["min"], x).alias("min"), F.greatest(f["max"], x).alias("max"))

    def step(a, x):
        dt = F.greatest(F.lit(1).cast("bigint"), x["ts"] - a["ts"]).cast("double")
        n = (a["n"] + 1).cast("double")
        mean = a["dt_mean"] + (dt - a["dt_mean"]) / a["n"]
        delta = (x["value"] - a["value"]["last"]) + (x["k"] - a["k"]["last"])
        sign = F.signum(delta).cast("int")
        run = F.when(sign == 0, a["streak"]).when(F.signum(a["streak"]) == sign, a["streak"] + sign).otherwise(sign).cast("bigint")
        signs = F.when(sign == 0, a["signs"]).otherwise(F.slice(F.array_append(a["signs"], sign), F.greatest(F.lit(1), F.size(a["signs"]) + 2 - SIGNS), F.lit(SIGNS)))
        return F.struct(
            x["ts"].alias("ts"), (F.lit(ALPHA) * (F.lit(float(HOUR_MS)) / dt) + F.lit(1 - ALPHA) * a["velocity"]).alias("velocity"), (a["n"] + 1).alias("n"),
            mean.alias("dt_mean"), (a["dt_m2"] + (dt - a["dt_mean"]) * (dt - mean)).alias("dt_m2"),
            moved(a["value"], x["value"], n).alias("value"), moved(a["k"], x["k"], n).alias("k"), run.alias("streak"),
            F.greatest(a["record"], F.abs(run)).alias("record"), signs.alias("signs"))

    rest = F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0)))
    s = ordered(obs).select("key", F.aggregate(rest, zero, step).alias("s"))

    def trend(name):
        f = F.col("s")[name]
        deviation = F.when(F.col("s.n") > 1, F.sqrt(f["m2"] / (F.col("s.n") - 1))).otherwise(0.0)
        spread = f["max"] - f["min"]
        return F.struct(
            f["last"].alias("last"), f["ema"].alias("ema"), f["mean"].alias("mean"), deviation.alias("deviation"),
            F.when(deviation > 0, (f["last"] - f["mean"]) / deviation).otherwise(0.0).alias("z"), f["min"].alias("min"), f["max"].alias("max"),
            F.when(spread > 0, F.abs(f["last"] - f["ema"]) / spread).otherwise(0.0).alias("magnitude"),
            F.when(f["last"] > f["ema"] * 1.005, "up").when(f["last"] < f["ema"] * 0.995, "down").otherwise("flat").alias("direction")).alias(name)

    up = F.size(F.filter("s.signs", lambda x: x > 0)).cast("double")
    total = F.size("s.signs").cast("double")
    p = up / F.greatest(total, F.lit(1.0))
    entropy = F.when((total < 2) | (p == 0) | (p == 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
    return s.select(
        "key", F.col("s.ts").alias("last_write"), F.col("s.n").alias("write_count"), F.col("s.velocity").alias("velocity"),
        F.when(F.col("s.n") > 2, F.sqrt(F.col("s.dt_m2") / (F.col("s.n") - 2))).otherwise(0.0).alias("volatility"),
        F.col("s.dt_mean").alias("interval"), F.col("s.streak").alias("streak"), F.col("s.record").alias("streak_record"), F.col("s.signs").alias("signs"), entropy.alias("entropy"),
        trend("value"), trend("k"))


def labelled(behaviors: DataFrame, now: int | F.Column | None = None) -> DataFrame:
    """behaviors with their lifecycle at ``now`` (ms; the newest write if not given)."""
    if now is None:
        newest = behaviors.agg(F.max("last_write").alias("_now"))
        behaviors, now = behaviors.crossJoin(F.broadcast(newest)), F.col("_now")
    now = F.lit(now) if isinstance(now, int) else now
    return behaviors.withColumn("lifecycle", lifecycle(F.col("velocity"), F.col("write_count"), now - F.col("last_write"))).drop("_now")


def insights(behaviors: DataFrame, label: str | None = None) -> DataFrame:
    """Labelled rows, newest write first."""
    rows = behaviors.filter(F.col("lifecycle") == label) if label else behaviors
    return rows.orderBy(F.desc("last_write"), "key")


TRACE = "key string, ts bigint, seq bigint, n bigint, velocity double, ema double, mean double, deviation double, z double, value double, label string, changed boolean"


def _trace(table: pa.Table) -> pa.Table:
    table = table.sort_by([("ts", "ascending"), ("seq", "ascending")])
    out = {n: [] for n in ("n", "velocity", "ema", "mean", "deviation", "z", "label", "changed")}
    velocity = ema = mean = m2 = 0.0
    last, label = 0, ""
    for n, (ts, x) in enumerate(zip(table.column("ts").to_pylist(), table.column("value").to_pylist()), 1):
        gap = ts - last
        if n == 1:
            velocity, ema, mean, made = 1.0, x, x, "emerging"
        else:
            velocity = ALPHA * (HOUR_MS / max(1, gap)) + (1 - ALPHA) * velocity
            ema = TREND * x + (1 - TREND) * ema
            before, mean = mean, mean + (x - mean) / n
            m2 += (x - before) * (x - mean)
            if gap > DEAD_MS:
                made = "resurrected"
            elif velocity > HIGH:
                made = "emerging" if n < 10 else "active"
            else:
                made = "declining" if velocity < LOW else "stable"
        deviation = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
        for name, v in zip(out, (n, velocity, ema, mean, deviation, (x - mean) / deviation if deviation > 0 else 0.0, made, made != label)):
            out[name].append(v)
        last, label = ts, made
    rows = {"key": table.column("key"), "ts": table.column("ts"), "seq": table.column("seq"), **{n: pa.array(v) for n, v in out.items()}, "value": table.column("value")}
    return pa.table({n.split()[0]: rows[n.split()[0]] for n in TRACE.split(", ")})


def trace(obs: DataFrame) -> DataFrame:
    """The fold's state after every write, with the label then and whether it changed."""
    return obs.select("key", "ts", "seq", "value").groupBy("key").applyInArrow(_trace, TRACE)


def read_frequency(reads: DataFrame) -> DataFrame:
    """(key, reads, frequency): EMA of reads an hour; the first read counts as one an hour."""
    items = F.array_sort(F.collect_list(F.struct("ts", "seq")))
    zero = F.struct(F.element_at("items", 1)["ts"].alias("ts"), F.lit(ALPHA).alias("f"))

    def step(a, x):
        dt = F.greatest(F.lit(1).cast("bigint"), x["ts"] - a["ts"]).cast("double")
        return F.struct(x["ts"].alias("ts"), (F.lit(ALPHA) * (F.lit(float(HOUR_MS)) / dt) + F.lit(1 - ALPHA) * a["f"]).alias("f"))

    rest = F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0)))
    return (reads.groupBy("key").agg(items.alias("items")).select("key", F.size("items").cast("bigint").alias("reads"), F.aggregate(rest, zero, step)["f"].alias("frequency")))


def bootstrap(keys: DataFrame, behaviors: DataFrame) -> DataFrame:
    """New keys with the mean behaviour of their group's known members as priors; label emerging.

    keys: (key, group); behaviors: (key, group, velocity, entropy, volatility, write_count)."""
    prior = behaviors.groupBy("group").agg(*[F.avg(c).alias(c) for c in ("velocity", "entropy", "volatility", "write_count")])
    return (keys.join(prior, "group", "left")
            .select("key", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("velocity", "entropy", "volatility")],
                    F.floor(F.coalesce("write_count", F.lit(0.0))).cast("bigint").alias("write_count"), F.lit("emerging").alias("lifecycle")))


def anomalies(traced: DataFrame, least: float = 2.0) -> DataFrame:
    """Writes whose z is at least ``least`` in size, with severity; expected is the EMA."""
    size = F.abs("z")
    severity = F.when(size >= 4, "critical").when(size >= 3, "high").when(size >= 2.5, "medium").otherwise("low")
    return traced.filter(size >= least).select("key", "ts", "seq", F.col("ema").alias("expected"), F.col("value").alias("actual"), "z", severity.alias("severity"))


def recommendations(labelled_: DataFrame) -> DataFrame:
    """promote, demote and investigate rows of labelled behaviours."""
    v, s = F.col("velocity"), F.abs("streak")
    rows = F.array(
        F.when((F.col("lifecycle") == "active") & (v > 2), F.struct(F.lit("promote").alias("type"), F.least(F.lit(1.0), v / 5).alias("confidence"))),
        F.when(F.col("lifecycle") == "declining", F.struct(F.lit("demote").alias("type"), F.lit(0.6).alias("confidence"))),
        F.when(F.col("lifecycle") == "resurrected", F.struct(F.lit("investigate").alias("type"), F.lit(0.8).alias("confidence"))),
        F.when(s >= 5, F.struct(F.lit("investigate_streak").alias("type"), F.least(F.lit(1.0), s / 20.0).alias("confidence"))))
    return labelled_.select("key", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("key", "r.type", "r.confidence")


def alerts(found: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """An alert per anomaly, with confidence and the time at which it expires."""
    return found.select("key", "seq", "severity", F.least(F.lit(1.0), F.abs("z") / 5).alias("confidence"), (F.col("ts") + ttl_ms).alias("expires_at"))


def forecasts(behaviors: DataFrame, field: str = "value", horizon: int = 5) -> DataFrame:
    """ema +- magnitude * range * h for h = 1 .. horizon, with decaying confidence."""
    f = F.col(field)
    sign = F.when(f["direction"] == "up", 1.0).when(f["direction"] == "down", -1.0).otherwise(0.0)
    spread = f["max"] - f["min"]
    h = F.col("h")
    return (behaviors.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
            .select("key", h.cast("bigint").alias("h"), (f["ema"] + sign * f["magnitude"] * spread * h).alias("forecast"),
                    clamp(F.when(spread > 0, 0.8).otherwise(0.3) * F.exp(-0.1 * h)).alias("confidence")))


def outcomes_judged(rows: DataFrame) -> DataFrame:
    """Outcome rows (key, seq, insight, result) with type, scope and whether the insight was right."""
    at = F.instr("key", "|")
    return rows.select("seq", "key", F.when(F.col("insight") == "alert", "anomaly").otherwise("recommendation").alias("type"),
                       F.when(at > 1, F.substring_index("key", "|", 1)).otherwise("*").alias("scope"),
                       F.col("result").isin("followed_success", "ignored_validated").alias("correct"))


def confidence(judged: DataFrame) -> DataFrame:
    """Per (type, scope): accuracy, accuracy of the last 50, calibration and the two flags with
    hysteresis: disabled below .5 from 20 outcomes on until .6; reliable above .95 beyond 50 until .9."""
    items = F.array_sort(F.collect_list(F.struct("seq", F.col("correct").cast("int").alias("c"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("right"), F.lit(False).alias("disabled"), F.lit(False).alias("reliable"))

    def step(a, x):
        n, right = a["n"] + 1, a["right"] + x["c"]
        acc = right.cast("double") / n
        return F.struct(n.alias("n"), right.alias("right"),
                        F.when((acc < 0.5) & (n >= 20), True).when(acc >= 0.6, False).otherwise(a["disabled"]).alias("disabled"),
                        F.when((acc > 0.95) & (n > 50), True).when(acc <= 0.9, False).otherwise(a["reliable"]).alias("reliable"))

    made = judged.groupBy("type", "scope").agg(items.alias("items")).withColumn("s", F.aggregate("items", zero, step))
    last = F.slice("items", F.greatest(F.lit(1), F.size("items") - 49), F.lit(50))
    recent = F.aggregate(last, F.lit(0), lambda t, x: t + x["c"]).cast("double") / F.size(last)
    acc = F.col("s.right").cast("double") / F.col("s.n")
    return made.select("type", "scope", F.col("s.n").cast("bigint").alias("total"), F.col("s.right").cast("bigint").alias("correct"), acc.alias("accuracy"),
                       recent.alias("recent_accuracy"), F.least(F.lit(1.0), acc * 1.1).alias("calibration"),
                       F.col("s.disabled").alias("disabled"), F.col("s.reliable").alias("reliable"))


def label_changes(traced: DataFrame) -> DataFrame:
    """Rows at which a key's label changed, with the label before (null at the first write)."""
    before = F.lag("label").over(W.partitionBy("key").orderBy("ts", "seq"))
    return traced.filter("changed").withColumn("label_before", before).select("key", "ts", "seq", "label_before", "label")


def chosen(found: DataFrame, type: str | None = None, target: str | None = None) -> DataFrame:
    """Recommendations of a type and for a key (any, if not given), the surest first."""
    rows = found if type is None else found.filter(F.col("type") == type)
    rows = rows if target is None else rows.filter(F.col("key") == target)
    return rows.orderBy(F.desc("confidence"), "key", "type")


def insight_outcomes(insights_: DataFrame, results: DataFrame) -> DataFrame:
    """Outcomes (insight_id, seq, result) with their insight (insight_id, key, type, confidence); one whose
    insight isn't known is an error row."""
    made = results.join(insights_, "insight_id", "left")
    return made.select("insight_id", "seq", "key", "type", "confidence", "result", F.when(F.col("type").isNull(), "unknown insight").alias("error"))
