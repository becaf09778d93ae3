"""Block metrics of numeric columns and the codec health monitor.

A block is (run, stream, block, seq, x) rows. Metrics come from two lags and grouped
aggregates: one shuffle on (stream, block). The monitor's state machine is an ordered
fold over a stream's block metrics, a few rows per thousand values.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def differences(rows: DataFrame, by: tuple[str, ...] = ("stream", "block")) -> DataFrame:
    """rows with d, the change from the row before in the block, and dd, the change of d."""
    w = W.partitionBy(*by).orderBy("seq")
    return rows.withColumn("d", F.col("x") - F.lag("x").over(w)).withColumn("dd", F.col("d") - F.lag("d").over(w))


def _p90(x: str) -> F.Column:
    """The sorted value at index floor(0.9 n), not interpolated; 0 of none."""
    values = F.array_sort(F.collect_list(F.abs(F.col(x))))
    return F.when(F.size(values) > 0, F.get(values, F.floor(F.size(values) * 0.9).cast("int"))).otherwise(0.0)


def metrics(rows: DataFrame, by: tuple[str, ...] = ("stream", "block")) -> DataFrame:
    """Twelve numbers per block; shares are of the values, the deltas or the deltas of deltas."""
    made = differences(rows, by)
    w = W.partitionBy(*by).orderBy("seq")
    flip = (F.signum("d") * F.signum(F.lag("d").over(w))) < 0
    made = made.withColumn("flip", F.coalesce(flip, F.lit(False)))
    mean = W.partitionBy(*by)
    made = made.withColumn("mean_d", F.coalesce(F.avg(F.abs("d")).over(mean), F.lit(0.0)))
    n, nd, ndd = F.count("*"), F.count("d"), F.count("dd")
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return made.groupBy(*by).agg(
        n.alias("n"),
        (F.count_distinct("x") / n).alias("unique_ratio"),
        (F.count_if(F.col("x") == 0) / n).alias("zero_ratio"),
        F.coalesce(F.avg(F.abs("d")), F.lit(0.0)).alias("mean_abs_delta"),
        _p90("d").alias("p90_abs_delta"),
        share(F.count_if("flip"), nd - 1).alias("sign_flip_rate"),
        F.when(nd > 0, F.greatest(F.count_if(F.col("d") >= 0), F.count_if(F.col("d") <= 0)) / nd).otherwise(1.0).alias("monotonicity"),
        share(F.count_if(F.abs("d") > 5 * F.col("mean_d")), nd).alias("outlier_share"),
        share(F.count_distinct("d"), nd).alias("unique_delta_ratio"),
        share(F.count_distinct("dd"), ndd).alias("unique_dod_ratio"),
        share(F.count_if(F.col("dd") == 0), ndd).alias("zero_dod_ratio"),
        F.coalesce(F.avg(F.abs("dd")), F.lit(0.0)).alias("mean_abs_dod"),
        _p90("dd").alias("p90_abs_dod"),
    )


def regime() -> F.Column:
    ordered = (F.col("monotonicity") > 0.9) | (F.col("unique_ratio") < 0.05)
    chaotic = ((F.col("sign_flip_rate") > 0.4) & (F.col("unique_ratio") > 0.8)) | (F.col("outlier_share") > 0.1)
    return F.when(ordered, "ORDERED").when(chaotic, "CHAOTIC").otherwise("MIXED")


def inverse_differences(rows: DataFrame, by: tuple[str, ...] = ("stream", "block")) -> DataFrame:
    """x again from (first, first_d, dd): two running sums. Exact for integers."""
    w = W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    d = F.coalesce(F.col("dd"), F.col("d"), F.lit(0))
    return rows.withColumn("_d", F.sum(d).over(w)).withColumn("restored", F.first("x").over(w) + F.sum("_d").over(w) - F.first("_d").over(w)).drop("_d")


def runs(rows: DataFrame, by: tuple[str, ...] = ("stream", "block"), most: int = 255) -> DataFrame:
    """Run-length statistics per block: runs, tokens (a run takes one per ``most`` values), longest."""
    w = W.partitionBy(*by).orderBy("seq")
    new = F.coalesce((F.col("x") != F.lag("x").over(w)).cast("int"), F.lit(1))
    island = F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0))
    each = rows.withColumn("island", island).groupBy(*by, "island").agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.count("*").alias("runs"), F.sum(F.ceil(F.col("n") / most)).cast("bigint").alias("tokens"), F.max("n").alias("longest"))


def bits(x: F.Column) -> F.Column:
    """Binary digits of a non-negative whole number, at least 1."""
    return F.length(F.bin(x)).cast("bigint")


def zigzag(x: F.Column) -> F.Column:
    return F.when(x >= 0, x * 2).otherwise(-x * 2 - 1)


def varint_bytes(x: F.Column) -> F.Column:
    return F.ceil(bits(zigzag(x)) / 7).cast("bigint")


def integer_sizes(rows: DataFrame, by: tuple[str, ...] = ("stream", "block")) -> DataFrame:
    """Encoded sizes of whole-number blocks under each codec and the smallest (the first of equals)."""
    made = differences(rows, by)
    d = F.coalesce("d", "x")
    widths = made.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(varint_bytes(d)).alias("varint"),
        F.max(bits(zigzag(F.col("x")))).alias("w"), F.max(bits(zigzag(d))).alias("dw"),
        bits(F.max("x") - F.min("x")).alias("fw"),
        F.count_distinct("x").alias("distinct"), F.sum(varint_bytes(F.col("x"))).alias("xv"))
    byte = lambda w: 1 + F.ceil(F.col("n") * F.col(w) / 8).cast("bigint")
    sized = widths.select(
        *by, "n", "varint", byte("w").alias("bitpack"), byte("dw").alias("delta_bitpack"), (byte("fw") + 8).alias("frame"),
        F.when(F.col("distinct") <= 256, F.col("distinct") * 8 + F.col("n")).alias("dictionary"), (F.col("n") * 8).alias("fixed"))
    choices = ("varint", "bitpack", "delta_bitpack", "frame", "dictionary", "fixed")
    best = F.array_min(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("bytes"), F.lit(i).alias("i"), F.lit(c).alias("codec")))
                                         for i, c in enumerate(choices)]), lambda x: x.isNotNull()))
    return sized.withColumn("_b", best).select(*by, *choices, F.col("_b.codec").alias("codec"), F.col("_b.bytes").alias("bytes"))


HEALTH = ("stream string, block bigint, ratio double, unique_ratio double, route string, reason string, state string, quarantined boolean, "
          "baseline double, deviation double, cause string, probe boolean")
#: Deviations below the baseline that quarantine, and that a probe may be below it; blocks between probes; good probes wanted.
TRIGGER, RECOVERY, EVERY, PROBES = 3, 10, 4, 3


def _cause(ratio: float, u: float, base: float, dev: float, uniq: float) -> str | None:
    """What is wrong with a block against a baseline: its ratio, or a burst of distinct values."""
    if ratio < base - TRIGGER * min(dev, 0.9 * base / TRIGGER):
        return "ratio_drop"
    return "entropy_burst" if u > 1.5 * uniq and u > 0.5 and ratio < base else None


def _health(table: pa.Table) -> pa.Table:
    """The route of each block by a stream's baseline, which starts at ratio 2, deviation 0.5 and
    uniqueness 0.5. CORE blocks whose values repeat enough train it (the very first sets it);
    a ratio drop, an entropy burst or the entropy gate quarantines; then every fourth block is a
    probe, judged by its ratio alone, and the third good one in a row recovers, unless the gate stops it."""
    table = table.sort_by("block")
    base, dev, uniq, frozen, quarantined, good, out = 2.0, 0.5, 0.5, 0.0, False, 0, []
    rows = zip(*(table.column(c).to_pylist() for c in ("block", "ratio", "unique_ratio", "unique_delta_ratio")))
    for seen, (block, ratio, u, du) in enumerate(rows):
        gate, cause, probe = u > 0.85 and du > 0.85, None, None
        if not quarantined:
            cause = _cause(ratio, u, base, dev, uniq)
            reason = "entropy_gate" if gate else cause
            state = "ANOMALY_START" if reason else "OK"
            if reason:
                quarantined, frozen, good, cause = True, base, 0, cause or "unknown"
        else:
            state, reason = "ANOMALY_MID", "quarantine_active"
            if block % EVERY == 0:
                probe = ratio >= (frozen or base) - RECOVERY * max(dev, 0.1)
                reason = "recovery_pending" if probe else "recovery_probe_fail"
                if probe and good + 1 >= PROBES and not gate:
                    quarantined, frozen, good, state, reason, probe = False, 0.0, 0, "ANOMALY_END", "recovery_match", None
                else:
                    good = good + 1 if probe else 0
            if gate:
                reason = "entropy_gate"
        route = "CORE" if state in ("OK", "ANOMALY_END") else "QUARANTINE"
        if state == "OK" and u <= 0.8:
            if seen == 0:
                base, dev, uniq = ratio, 0.1 * ratio, u
            else:
                dev = 0.1 * abs(ratio - base) + 0.9 * dev
                base, uniq = 0.1 * ratio + 0.9 * base, 0.1 * u + 0.9 * uniq
        out.append((route, reason, state, quarantined, base, dev, cause, probe))
    made = dict(zip(("route", "reason", "state", "quarantined", "baseline", "deviation", "cause", "probe"), zip(*out))) if out else {}
    kinds = {"quarantined": pa.bool_(), "probe": pa.bool_(), "baseline": pa.float64(), "deviation": pa.float64()}
    return pa.table({**{c: table.column(c) for c in ("stream", "block", "ratio", "unique_ratio")}, **{n: pa.array(v, kinds.get(n, pa.string())) for n, v in made.items()}})


def health(blocks: DataFrame) -> DataFrame:
    """blocks: (stream, block, ratio, unique_ratio, unique_delta_ratio) -> the monitor's decisions.
    A stream's blocks are a few rows per thousand values and are folded in order; streams run in parallel."""
    rows = blocks.select(F.col("stream").cast("string").alias("stream"), F.col("block").cast("bigint").alias("block"), "ratio", "unique_ratio", "unique_delta_ratio")
    return rows.groupBy("stream").applyInArrow(_health, HEALTH)


def gates(blocks: DataFrame) -> DataFrame:
    """The stateless part: which blocks the entropy gate would stop."""
    return blocks.withColumn("gated", (F.col("unique_ratio") > 0.85) & (F.col("unique_delta_ratio") > 0.85))


def anomaly_segments(decided: DataFrame) -> DataFrame:
    """A stream's anomalies in order: from the block that began one to the one that recovered (or, of an
    open one, the last seen), with its cause, its worst ratio and uniqueness, and its probes."""
    over = W.partitionBy("stream").orderBy("block")
    rows = (decided.withColumn("segment", F.count_if(F.col("state") == "ANOMALY_START").over(over.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("last", F.max("block").over(W.partitionBy("stream"))).filter("state <> 'OK'"))
    held = F.col("state") != "ANOMALY_END"
    return rows.groupBy("stream", "segment").agg(
        F.min("block").alias("first"), F.coalesce(F.max(F.when(~held, F.col("block"))), F.max("last")).alias("last"), F.count_if(held).alias("blocks"),
        F.max("cause").alias("cause"), F.min(F.when(held, F.col("ratio"))).alias("worst"), F.max(F.when(held, F.col("unique_ratio"))).alias("most_unique"),
        F.count("probe").alias("probes"), F.count_if("probe").alias("good_probes"))


def worst(blocks: DataFrame, most: int = 10) -> DataFrame:
    return blocks.orderBy("ratio", "stream", "block").limit(most)


def telemetry(decided: DataFrame, *by: str) -> DataFrame:
    """An encoder's roll-up of routed blocks (route, in_bytes, out_bytes): blocks and bytes by route, the
    ratio of the core's bytes and the share of quarantined blocks."""
    core, away = F.col("route") == "CORE", F.col("route") != "CORE"
    sums = {f"{n}_{side}_bytes": F.coalesce(F.sum(F.when(is_, F.col(f"{side}_bytes"))), F.lit(0)) for n, is_ in (("core", core), ("quarantine", away)) for side in ("in", "out")}
    made = decided.groupBy(*by).agg(F.count("*").alias("blocks"), F.count_if(away).alias("quarantine_blocks"), *[c.alias(n) for n, c in sums.items()])
    return (made.withColumn("core_ratio", F.when(F.col("core_out_bytes") > 0, F.col("core_in_bytes") / F.col("core_out_bytes")).otherwise(0.0))
            .withColumn("quarantine_rate", F.when(F.col("blocks") > 0, F.col("quarantine_blocks") / F.col("blocks")).otherwise(0.0)))
