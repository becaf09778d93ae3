"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the mixture's characters; the ratio of target to
present share is the mean repetition rate of its documents. A document's count is the
inverse of the Poisson distribution function at a uniform number hashed from the seed
and its doc_id, so it depends on nothing but these and the rate: a lost task makes the
same rows again. Rows are exploded by their count and shuffled globally.

Plan: one aggregation over (source, length) whose result has a row per source, a join
with it (broadcast if counted small), explode, and one shuffle of the replicas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import small, uniform, without

TEMPERATURE, EPOCHS, SEED = 0.7, 1.0, 17
#: Beyond this a rate is split over several independent draws (Poisson counts add).
RATE_A_DRAW = 32.0


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE,
          epochs: float = EPOCHS) -> DataFrame:
    """(source, chars, rate): epochs * target share / present share.

    weights: shares by source, normalised; a source that they don't name gets 0. Without
    weights a source's share is chars ** temperature, normalised. A null source is a
    source of its own. A source without characters has rate ``epochs``."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    found = docs.groupBy("source").agg(F.sum(size).alias("chars"))
    if weights is None:
        want = F.when(F.col("chars") > 0, F.pow(F.col("chars").cast("double"), F.lit(temperature))).otherwise(0.0)
    else:
        want = F.lit(0.0)
        for name, weight in weights.items():
            want = F.when(F.col("source").eqNullSafe(F.lit(name)) & (F.col("chars") > 0),
                          F.lit(float(weight))).otherwise(want)
    found = found.withColumn("want", want)
    total = found.agg(F.sum("want").alias("wants"), F.sum("chars").alias("all"))
    rate = F.when(F.col("chars") == 0, F.lit(float(epochs))).when(F.col("wants") == 0, F.lit(0.0)).otherwise(
        F.lit(float(epochs)) * (F.col("want") / F.col("wants")) * (F.col("all") / F.col("chars")))
    return found.crossJoin(F.broadcast(total)).select("source", "chars", rate.alias("rate"))


def distribution(rate: F.Column) -> F.Column:
    """P(X <= 0), P(X <= 1), ... of the Poisson distribution, as far as a double can tell."""
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(a, k):
        p = a["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.array_append(a["all"], a["c"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE,
        epochs: float = EPOCHS, seed: int = SEED, replica: str | None = "replica") -> DataFrame:
    """docs, each row as often as its count says, in a global random order.

    Adds ``replica`` (1 to the count; an input column of that name gives way) unless
    replica is None. Null or empty texts weigh nothing but are replicated like others;
    rows with equal (or null) doc_id and source get equal counts; an empty table gives
    an empty table; texts of any length count whole."""
    docs = without(docs, replica) if replica else docs
    draws = F.greatest(F.ceil(F.col("rate") / RATE_A_DRAW).cast("int"), F.lit(1))
    table = rates(docs, weights, temperature, epochs).withColumn("draws", draws).select(
        F.col("source").alias("_source"), "draws", distribution(F.col("rate") / F.col("draws")).alias("cdf"))
    table = small(table.select("_source", F.struct("draws", "cdf").alias("_m")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                      F.col("source").alias("_s"), F.col("doc_id").alias("_id"))

    def drawn(j):
        u = uniform(seed, F.col("_id"), j)
        return F.size(F.filter(F.col("_m.cdf"), lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("_m.draws")), F.lit(0), lambda n, j: n + drawn(j))
    order = uniform(seed + 1, F.col("_id"), F.col("_r"))
    made = (row.join(table, F.col("_s").eqNullSafe(F.col("_source")))
            .withColumn("_n", count).filter("_n > 0")
            .select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_r"))
            .withColumn("_o", order)
            .repartition(F.col("_o")).sortWithinPartitions("_o"))
    out = [F.col(f"_row.`{c}`") for c in docs.columns]
    return made.select(*out, F.col("_r").alias(replica)) if replica else made.select(*out)


def query(spark, sf_dir):
    from tideline.llm.common import read

    return mix(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source),
w AS (SELECT *, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, {TEMPERATURE}) ELSE 0 END AS want FROM s),
r AS (SELECT source, CASE WHEN chars = 0 THEN {EPOCHS}::DOUBLE
        ELSE {EPOCHS}::DOUBLE * (want / (SELECT sum(want) FROM w)) * ((SELECT sum(chars) FROM w)::DOUBLE / chars) END AS rate FROM w),
d AS (SELECT source, greatest(ceil(rate / {RATE_A_DRAW})::INT, 1) AS draws, rate / greatest(ceil(rate / {RATE_A_DRAW})::INT, 1) AS l FROM r),
k AS (SELECT source, draws, l, unnest(range(0, ceil(l + 12 * sqrt(l) + 30)::BIGINT + 1)) AS k FROM d),
c AS (SELECT source, draws, list(cdf ORDER BY k) AS cdf FROM (
        SELECT source, draws, k, sum(exp(-l + k * ln(l) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k)
      GROUP BY source, draws),
u AS (SELECT t.*, cdf, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT / {float(1 << 52)} AS u
      FROM (SELECT documents.*, cdf, unnest(range(1, draws + 1)) AS j FROM documents JOIN c ON documents.source IS NOT DISTINCT FROM c.source) t),
n AS (SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cdf, lambda x: x <= u)))::INT AS n
      FROM u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS replica FROM n
"""
