"""Views of the relational test tables in the shapes the operators take.

observations  key, ts (ms), seq, value, k, event_type            from events
mutations     lsn, ts (ms), op, key, num, str, tier               from events
snapshots     ts (s), item_id, price, quantity                    from lineitem
prompts       key, ts (ms), content, token_count, task            from conversations
series        key, ts (hour), seq, signal                         from events
outcomes      seq, domain, candidate_id, result, latency_ms, ...  from orders

Each has its DuckDB text in ``SQL`` for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import table

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
#: Prompts of the test data have no time; turns are laid out from this instant.
PROMPT_EPOCH = 1_700_000_000_000


def millis(column: str) -> F.Column:
    """Epoch milliseconds of a zone-less timestamp, floored."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1000)).cast("bigint")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        millis("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("value") + F.lit(0.0)).alias("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "event_type",
    )


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A put/delete log keyed ``u|<user>|<k mod 4>``; errors are deletes.

    The tier column is set by the age against the newest write of the log."""
    obs = observations(spark, sf_dir)
    newest = obs.agg(F.max("ts").alias("now"))
    age = F.col("now") - F.col("ts")
    return obs.crossJoin(F.broadcast(newest)).select(
        F.col("seq").alias("lsn"),
        "ts",
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"),
        F.concat_ws("|", F.lit("u"), F.substring("key", 6, 20), (F.col("k") % 4).cast("string")).alias("key"),
        F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.col("k").cast("double")).alias("num"),
        F.create_map(F.lit("event_type"), F.col("event_type")).alias("str"),
        F.when(age < 7 * DAY_MS, "hot").when(age < 21 * DAY_MS, "warm").otherwise("cold").alias("tier"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (ts, item_id): of duplicates the line with the largest order and number."""
    line = table(spark, sf_dir, "lineitem")
    best = F.max_by(F.struct((F.col("l_extendedprice") + 0.0).alias("price"), (F.col("l_quantity") + 0.0).alias("quantity")),
                    F.struct("l_orderkey", "l_linenumber"))
    ts = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    return (line.groupBy(ts.alias("ts"), F.col("l_partkey").alias("item_id")).agg(best.alias("r"))
            .select("ts", "item_id", "r.price", "r.quantity"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    return talk.select(
        F.concat_ws("|", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        (F.lit(PROMPT_EPOCH) - F.col("conv_id") % 60 * DAY_MS + F.col("turn") * HOUR_MS).alias("ts"),
        F.col("text").alias("content"),
        F.size(F.filter(F.split("text", r"[ \t\r\n\f]+"), lambda w: w != "")).cast("bigint").alias("token_count"),
        F.col("role").alias("task"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by event type and hour: a few aligned, nearly dense series."""
    hour = F.floor(F.col("ts") / HOUR_MS).cast("bigint")
    obs = observations(spark, sf_dir).groupBy(F.col("event_type").alias("key"), hour.alias("hour")).agg(F.avg("value").alias("signal"))
    return obs.select("key", (F.col("hour") * HOUR_MS).alias("ts"), F.col("hour").alias("seq"), F.round("signal", 9).alias("signal"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("domain"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("candidate_id"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "partial").otherwise("error").alias("result"),
        (F.col("o_totalprice") / 100).alias("latency_ms"),
        (F.col("o_totalprice") / 500000).alias("cost_score"),
        millis("o_orderdate").alias("ts"),
    )


SQL = {
    "observations": """SELECT 'user:' || user_id AS key, epoch_us(ts) // 1000 AS ts, event_id AS seq, value + 0.0 AS value,
        json_extract_string(props, '$.k')::BIGINT AS k, event_type FROM events""",
    "snapshots": """SELECT ts, item_id, r.price AS price, r.quantity AS quantity FROM (
        SELECT epoch_us(l_shipdate) // 1000000 AS ts, l_partkey AS item_id,
          arg_max({'price': l_extendedprice + 0.0, 'quantity': l_quantity + 0.0}, {'a': l_orderkey, 'b': l_linenumber}) AS r FROM lineitem GROUP BY ALL)""",
    "prompts": f"""SELECT 'c|' || conv_id || '|' || turn AS key, {PROMPT_EPOCH} - conv_id % 60 * {DAY_MS} + turn * {HOUR_MS} AS ts, text AS content,
        len(list_filter(string_split_regex(text, '[ \\t\\r\\n\\f]+'), lambda w: w <> ''))::BIGINT AS token_count, role AS task FROM conversations""",
    "outcomes": """SELECT o_orderkey AS seq, o_orderpriority AS domain, 'c' || (o_custkey % 7) AS candidate_id,
        CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'error' END AS result,
        o_totalprice / 100 AS latency_ms, o_totalprice / 500000 AS cost_score, epoch_us(o_orderdate) // 1000 AS ts FROM orders""",
}
SQL["mutations"] = f"""SELECT seq AS lsn, ts, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op,
        'u|' || substr(key, 6) || '|' || (k % 4) AS key, value, k::DOUBLE AS k, event_type,
        CASE WHEN now - ts < {7 * DAY_MS} THEN 'hot' WHEN now - ts < {21 * DAY_MS} THEN 'warm' ELSE 'cold' END AS tier
      FROM (SELECT *, max(ts) OVER () AS now FROM ({SQL['observations']}))"""
SQL["series"] = f"""SELECT event_type AS key, hour * {HOUR_MS} AS ts, hour AS seq, round(avg(value), 9) AS signal
      FROM (SELECT *, ts // {HOUR_MS} AS hour FROM ({SQL['observations']})) GROUP BY event_type, hour"""


def with_views(sql: str) -> str:
    """sql with the views that it names as leading CTEs."""
    used = [n for n in SQL if n in sql]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
