"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 100_000
#: The same for rows of a few numbers, which spare the texts of a corpus a shuffle.
NARROW_ROWS = 3_000_000


def ready(spark: SparkSession) -> SparkSession:
    """Sees to a checkpoint folder: the session's, or in local mode a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add (its own win a clash)."""
    mine = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in mine])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it is small; else as it is,
    so that the join shuffles. df should be cheap to count (checkpointed or aggregated)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is no longer referenced; else they stay until the
    driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def uniform(*parts: F.Column | str | int) -> F.Column:
    """A number in [0, 1) with 52 bits, by the MD5 of the parts joined by ``:``."""
    text = F.concat_ws(":", *[
        F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, F.Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
