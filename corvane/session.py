"""Session construction and the few settings the operators read from it."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Defaults for sessions made here; a cluster's own session keeps its own settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "corvane", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; `conf` overrides any default."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; a temporary one only where that is unset and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.environ.get("CORVANE_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` through a reliable checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many rows a side of a join is sent to every task.
MAX_BROADCAST_ROWS = 10_000


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if it is found to have at most `limit` rows; else as it is, for Spark to join by shuffle.

    The rows are fetched once for the check, `limit` + 1 of them at most, and the fetched ones are what is broadcast, so a
    small aggregate is not computed twice.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    from pyspark.sql import functions as F

    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


_SHUFFLES = re.compile(r"\b(?:Aggregate|Join|Window|Sort|RepartitionByExpression|Repartition|Deduplicate|Distinct)\b")


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores.

    A small file is one partition, which would leave all work in Python on its rows to one core. Larger inputs have more
    partitions than cores and stay as they are. Only what is read as it lies is looked at: what has been shuffled is split
    already, and asking for its partitions would run the shuffle.
    """
    if _SHUFFLES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
