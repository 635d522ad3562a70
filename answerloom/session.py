"""Session settings and durable staging of intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Runtime settings every job relies on. Only ones that may change after start.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settings that only count before the session starts.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app_name: str = "answerloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **START_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    A machine-local folder is made only for a local master with nothing set.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="answerloom-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Shares a small input out over the cores before work that is heavy per row.

    A table of fewer bytes than one scan split per core would leave cores idle
    (one file is often one task). Larger inputs have splits enough and pass
    through without a shuffle. The size comes from the plan's statistics.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * split else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/answerloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors.

    Columnar, so later passes read only the columns they use. Row order and
    partitioning are not kept; use :func:`stage_ordered` where they matter.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_ordered(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps partitions and the row order inside them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Hints a broadcast after counting up to ``most`` rows; more are left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The columns of one-row frames in one row, by scalar subqueries instead of joins."""
    for i, other in enumerate(others):
        name = f"_beside{i}"
        packed = other.select(F.struct(*other.columns).alias(name)).scalar()
        first = first.withColumn(name, packed).select("*", f"{name}.*").drop(name)
    return first
