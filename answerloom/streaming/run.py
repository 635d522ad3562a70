"""Running a stream over what is there and reading its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State kept outside the heap and checkpointed to the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_parquet(stream: DataFrame, name: str) -> DataFrame:
    """Append-mode stream to parquet until the input is used up, read back."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", new_path(spark, f"{name}-progress"))
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(
    stream: DataFrame, name: str, work: Callable[[DataFrame, int], DataFrame], schema, mode: str = "append"
) -> DataFrame:
    """``work`` on each micro-batch, written per batch id, so a repeated batch replaces itself."""
    spark = stream.sparkSession
    out = new_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", new_path(spark, f"{name}-progress"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)
