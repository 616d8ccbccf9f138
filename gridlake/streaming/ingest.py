"""Streams of scenes: new cells fill the empty ones of a table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlake.operators.grid import filled_where_empty


def cells(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files of cells, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def fill_table(stream: DataFrame, target: str, value: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's fill-only update as the table's next version, ``target``/v=N; a batch run again writes the same version."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("i", "j").agg(F.max(value).alias(value))
        if number > 0:
            new = filled_where_empty(spark.read.parquet(f"{target}/v={number - 1}"), new, value)
        new.write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, key, mean, n) of time windows, closed when the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
