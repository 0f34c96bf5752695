"""Running a stream to the end of its input, and the side table of late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available, write parquet, read it back."""
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def file_stream(spark: SparkSession, path: str, schema, pattern: str | None = None, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def split_late(stream: DataFrame, on_time: str, late: str, checkpoint: str, time: str = "ts", delay: str = "15 minutes") -> None:
    """Rows older than the watermark of the earlier batches go to a side table.

    The watermark is the largest event time already stored on time. Every batch leaves its
    own maximum in a small table beside the rows, which is all that later batches read, so
    the cost of a batch does not grow with the history. A restart finds the maxima there;
    a batch that is replayed writes its rows and its maximum anew.
    """
    clock = f"{on_time}-clock"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cut = None
        if batch_id > 0:
            maxima = spark.read.parquet(clock).filter(F.col("batch_id") < batch_id)
            cut = maxima.agg(F.max("newest") - F.expr(f"INTERVAL {delay}")).first()[0]
        rows = batch.withColumn("batch_id", F.lit(batch_id))
        is_late = F.coalesce(F.col(time) < F.lit(cut).cast("timestamp"), F.lit(False))
        for part, target in ((rows.filter(~is_late), on_time), (rows.filter(is_late), late)):
            part.drop("batch_id").write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        kept = spark.read.schema(batch.schema).parquet(f"{on_time}/batch_id={batch_id}")
        kept.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{clock}/batch_id={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
