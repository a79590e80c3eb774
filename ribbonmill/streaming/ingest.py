"""Incremental ingest of passages as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def passages(spark: SparkSession, folder: str, schema, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.schema(schema).format(fmt).load(folder)


def deduplicated(stream: DataFrame, key: str = "chunk_id", time: str = "loaded_at", late: str = "30 days") -> DataFrame:
    """Each key once; state of keys older than ``late`` is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, time: str = "loaded_at", width: str = "1 day", late: str = "2 days", by: str = "source_type") -> DataFrame:
    """window_start, by, n: rows in event-time windows, late ones up to the watermark."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), by, "n")


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str = "chunk_id") -> StreamingQuery:
    """Appends rows of keys the target doesn't hold yet; run again, it changes nothing. One pass over what is there."""

    def write(batch: DataFrame, _: int) -> None:
        one = batch.dropDuplicates([key])
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        # only a target that isn't there counts as empty; any other failure to read it is one
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        have = spark.read.parquet(target).select(key) if there else None
        (one if have is None else one.join(have, key, "left_anti")).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
