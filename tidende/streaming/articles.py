"""Articles as they arrive: slices and counts over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def article_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory as a stream, whether it is stored as one file or as a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders; a single file is picked out of the one that it is in.
    return reader.parquet(path) if status.isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def first_loads(articles: DataFrame, key: str = "doc_id", time: str = "loaded_at") -> DataFrame:
    """``key, first``: when each delivery first came, in whatever order its repeats arrive; without a watermark, so none is too late to count."""
    return articles.where(F.col(time).isNotNull()).groupBy(key).agg(F.min(time).alias("first"))


def monthly_counts(first: DataFrame) -> DataFrame:
    """``slice_start, n``: deliveries by the calendar month that they first came in."""
    return first.groupBy(F.trunc(F.col("first").cast("timestamp"), "month").alias("slice_start")).agg(F.count("*").alias("n"))


def rolling_values(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` of sliding windows over events."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
