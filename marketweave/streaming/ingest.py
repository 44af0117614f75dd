"""Continuous intake of article shards: each url once, within a horizon of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marketweave.sources.files import ARTICLE_SCHEMA


def shard_lines(spark: SparkSession, path: str, schema: str = ARTICLE_SCHEMA) -> DataFrame:
    """Lines of new shards; a bad line has null fields and its text in ``_bad``."""
    return spark.readStream.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def article_stream(spark: SparkSession, path: str, schema: str = ARTICLE_SCHEMA, horizon: str = "30 days") -> DataFrame:
    """Articles of new shards; a url seen within the horizon is dropped, so the state stays bounded. Bad lines are in :func:`bad_line_stream`."""
    from pyspark.sql import functions as F

    lines = shard_lines(spark, path, schema).filter("_bad is null").drop("_bad")
    arrived = lines.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", horizon)
    return arrived.dropDuplicatesWithinWatermark(["url"])


def bad_line_stream(spark: SparkSession, path: str, schema: str = ARTICLE_SCHEMA) -> DataFrame:
    """``file`` and ``_bad`` of each bad line of new shards."""
    from pyspark.sql import functions as F

    return shard_lines(spark, path, schema).select(F.col("_metadata.file_name").alias("file"), "_bad", "url").filter("_bad is not null").drop("url")


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to a table of months and stop when all is read."""
    from pyspark.sql import functions as F

    monthly = stream.withColumn("month", F.substring("index_date", 1, 7))
    return monthly.writeStream.format("parquet").partitionBy("month").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
