"""Click popularity kept up to date by a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_popularity(spark: SparkSession, events_path: str, folder: str, item) -> DataFrame:
    """``article_id, clicks`` after all files of ``events_path`` were read once, as a stream.

    Counts are the stream's only state, one row per article. Each trigger writes the counts that changed to a folder of its own below ``folder``, whole or not at
    all, as a batch that is run again overwrites its own; an article's newest count is its greatest. A restart goes on from the checkpoint below ``folder``.
    """
    schema = spark.read.parquet(events_path).schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    stream = spark.readStream.schema(schema).parquet(f"{events_path[:-1]}[{events_path[-1]}]")  # as a pattern, a single file will do
    clicks = stream.where("event_type = 'click'").groupBy(item.alias("article_id")).agg(F.count(F.lit(1)).alias("clicks"))
    query = clicks.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema(clicks.schema).parquet(f"{folder}/counts")
    return written.groupBy("article_id").agg(F.max("clicks").alias("clicks"))
