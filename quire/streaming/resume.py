"""Incremental runs: a landing folder of job answers, read once each, and a table of what is done."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def answers(spark: SparkSession, landing: str, schema: T.StructType) -> DataFrame:
    """The stream of answers in a landing folder of JSON lines."""
    return spark.readStream.schema(schema).json(landing)


def collect(spark: SparkSession, landing: str, schema: T.StructType, table: str, checkpoint: str) -> StreamingQuery:
    """Append every answer with a text that has not been seen to ``table``, then stop.

    The checkpoint remembers the files read, so a later run, or one after a failure, takes only new
    ones; a batch that is written again replaces itself, as it is kept under its own number. A job
    that an earlier batch has an answer of is not taken again.
    """

    def put(batch: DataFrame, number: int) -> None:
        good = batch.where(F.length(F.trim("text")) > 0).dropDuplicates(["job_id"])
        try:
            seen = spark.read.parquet(table).where(F.col("batch") < number).select("job_id").distinct()
        except AnalysisException:  # the first batch
            seen = None
        if seen is not None:
            good = good.join(seen, "job_id", "left_anti")
        good.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return answers(spark, landing, schema).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """window_start, event_type, n, value: tumbling windows over an event table or stream, late rows within ``late`` counted."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
