"""New target files are matched as they arrive; everything that is there is handled, then the stream stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def match_arrivals(spark: SparkSession, source: str, schema: str, match: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Runs ``match`` on each batch of new Parquet files and appends its rows, once per batch whatever fails."""
    def put(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
