"""Documents as a stream: files that arrive go through the same stages, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheetloom.plans.pipeline import Pipeline


def process(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, pipeline: Pipeline | None = None) -> None:
    """Process what has arrived in ``source`` (Parquet) since the last call into ``sink``, then return."""
    stages = pipeline or Pipeline()

    def batch(docs: DataFrame, number: int) -> None:
        stages.run(docs).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def error_rates(metrics: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Mean error rates in windows of event time ``ts``, rows later than ``late`` left out."""
    return metrics.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("cer").alias("cer"), F.avg("wer").alias("wer"))
