"""Clean and tag comments as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.cleaning import clean_thorough
from ..operators.tagging import min_tokens, weak_labels, with_identity


def read_comment_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as they are added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepare(df: DataFrame, col: str = "text", tokens: int = 5) -> DataFrame:
    """Identity flag, keyword labels and clean text; texts that are too short go.
    The same on a batch and on a stream."""
    return min_tokens(clean_thorough(weak_labels(with_identity(df, col), col), col), tokens)


def write_prepared(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Exactly-once parquet sink; every available file in one run of bounded batches."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True)
    )
