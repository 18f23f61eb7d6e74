"""Incremental processing with Structured Streaming: new files only, ids once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def new_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", per_trigger: int = 1000) -> DataFrame:
    """A stream of the files of a folder."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def first_seen(stream: DataFrame, id_col: str, time_col: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row seen of each id; with a time, state older than the watermark is dropped."""
    if time_col:
        return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])
    return stream.dropDuplicates([id_col])


def process(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, state: str, name: str = "uttera") -> StreamingQuery:
    """Runs ``step`` on what is new and appends to parquet at ``out``, once per row over restarts; ends when all there is has been read.

    A batch is written under its number, so that one that is run again replaces itself.
    """

    def write(df: DataFrame, n: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).queryName(name).trigger(availableNow=True).start()


def rolling_counts(stream: DataFrame, time_col: str, key_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) by window of event time, with a watermark for late rows."""
    g = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "key", "n")
