"""The append-only journal as a stream. The batch forms are in sources; these
are an addition: started and result events arrive as files and are paired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [T.StructField("event", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("replicate", T.IntegerType()), T.StructField("ts", T.TimestampType()), T.StructField("row", T.StringType())]
)


def journal_stream(spark: SparkSession, path: str) -> DataFrame:
    """Journal lines as they arrive; a torn line is dropped."""
    return spark.readStream.schema(EVENTS).option("mode", "DROPMALFORMED").json(path)


def results(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Result rows, one for each cell: a repeat within the watermark is dropped."""
    done = events.where("event = 'result'").withWatermark("ts", late)
    return done.dropDuplicatesWithinWatermark(["item_id", "replicate"])


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows, final once the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event", "n")


def unresolved(events: DataFrame) -> DataFrame:
    """Of a batch of events: cells that started and have no result."""
    cells = events.groupBy("item_id", "replicate").agg(F.count_if(F.col("event") == "started").alias("started"), F.count_if(F.col("event") == "result").alias("finished"))
    return cells.where("started > 0 and finished = 0").select("item_id", "replicate")


def refuse_duplicates(events: DataFrame) -> DataFrame:
    twice = events.where("event = 'result'").groupBy("item_id", "replicate").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError("a cell has two results")
    return events
