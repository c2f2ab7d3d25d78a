"""Documents as a stream: extraction on arrival, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillspark.operators.reconcile import reconcile


def read_documents(spark: SparkSession, folder: str, schema: StructType, glob: str = "*", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)


def extracted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stateless: runs the same on a stream and on a table."""
    return docs.select(id_col, reconcile(F.col(text_col), F.lit(None).cast("string")).alias("r")).select(id_col, F.explode("r.entities").alias("e"), "r.warnings").select(id_col, "e.*", "warnings")


def into(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch once to ``write``, until what is there has been read."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums of event windows; events later than ``late`` are dropped when streaming."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if timed.isStreaming else timed
    return timed.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
