"""New records as a stream: the stateless part of the build, exact copies dropped, groups kept in their split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.build import classified
from ..operators.corpus import uniform


def ingest(raw: DataFrame, arrived: str = "arrived", late: str = "1 hour", val_fraction: float = 0.1, seed: int = 1337) -> DataFrame:
    """Classified records of a stream (path, name, raw, arrived), each text once within the watermark.

    A record's split depends on a hash of its work alone, so records of a work that arrive later
    join its split without any state.
    """
    u = uniform(F.lit(str(seed)), F.col("work_id"))
    records = _carried(raw, arrived, late).withColumn("split", F.when(u < val_fraction, "val").otherwise("train"))
    return records.dropDuplicatesWithinWatermark(["content_sha1"]) if raw.isStreaming else records.dropDuplicates(["content_sha1"])


def _carried(raw: DataFrame, arrived: str, late: str) -> DataFrame:
    """classified() with the arrival time carried in the path, as it keeps only columns that it knows."""
    packed = raw.withColumn("path", F.concat_ws("\x1f", F.col(arrived).cast("string"), "path"))
    parts = F.split("path", "\x1f")
    return classified(packed).withColumn(arrived, parts[0].cast("timestamp")).withColumn("path", parts[1]).withWatermark(arrived, late)


def arrivals(records: DataFrame, arrived: str = "arrived", window: str = "10 minutes") -> DataFrame:
    """Records and bytes by window of arrival and split."""
    return records.groupBy(F.window(arrived, window).alias("window"), "split").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))
