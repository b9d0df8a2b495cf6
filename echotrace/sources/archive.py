"""Archives of submissions, one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def archive(spark: SparkSession, path: str, schema: str, *, files_at_once: int | None = None) -> DataFrame:
    """An archive's rows with ``schema``, from plain or compressed files; lines that are no JSON object are left out.

    With ``files_at_once`` a stream, whose batches take that many files each.
    """
    kept = f"{schema}, _broken string"
    if files_at_once is None:
        rows = spark.read.schema(kept).option("columnNameOfCorruptRecord", "_broken").json(path)
    else:
        rows = spark.readStream.schema(kept).option("columnNameOfCorruptRecord", "_broken").option("maxFilesPerTrigger", files_at_once).json(path)
    return rows.where(F.col("_broken").isNull()).drop("_broken")
