"""The named functions keep no state, so a stream takes them as a table does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitquarry.functions.distance import hamming_distance_string


def stream_within(stream: DataFrame, text_col: str, query: str, limit: int) -> DataFrame:
    """Rows of a stream whose text's MD5 is within ``limit`` bits of a constant, and ``dist``."""
    out = stream.withColumn("dist", hamming_distance_string(F.md5(F.col(text_col)), F.lit(query), width=32))
    return out.where(F.col("dist") <= limit)
