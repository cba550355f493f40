"""Tables of fingerprints: hex digests, sign-bit codes of vectors, packed elements."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.functions import kernels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files. A pattern, as a stream's path can't be that of one file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; without that setting a local one, which only a local master has in common with its tasks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bitquarry-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def sign_code(vector: Column | str) -> Column:
    """16 hex digits of a vector of 64 numbers: bit i, from the highest, is whether component i is above 0."""
    bits = F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))


def words_of(code: Column | str, width: int) -> list[Column]:
    """The 64-bit words of a hex code of ``width`` digits: decode once, before any join."""
    code = F.col(code) if isinstance(code, str) else code
    return [kernels.word(F.substring(code, at + 1, min(16, width - at))) for at in range(0, width, 16)]


def decoded(df: DataFrame, id_col: str, code_col: str, width: int) -> DataFrame:
    """``id`` and ``w0`` ... of the rows whose code is a hex string of ``width`` digits; others have no place in a join."""
    fit = F.col(code_col).rlike(rf"\A[0-9a-fA-F]{{{width}}}\z")
    words = [w.alias(f"w{i}") for i, w in enumerate(words_of(code_col, width))]
    return df.where(fit).select(F.col(id_col).alias("id"), *words)
