"""Filters, neighbours, joins and windows by bit distance, on decoded codes (``id``, ``w0`` ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.functions.distance import hamming_distance_string
from bitquarry.plans.joins import block_nearest, ids_with_neighbour, threshold_join


def similarity_filter(df: DataFrame, code: str, query: str, limit: int) -> DataFrame:
    """Rows whose hex code is within ``limit`` bits of a constant, and ``dist``."""
    out = df.withColumn("dist", hamming_distance_string(code, F.lit(query), width=len(query)))
    return out.where(F.col("dist") <= limit)


def pairs_within(codes: DataFrame, limit: int) -> DataFrame:
    """Each unordered pair of a table once: a_id < b_id, dist."""
    return threshold_join(codes, codes, limit, F.col("a.id") < F.col("b.id"))


def with_neighbour(codes: DataFrame, others: DataFrame, limit: int) -> DataFrame:
    """Ids that have another id within the limit (semi join)."""
    return codes.join(ids_with_neighbour(codes, others, limit), "id", "left_semi").select("id")


def without_neighbour(codes: DataFrame, others: DataFrame, limit: int) -> DataFrame:
    """Ids that have none (anti join)."""
    return codes.join(ids_with_neighbour(codes, others, limit), "id", "left_anti").select("id")


def nearest(codes: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """The k nearest others of each id, ties to the smaller id: a_id, rank, b_id, dist."""
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy("dist", "b_id"))
    return block_nearest(codes, others, k).withColumn("rank", rank).where(F.col("rank") <= k).select("a_id", "rank", "b_id", "dist")


def nearest_to(df: DataFrame, code: str, query: str, k: int, tie: str) -> DataFrame:
    """The k rows nearest to a constant."""
    return df.withColumn("dist", hamming_distance_string(code, F.lit(query), width=len(query))).orderBy("dist", tie).limit(k)


def consecutive(df: DataFrame, code: Column, by: list[str], order: list[str], width: int) -> DataFrame:
    """Distance of each row's code from that of the row before it in its group; the first row has none."""
    rows = df.withColumn("code", code)
    before = F.lag("code").over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("before", before).where("before is not null").withColumn("dist", hamming_distance_string("code", "before", width=width)).drop("code", "before")


def first_match_long(packed: DataFrame, id_col: str, elem: bytes, limit: int, piece: int = 4096) -> DataFrame:
    """First match of very long packed binaries: pieces of each row are searched apart. ``id``, ``place`` (-1: none).

    Rows are cut into pieces of ``piece`` elements and exploded, so that one row's elements spread over tasks.
    """
    from bitquarry.functions.distance import check_bytes_arrays_within_dist

    size = piece * len(elem)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length("packed").cast("long") - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))
    pieces = F.transform(starts, lambda start: F.struct(start.alias("start"), F.substring(F.col("packed"), (start + 1).cast("int"), F.lit(size)).alias("part")))
    parts = packed.select(F.col(id_col).alias("id"), F.inline(pieces))
    place = check_bytes_arrays_within_dist("part", F.lit(bytearray(elem)), limit, algo="extra")
    found = parts.select("id", "start", place.alias("p"))
    whole = F.when(F.col("p") >= 0, F.col("start") / len(elem) + F.col("p"))
    return found.groupBy("id").agg(F.coalesce(F.min(whole), F.lit(-1)).cast("int").alias("place"))
