"""A corpus pipeline of five stages over ``documents``; each works on what its predecessor kept.

Rows are judged by their own text, whatever their doc_id: the near-duplicate stage numbers them, the decontamination
knows them by their text's hash. Of rows alike in all columns one stays, but all whose texts have no words.
All stages but the last return the columns of ``documents`` (and any others that came with them).
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm.common import saved
from bitquarry.llm.op1_toxicity import held_out, reject_toxic
from bitquarry.llm.op3_jaccard import BUCKETS, Jaccard, jaccard_components
from bitquarry.llm.op6_decontaminate import contaminated, find_overlaps
from bitquarry.llm.op8_bpe import encode_decode
from bitquarry.llm.op10_line_dedup import dedup_lines


#: The number of a row and its hash's bucket while near duplicates are looked for; no table of documents has such columns.
ROW, BUCKET = "__row_of_near_duplicates", "__bucket_of_near_duplicates"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier takes for toxic."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that repeat, exactly or nearly, an earlier one; n_chars follows the text."""
    out = dedup_lines(docs)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return out.select(*(n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def text_hash() -> Column:
    return F.xxhash64(F.col("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ROW, the same in each query: by the place in its file if this is a table of files as read, else written out."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in map(str.lower, docs.columns):
        with contextlib.suppress(AnalysisException):  # files of a kind that has no such places
            placed = docs.select(*docs.columns, F.col("_metadata.file_path").alias(BUCKET), F.col("_metadata.row_index").alias(ROW))
            files = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())
            numbers = docs.sparkSession.createDataFrame([(f, k << 36) for k, f in enumerate(files)], f"{BUCKET} string, {ROW}_0 long")
            return placed.join(F.broadcast(numbers), BUCKET).select(*docs.columns, (F.col(f"{ROW}_0") + F.col(ROW)).alias(ROW))
    return saved(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 0.8 of their five-word shingles, the one with the smallest id (null last)."""
    columns, docs = docs.columns, numbered(docs)
    found = jaccard_components(docs, Jaccard(words=5, percent=80), id_col=ROW).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    found = saved(found.join(docs.select(F.col(ROW).alias("row"), "doc_id"), "row"), "found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = found.groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("group", F.col("first.row").alias("first"))
    gone = saved(found.join(groups, "group").where("row != first").select(F.col("row").alias(ROW)), "gone")
    # Only documents in the buckets of those that go are shuffled; BUCKETS numbers at most are sent to all tasks.
    bucket = F.pmod(F.xxhash64(F.col(ROW)), F.lit(BUCKETS))
    asked, docs = F.broadcast(gone.select(bucket.alias(BUCKET)).distinct()), docs.withColumn(BUCKET, bucket)
    rest = docs.join(asked, BUCKET, "left_semi").join(gone, ROW, "left_anti")
    return docs.join(asked, BUCKET, "left_anti").select(*columns).unionByName(rest.select(*columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more of the words are passages of ``benchmark``."""
    texts = docs.select(text_hash().alias("hash"), "text")
    found = find_overlaps(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="hash")
    gone = saved(found.where(contaminated()).select(F.col("doc_id").alias("hash")).distinct(), "contaminated")
    return docs.alias("d").join(gone.alias("g"), F.xxhash64("d.text") == F.col("g.hash"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every text that is left."""
    return encode_decode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The first stage is a trained classifier, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
