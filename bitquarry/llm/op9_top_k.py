"""Operator 9: exact top-k search by columnar branch-and-bound.

Candidates lie in vertical layout: one row of memory for each dimension. For each query inner
products are accumulated block by block of dimensions; after a block, the norms of what remains of
query and candidate bound what the rest can add, and candidates that cannot reach the query's k-th
score so far are taken out, so that later blocks touch the survivors only.

The queries, a stated set, are written to the shared folder once; each task reads them in blocks
and compares them with the candidates it holds. Only k rows for each query and block of candidates
are shuffled.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows
with a null id; the query's own rows are those with its id; only vectors of a query's own length are
its candidates; repeated query rows are answered each for itself; repeated candidates count each;
an empty table gives an empty result; other columns are not looked at. Scores are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitquarry.llm.common import filesystem, shared_dir

K, EVERY, SCALE = 5, 50, 256
#: Candidates that a task holds at once, candidates and queries compared at once, and dimensions in a block.
HELD, SEED, WIDE, QUERIES, BLOCK = 1 << 15, 1 << 10, 1 << 12, 256, 8


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v: the components times the scale, rounded down; rows that take no part are gone."""
    x = F.transform(F.col(vec_col).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    fine = ~F.exists(F.col(vec_col).cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col)).where(F.col(vec_col).isNotNull() & F.col("vec_id").isNotNull())
    return rows.where(fine).select("vec_id", x.alias("v"))


def matrices(b: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For each vector length in the batch: the other columns and the vectors as rows of a matrix."""
    v = b.column("v")
    length = v.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(length):
        own = b if (length == d).all() else b.filter(pa.array(length == d))
        flat = own.column("v").flatten().to_numpy(zero_copy_only=False)
        yield [own.column(c).to_numpy() for c in columns], flat.reshape(own.num_rows, int(d))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bound)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vertical: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k best candidates (ids, scores). ``vertical`` has a row for each dimension."""
    d, n = vertical.shape
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(vertical).max(initial=0)) * max(d, 1) < 2**52
    kind = np.float64 if exact else np.int64  # products are exact in doubles, which multiply faster, or else in integers
    order = np.argsort(-np.square(q.astype(float)).sum(axis=0), kind="stable")  # dimensions that weigh most come first
    q, vertical = q[:, order].astype(kind), vertical[order].astype(kind)
    blocks = [slice(i, min(i + BLOCK, d)) for i in range(0, d, BLOCK)] or [slice(0, 0)]
    q_rest = [np.sqrt(np.square(q[:, s.stop :].astype(float)).sum(axis=1)) for s in blocks]
    c_rest = [np.sqrt(np.square(vertical[s.stop :].astype(float)).sum(axis=0)) for s in blocks]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    at = 0
    while at < n:
        z = min(n, at + (WIDE if at else SEED))
        part = q[:, blocks[0]] @ vertical[blocks[0], at:z]
        for i in range(len(q_ids)):
            bound = found[i][1][k - 1] if len(found[i][1]) == k else None
            live, got = np.flatnonzero(ids[at:z] != q_ids[i]), None
            got = part[i, live]
            for j, s in enumerate(blocks):
                if j:
                    got = got + q[i, s] @ vertical[s, at:z].take(live, axis=1)
                if bound is not None and s.stop < d:
                    keep = got + q_rest[j][i] * c_rest[j][at:z].take(live) * (1 + 1e-9) + 1 >= bound
                    live, got = live[keep], got[keep]
                    if not len(live):
                        break
            if len(live):
                all_ids = np.concatenate([found[i][0], ids[at:z][live]])
                scores = np.concatenate([found[i][1], got.astype(np.int64)])
                top = best(scores, all_ids, k)
                found[i] = all_ids[top], scores[top]
        at = z
    return found


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col)
    path = shared_dir(spark, "top-k-queries")
    rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("q"), "vec_id", "v").write.parquet(path)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(path)
        held, n = [], 0

        def answers() -> Iterator[pa.RecordBatch]:
            own: dict[int, list] = {}
            for b in held:
                for (ids,), v in matrices(b, ["vec_id"]):
                    own.setdefault(v.shape[1], []).append((ids, v))
            columns = {d: (np.concatenate([x[0] for x in got]), np.ascontiguousarray(np.concatenate([x[1] for x in got]).T)) for d, got in own.items()}
            for qb in pads.dataset(at, filesystem=fs, format="parquet").to_batches(columns=["q", "vec_id", "v"], batch_size=QUERIES):
                if not qb.num_rows:
                    continue
                for (q, q_ids), v in matrices(qb, ["q", "vec_id"]):
                    if v.shape[1] not in columns:
                        continue
                    ids, vertical = columns[v.shape[1]]
                    got = search(q_ids, v, ids, vertical, k)
                    sizes = [len(x[0]) for x in got]
                    out = [np.repeat(q, sizes), np.repeat(q_ids, sizes), np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["q", "query_id", "vec_id", "score"])

        for b in batches:
            for i in range(0, b.num_rows, HELD):
                if n + min(HELD, b.num_rows - i) > HELD:
                    yield from answers()
                    held, n = [], 0
                held.append(b.slice(i, HELD))
                n += held[-1].num_rows
        if n:
            yield from answers()

    near = rows.mapInArrow(compare, "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
