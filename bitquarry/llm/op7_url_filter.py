"""Operator 7: URL filter by the ratio of two character language models.

Rules decide the URLs they fit; those decisions are the models' training text, accepted and
rejected, whole: scheme, query and fragment too. Each model is a Markov model of variable order over
bytes: order 0 to 5, each order smoothed by the next lower one, ``p_k(c) = (n(ctx c) + s p_{k-1}(c)) / (n(ctx) + s)``. Counts are
gathered over all rule-decided URLs but every tenth (by page id), which calibrate the bound:
a URL is blocked if its length-normalised log-likelihood difference is over it. An n-gram's key holds
its order and bytes, so each is counted for itself. The counts are a table in the shared folder, which
tasks read in blocks, keeping the n-grams of the URLs at hand: no task and no driver holds all of it.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule; a null or
empty one, as an empty text, is allowed; without training text of both classes everything undecided is
allowed; repeated rows are judged alike and count as often as they come; other columns are not looked at.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm.common import filesystem, flat_bytes, saved_paths, sliced

#: (host, path prefix, verdict); a rule's name is host and path together.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER, SMOOTH = 5, 4.0
#: Text bytes that are counted or scored at once, and n-grams of a block of the written counts.
BATCH, BLOCK = 1 << 19, 1 << 18
#: Slots of a table without keys, as ``count`` and ``log_likelihood`` take for a few small texts.
SLOTS = 1 << 20
#: The bound is sought on a grid of this many steps between -RANGE and RANGE nats a byte.
STEPS, RANGE = 4096, 8.0
_M = np.uint64(0x9E3779B97F4A7C15)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return host, path


def with_rules(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, text (the whole URL), rule, rule_verdict."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), F.col("__url").alias("text"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, v).otherwise(verdict)
    return rows.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def grams(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: positions that have a context so long, the keys of context and byte, and the keys of the context.

    A key is the order, a bit that tells both kinds apart, and the bytes: no two n-grams share one.
    """
    place = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
    byte = flat.astype(np.int64)
    context = np.zeros(len(flat), np.int64)
    for k in range(ORDER + 1):
        if k:
            context[k:] |= byte[:-k] << (8 * (k - 1))
        at = np.flatnonzero(place >= k)
        c = context[at]
        yield at, (2 * k + 1) << 48 | c << 8 | byte[at], (2 * k) << 48 | c


def slots(wanted: np.ndarray, keys: np.ndarray | None, n: int) -> np.ndarray:
    """Where a table of ``n`` counts has these n-grams: at their places in its sorted ``keys``, or hashed if it has none."""
    if keys is not None:
        return np.searchsorted(keys, wanted)
    return ((wanted.astype(np.uint64) * _M) >> np.uint64(44)).astype(np.int64) % n


def count(flat: np.ndarray, offsets: np.ndarray, into: np.ndarray, keys: np.ndarray | None = None) -> None:
    for _, both, alone in grams(flat, offsets):
        into += np.bincount(slots(both, keys, len(into)), minlength=len(into))
        into += np.bincount(slots(alone, keys, len(into)), minlength=len(into))


def log_likelihood(flat: np.ndarray, offsets: np.ndarray, counts: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """Of each text, summed over its bytes; for each row of ``counts``, if it has rows."""
    p = np.full((*counts.shape[:-1], len(flat)), 1 / 256)
    for at, both, alone in grams(flat, offsets):
        n, of = counts[..., slots(both, keys, counts.shape[-1])], counts[..., slots(alone, keys, counts.shape[-1])]
        p[..., at] = (n + SMOOTH * p[..., at]) / (np.maximum(of, n) + SMOOTH)
    total = np.concatenate([np.zeros((*counts.shape[:-1], 1)), np.cumsum(np.log(p), axis=-1)], axis=-1)
    return total[..., offsets[1:]] - total[..., offsets[:-1]]


def keys_of(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The distinct keys of all n-grams of these texts, sorted."""
    return np.unique(np.concatenate([np.unique(k) for _, both, alone in grams(flat, offsets) for k in (both, alone)]))


def ratio(flat: np.ndarray, offsets: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Log-likelihood as a rejected text (row 0) less that as an accepted one (row 1), for each byte; 0 for empty texts.

    Key 0, the empty context, counts all bytes of a class: without any, there is nothing to compare.
    """
    if not len(flat) or not counts[:, 0].all():
        return np.zeros(len(offsets) - 1)
    rejected, accepted = log_likelihood(flat, offsets, counts, keys)
    return (rejected - accepted) / np.maximum(np.diff(offsets), 1)


def calibrated(histogram: dict[tuple[int, str], int]) -> float:
    """The bound with the least mean of both classes' error rates; of several, the one nearest to 0."""
    sums = {v: np.array([histogram.get((i, v), 0) for i in range(STEPS + 1)], float) for v in ("allow", "block")}
    if not sums["allow"].sum() or not sums["block"].sum():
        return 0.0
    missed = np.cumsum(sums["block"]) / sums["block"].sum()
    alarms = 1 - np.cumsum(sums["allow"]) / sums["allow"].sum()
    error = missed + alarms
    bounds = -RANGE + 2 * RANGE * (np.arange(STEPS + 1) + 1) / STEPS
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(bounds[best[np.argmin(np.abs(bounds[best]))]])


def fit(rows: DataFrame) -> str:
    """Counts of the rejected and the accepted model over all rows, as a table in the shared folder: its path."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", BATCH):
            keys = keys_of(*flat_bytes(b.column("text")))
            counts = np.zeros((2, len(keys)), np.int64)
            for row, verdict in enumerate(("block", "allow")):
                count(*flat_bytes(b.filter(pc.equal(b.column("rule_verdict"), verdict)).column("text")), counts[row], keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[0]), pa.array(counts[1])], names=["key", "block", "allow"])

    sums = rows.mapInArrow(gather, "key long, block long, allow long").groupBy("key").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    return saved_paths(sums, "url-models")[1]


def blocks(path: str) -> Iterator[np.ndarray]:
    """The written counts, so many n-grams at a time: rows of keys, rejected and accepted."""
    fs, at = filesystem(path)
    for b in pads.dataset(at, filesystem=fs, format="parquet").to_batches(columns=["key", "block", "allow"], batch_size=BLOCK):
        if b.num_rows:
            yield np.stack([b.column(c).to_numpy() for c in ("key", "block", "allow")])


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the log-likelihood difference a byte)."""
    rows = with_rules(pages, rules, id_col, url_col)
    decided = rows.where("rule_verdict is not null").select("text", "rule_verdict", (F.coalesce(F.pmod("page_id", F.lit(10)), F.lit(1)) == 0).alias("held"))
    model = fit(decided.where("not held").select("text", "rule_verdict"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", BATCH):
            flat, offsets = flat_bytes(b.column("text"))
            keys = keys_of(flat, offsets)
            counts = np.zeros((2, len(keys)), np.int64)
            for block in blocks(model) if len(keys) else ():
                at = np.minimum(np.searchsorted(keys, block[0]), len(keys) - 1)
                own = keys[at] == block[0]
                counts[:, at[own]] = block[1:, own]
            score = ratio(flat, offsets, counts, keys)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    bins = (
        decided.where("held").select("text", "rule_verdict").mapInArrow(scored, "text string, rule_verdict string, score double")
        .groupBy(F.least(F.lit(STEPS), F.greatest(F.lit(0), F.floor((F.col("score") + RANGE) * (STEPS / (2 * RANGE))))).cast("int").alias("bin"), "rule_verdict").count()
    )
    bound = calibrated({(r["bin"], r["rule_verdict"]): r["count"] for r in bins.collect()})
    out = rows.mapInArrow(scored, "page_id long, host string, path string, text string, rule string, rule_verdict string, score double")
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > bound, "block").otherwise("allow"))
    verdict = F.when(F.col("rule_verdict").isNull() & (F.col("text") == ""), "allow").otherwise(verdict)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score")
