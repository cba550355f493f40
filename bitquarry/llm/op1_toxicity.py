"""Operator 1: toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings (which ones a text has, not how often) is trained with numpy from
confirmed toxic texts (positive) and texts of unknown kind (unlabelled). With prior p the risk is
``p R+(positive) + max(0, R-(unlabelled) - p R-(positive))``; when the second term falls below zero
its gradient is turned, so that the model doesn't fit unlabelled toxic texts as clean ones. p is the
toxic share of the labelled training rows. The threshold of 0.5 is set on labelled training rows
that the fit has not seen.

Fit on bounded samples, by hash of the id: at most POSITIVE toxic texts, UNLABELLED of all training texts whatever
their label (the risk's prior is that of such a sample), and, to calibrate, at most CALIBRATE labelled texts of a quarter of
the ids that neither of the others draws on. Scores cover every whole text.

Defined cases: null and empty texts have no words and get the bias's score; several label rows of a
document count as the largest; null labels count as none; without toxic examples every score is 0;
repeated rows are scored alike; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm.common import bounded_batches, flat_bytes, sliced, text_of, tidy
from bitquarry.llm.text import ALNUM, distinct_by_row, words

#: Hashed features, and the bytes of a word's beginning, by which unseen forms of a word are known.
DIM, HEAD = 1 << 18, 5
POSITIVE, UNLABELLED, CALIBRATE = 4000, 8000, 4000
FOLDS = 5
#: Share of clean calibration rows that may be taken for toxic: with few examples the best F1 would take many.
ALARMS = 0.02


def features(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words and word beginnings of each row, and the rows' bounds in them."""
    h, bounds = words(flat, offsets, ALNUM, HEAD)
    return distinct_by_row((h >> np.uint64(46)).astype(np.int64), bounds)


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class NonNegativePU:
    """Weights of a linear model by Adam over the non-negative PU risk with logistic loss.

    ``least``: words in fewer sampled texts get no weight. ``sparse``: pull of each weight to zero,
    over the root of the number of toxic examples, as chance makes words stand out by that.
    """

    def __init__(self, prior: float, steps: int = 160, rate: float = 0.05, sparse: float = 0.012, least: int = 3):
        self.prior, self.steps, self.rate, self.sparse, self.least = prior, steps, rate, sparse, least
        self.w, self.bias = np.zeros(DIM), 0.0

    def fit(self, index: np.ndarray, bounds: np.ndarray, positive: np.ndarray) -> NonNegativePU:
        df = np.bincount(index, minlength=DIM)
        keep = (df >= self.least)[index]
        kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
        vocabulary, j = np.unique(index[keep], return_inverse=True)
        n_rows = np.diff(kept)
        w, b = np.zeros(len(vocabulary)), float(np.log(self.prior / (1 - self.prior)))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        n_p, n_u = positive.sum(), (~positive).sum()
        if not n_p or not n_u:
            self.bias, self.risks = b, []
            return self
        pull = self.sparse / np.sqrt(max(1, n_p))
        self.risks = []
        for t in range(1, self.steps + 1):
            z = sums_by_row(w[j], kept) + b
            p = sigmoid(z)
            as_negative = np.logaddexp(0, z)
            inner = as_negative[~positive].mean() - self.prior * as_negative[positive].mean()
            self.risks.append(self.prior * np.logaddexp(0, -z[positive]).mean() + max(0.0, inner))
            g = np.zeros(len(z))
            if inner >= 0:
                g[positive] = self.prior * (p[positive] - 1) / n_p - self.prior * p[positive] / n_p
                g[~positive] = p[~positive] / n_u
            else:
                g[positive] = self.prior * p[positive] / n_p
                g[~positive] = -p[~positive] / n_u
            gw, gb = np.bincount(j, weights=np.repeat(g, n_rows), minlength=len(w)), g.sum()
            m, mb = 0.9 * m + 0.1 * gw, 0.9 * mb + 0.1 * gb
            v, vb = 0.999 * v + 0.001 * gw * gw, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            scale, rate = np.sqrt(v / c2) + 1e-8, self.rate * (1 - (t - 1) / self.steps)
            w -= rate * (m / c1) / scale
            w = np.sign(w) * np.maximum(0, np.abs(w) - rate * np.minimum(1.0, pull / scale))
            b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        self.w[vocabulary], self.bias = w, b
        return self

    def margin(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return sums_by_row(self.w[index], bounds) + self.bias


def calibrated(margin: np.ndarray, toxic: np.ndarray) -> float:
    """The margin with the best F1 of toxic rows (the middle of the gap at it), but one that at most ALARMS of the clean rows exceed; 0 if a class lacks."""
    if not toxic.any() or toxic.all():
        return 0.0
    order = np.argsort(-margin, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + toxic.sum())
    s = margin[order]
    can = np.append(s[:-1] != s[1:], True)
    at = int(np.argmax(np.where(can, f1, -1)))
    best = float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at] - 1e-9)
    return max(best, float(np.quantile(margin[~toxic], 1 - ALARMS)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def with_features(rows: DataFrame, others: str) -> DataFrame:
    """Adds ``words``: the packed distinct hashed words of ``text``, which goes."""
    names = [c.split()[0] for c in others.split(",")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            index, bounds = features(*flat_bytes(b.column("text")))
            packed = index.astype("<u4")
            data = [packed[bounds[i] : bounds[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(data, pa.binary())], names=[*names, "words"])

    return rows.select(*names, "text").mapInArrow(run, f"{others}, words binary")


def drawn(rows: DataFrame, most: int, total: int, seed: int) -> DataFrame:
    """About ``most`` of ``total`` rows with a doc_id, by a hash of it: those below a bound, so that nothing is sorted or shuffled to draw them."""
    share = min(1.0, most / max(1, total))
    return rows if share == 1.0 else rows.where(F.xxhash64(F.col("doc_id"), F.lit(seed)) < F.lit(int((2 * share - 1) * (1 << 63))))


def samples(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """doc_id, part (p: toxic, u: any, c: calibrates), toxic, text; and the toxic share of the labelled rows."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    calibrates = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(4)) == 0
    n = known.select(F.avg("toxic").alias("p"), F.count_if((F.col("toxic") == 1) & ~calibrates).alias("toxic"), F.count_if(calibrates).alias("check")).first()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).where(usable & F.col("doc_id").isNotNull())
    positive = drawn(known.where(~calibrates & (F.col("toxic") == 1)), POSITIVE, n["toxic"], 7).select("doc_id", F.lit("p").alias("part"), "toxic")
    check = drawn(known.where(calibrates), CALIBRATE, n["check"], 7).select("doc_id", F.lit("c").alias("part"), "toxic")
    labelled = rows.join(F.broadcast(positive.unionByName(check)), "doc_id")  # the samples' bounds bound it
    anything = drawn(rows.where(~calibrates), UNLABELLED, docs.count() * (1 - 1 / FOLDS) * 0.75, 9).select("doc_id", "text", F.lit("u").alias("part"), F.lit(0).alias("toxic"))
    both = labelled.unionByName(anything).groupBy("doc_id", "part", "toxic").agg(F.min("text").alias("text"))  # of rows that repeat an id, one
    return both, n["p"] or 0.0


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[NonNegativePU, float]:
    """A model and its threshold from the documents for which ``usable`` (on doc_id) holds; no label of another is read."""
    bounded_batches(docs.sparkSession)
    rows, share = samples(docs, labels, usable, id_col, text_col)
    if not share:
        return NonNegativePU(0.5), float("inf")
    table = with_features(rows, "doc_id long, part string, toxic int").toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("part", "ascending")])
    part_of, toxic = np.array(table.column("part").to_pylist()), table.column("toxic").to_numpy() == 1
    data = table.column("words").to_pylist()
    del table

    def stacked(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [data[i] for i in np.flatnonzero(some)]
        return np.frombuffer(b"".join(own), "<u4").astype(np.int64), np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])]).astype(np.int64)

    fit = part_of != "c"
    model = NonNegativePU(min(max(share, 0.01), 0.9)).fit(*stacked(fit), part_of[fit] == "p")
    check = part_of == "c"
    return model, calibrated(model.margin(*stacked(check)), toxic[check])


def scorer(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str) -> Callable[[pa.Array], np.ndarray]:
    """Trains; the scores of a column of texts without nulls."""
    model, bound = train(docs, labels, usable, id_col, text_col)
    where = np.flatnonzero(model.w)
    sent = docs.sparkSession.sparkContext.broadcast((where, model.w[where], model.bias))  # DIM weights at most

    def score(texts: pa.Array) -> np.ndarray:
        at, values, bias = sent.value
        w = np.zeros(DIM)
        w[at] = values
        index, bounds = features(*flat_bytes(texts))
        return sigmoid(sums_by_row(w[index], bounds) + bias - bound) if np.isfinite(bound) else np.zeros(len(texts))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1; 0.5 and more: toxic) of every whole text."""
    score = scorer(docs, labels, usable, id_col, text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(b.column("text")))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col))
    return rows.mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = score_toxicity(docs, labels, ~held_out(F.col("doc_id")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score under 0.5, with all their columns; texts stay in their partitions and pass through once."""
    score = scorer(docs, labels, usable, id_col, text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_col):
            yield b.filter(pa.array(score(b.column(text_col).cast(pa.string()).fill_null("")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
