"""Operator 1: held-out accuracy, what it may look at, and odd tables."""

import random
import zlib

import numpy as np
import pytest
from llm_tables import table
from pyspark.sql import functions as F

from bitquarry.llm.op1_toxicity import NonNegativePU, calibrated, held_out, op1_toxicity, reject_toxic, score_toxicity

INSULTS = ["blorg", "snarfed", "quimble", "zorpling"]


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(900)]
    texts, toxic = [], []
    for _ in range(n):
        w, bad = rng.choices(vocabulary, k=rng.randint(20, 120)), rng.random() < 0.2
        for _ in range(rng.randint(2, 4) * bad):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS) + rng.choice(["", "s", "ish"]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


@pytest.fixture(scope="module")
def planted(spark):
    texts, toxic = corpus(2500, 1)
    docs = table(spark, texts).cache()
    labels = [(i, 1, t) for i, t in enumerate(toxic) if i % 2 == 0]
    return docs, labels, toxic


def usable():
    return ~held_out(F.col("doc_id"))


def test_held_out_accuracy(spark, planted):
    docs, labels, toxic = planted
    got = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), usable()).collect()
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hits = sum(r.score >= 0.5 and toxic[r.doc_id] for r in out)
    assert len(got) == 2500 and all(0 <= r.score <= 1 for r in got)
    assert hits >= 0.9 * sum(toxic[r.doc_id] for r in out)
    assert hits >= 0.9 * sum(r.score >= 0.5 for r in out)


def test_held_out_labels_and_other_columns_make_no_difference(spark, planted):
    docs, labels, _ = planted
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.col("text"))
    a = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), usable())
    b = score_toxicity(other, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"), usable())
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_query_and_rejection_agree(spark, planted, tmp_path):
    docs, labels, _ = planted
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = op1_toxicity(spark, str(tmp_path)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    kept = reject_toxic(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels, usable())
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows if not r.predicted}


def test_odd_tables(spark, odd, empty, odd_texts):
    labels = spark.createDataFrame([(10, 1, 1), (10, 1, 0), (11, 0, 1), (12, 1, 0), (13, None, None), (None, 1, 1), (14, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert score_toxicity(odd, labels, usable()).count() == len(odd_texts)
    assert {r.score for r in score_toxicity(odd, labels.where("toxic = 0"), usable()).collect()} == {0.0}
    assert {r.score for r in score_toxicity(odd, labels.limit(0), usable()).collect()} == {0.0}
    assert score_toxicity(empty, labels, usable()).count() == 0
    assert reject_toxic(odd, labels.limit(0), usable()).count() == len(odd_texts)


def test_risk_is_kept_from_falling_below_zero():
    rng = np.random.default_rng(0)
    index, bounds = rng.integers(0, 500, 4000), np.arange(0, 4001, 10)
    positive = np.arange(400) < 60
    model = NonNegativePU(0.3, steps=300, sparse=0.0).fit(index, bounds, positive)
    assert min(model.risks) >= 0 and model.risks[-1] < model.risks[0]


def test_calibration():
    margin = np.array([3.0, 2.0, 1.0, 0.0, -1.0])
    assert 1.0 < calibrated(margin, margin > 1.5) <= 2.0
    assert calibrated(margin, margin > 9) == 0.0 and calibrated(margin, margin < 9) == 0.0
