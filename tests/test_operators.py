"""Joins against each other and against brute force; streams; all queries against SQL."""

import random
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F
from tables import SF

from bitquarry import queries
from bitquarry.operators import search
from bitquarry.plans.joins import BLOCK, band_join, bands, block_join, share_left, theta_join, threshold_join
from bitquarry.sources.fingerprints import decoded
from bitquarry.streaming.stateless import stream_within

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def codes():
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(12)]
    out = []
    for i in range(120):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(128)
        out.append((i, f"{x:032x}"))
    return out


@pytest.mark.parametrize("limit", [0, 1, 5, 9, 40])
def test_joins_agree(spark, codes, limit):
    df = decoded(spark.createDataFrame(codes, "id long, code string"), "id", "code", 32)
    extra = F.col("a.id") < F.col("b.id")
    want = sorted((a, b, d) for a, x in codes for b, y in codes if a < b and (d := (int(x, 16) ^ int(y, 16)).bit_count()) <= limit)
    for join in (theta_join, band_join, block_join, threshold_join):
        assert sorted(map(tuple, join(df, df, limit, extra).collect())) == want


def test_blocks_of_any_size(spark, codes, monkeypatch):
    monkeypatch.setattr("bitquarry.plans.joins.BLOCK", BLOCK // 128)
    df = decoded(spark.createDataFrame(codes, "id long, code string"), "id", "code", 32)
    number = {i: int(c, 16) for i, c in codes}
    apart = {a: sorted(((x ^ y).bit_count(), b) for b, y in number.items() if a != b) for a, x in number.items()}
    for limit in (0, 12, 40):
        have = {a for a, near in apart.items() if near[0][0] <= limit}
        assert {r.id for r in search.with_neighbour(df, df, limit).collect()} == have
        assert {r.id for r in search.without_neighbour(df, df, limit).collect()} == set(number) - have
        assert block_join(df, df, limit).count() == sum(d <= limit for near in apart.values() for d, _ in near) + len(number)
    assert sorted(map(tuple, search.nearest(df, df, 4).collect())) == [(a, k + 1, b, d) for a in sorted(apart) for k, (d, b) in enumerate(apart[a][:4])]
    none = df.where("id < 0")
    assert block_join(none, df, 3).count() == block_join(df, none, 3).count() == search.nearest(df, none, 2).count() == 0


def test_bands_share_out_all_bits():
    for bits in (64, 128, 192):
        for limit in (0, 1, 6, 20, 63):
            got = [b for first, size in bands(bits, limit) for b in range(first, first + size)]
            assert got == list(range(bits)) and len(bands(bits, limit)) > limit
    assert share_left(64, 3) < 0.001 and share_left(64, 20) == 1.0


def test_codes_that_do_not_decode_have_no_place(spark):
    rows = [(1, "0" * 16), (2, "g" * 16), (3, None), (4, "0" * 15)]
    assert [r.id for r in decoded(spark.createDataFrame(rows, "id long, code string"), "id", "code", 16).collect()] == [1]


def test_long_packed_rows(spark):
    elem = bytes([0xFB] * 8)
    rows = [(1, bytearray(bytes([1] * 8) * 9000 + elem)), (2, bytearray(bytes([1] * 80))), (3, bytearray()), (4, bytearray(elem * 3))]
    got = search.first_match_long(spark.createDataFrame(rows, "id long, packed binary"), "id", elem, 2, piece=64)
    assert sorted(map(tuple, got.collect())) == [(1, 9000), (2, -1), (3, -1), (4, 0)]


def test_stream_equals_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with tempfile.TemporaryDirectory() as d:
        docs.write.parquet(f"{d}/in")
        stream = stream_within(spark.readStream.schema(docs.schema).parquet(f"{d}/in"), "text", "0" * 32, 64)
        stream.writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(f"{d}/out").count() == stream_within(docs, "text", "0" * 32, 64).count() > 0


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, sql, name):
    got = queries.queries()[name](spark, SF)
    c = sql.execute(queries.oracle_sql()[name])
    names = [d[0] for d in c.description]
    want = sorted(repr([r[names.index(n)] for n in sorted(names)]) for r in c.fetchall())
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr([r[n] for n in sorted(names)]) for r in got.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
