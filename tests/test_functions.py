"""The named functions against fixed rows, an independent model, and each other."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitquarry import check_bytes_arrays_within_dist, check_hexstrings_within_dist, first_within, hamming_distance_bytes, hamming_distance_string, register, set_algo
from bitquarry.functions import errors as E
from bitquarry.functions.kernels import STRATEGIES

# Input rows whose results are known.
STRINGS = [
    ("abc", "abc", 0),
    ("000", "001", 1),
    ("ABCDEF", "000001", 16),
    ("", "", 0),
    ("f" * 64, "0" * 64, 256),
    ("f" * 64, "f" * 64, 0),
    ("f" * 10000, "0" * 10000, 40000),
    ("f" * 10000, "f" * 10000, 0),
    ("deadbeef", "00000000", 24),
    ("ABC", "DEF", 7),
    ("F" * 1024, "0" * 1024, 4096),
]
STRING_ERRORS = [
    ("abc", "a", E.STRING_LENGTH),
    ("é", "a", E.STRING_LENGTH),
    ("é", "ab", E.INVALID_CHAR),
    ("lol", "foo", E.INVALID_CHAR),
    ("ggg", "ggg", E.INVALID_CHAR),
    ("f" * 32, "f" * 31 + "g", E.INVALID_CHAR),
    ("f" * 30, "f" * 29 + "g", E.INVALID_CHAR),
    ("g" * 15 + "fff", "g" * 15 + "000", E.INVALID_CHAR),
    (":" + "0" * 15, "0" * 16, E.INVALID_CHAR),
    ("0x12", "0x12", E.INVALID_CHAR),
    ("ab\n", "abc", E.INVALID_CHAR),
    ("-1", "11", E.INVALID_CHAR),
    ("@0", "00", E.INVALID_CHAR),
]
WITHIN = [
    ("000abcdef", "011abcdef", 3, True),
    ("1f0abcdef", "011abcdef", 3, False),
    ("011abcdef", "011abcdef", 1000, True),
    ("ffff", "fffe", 2, True),
    ("ffff", "0000", 2, False),
    ("ffff", "0000", 4, False),
    ("ffff", "0000", 5, True),
    ("zzzz", "0000", 5, True),
    ("ggg", "ggg", 0, True),
    ("F" * 1000, "0" * 1000, 20, False),
    ("ffzz", "00zz", 3, False),
]
WITHIN_ERRORS = [
    ("000abcdef", "011abcdef", -1, E.NEGATIVE_DIST),
    ("000abcdef", "011abcdzz", 3, E.INVALID_CHAR),
    ("G", "g", 0, E.INVALID_CHAR),
    ("011abcdef", "00", 3, E.STRING_LENGTH),
    ("011abcdef", "00", -3, E.STRING_LENGTH),
]
PACKED = [
    ("00" * 16, "FF" * 16, 50, -1),
    ("00" * 16, "FF" * 15 + "F0", 128, 0),
    ("FF" * 128 + "0F" * 16, "00" * 2 + "0F" * 14, 8, 8),
    ("F0" * 64 + "0A" * 64, "0F" * 64, 192, 1),
    ("", "0F" * 3, 9, -1),
    ("0001" * 3 + "0002", "0002", 0, 3),
    ("0003" * 8 * 511 + "00" * 16, "00" * 16, 1, 511),
    ("01" * 64 * 300 + "CC" * 64, "FB" * 64, 320, 300),
]
PACKED_ERRORS = [
    ("00" * 16, "FF" * 16, -1, E.NEGATIVE_DIST_ARRAY),
    ("00" * 31, "00" * 16, 1, E.NOT_MULTIPLE),
    ("00" * 32, "", 1, E.EMPTY_ELEM),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def binary(digits):
    return F.lit(bytearray(bytes.fromhex(digits)))


def model(a, b):
    return (int(a or "0", 16) ^ int(b or "0", 16)).bit_count()


@pytest.mark.parametrize("algo", sorted(STRATEGIES))
def test_strings(spark, algo):
    df = spark.createDataFrame(STRINGS, "a string, b string, e long")
    got = df.select("e", hamming_distance_string("a", "b", algo=algo).alias("d")).collect()
    assert all(r.e == r.d for r in got)


@pytest.mark.parametrize("algo", sorted(STRATEGIES))
def test_bytes(spark, algo):
    rows = [(bytearray(bytes.fromhex(a)), bytearray(bytes.fromhex(b)), e) for a, b, e in STRINGS if len(a) % 2 == 0]
    df = spark.createDataFrame(rows, "a binary, b binary, e long")
    assert all(r.e == r.d for r in df.select("e", hamming_distance_bytes("a", "b", algo=algo).alias("d")).collect())


def test_text_given_as_bytes_is_its_utf8(spark):
    assert one(spark, hamming_distance_bytes(F.lit("é"), F.lit("è"))) == (0xA9 ^ 0xA8).bit_count()


@pytest.mark.parametrize(("a", "b", "message"), STRING_ERRORS)
def test_string_errors(spark, a, b, message):
    for algo in ("native", "extra"):
        with pytest.raises(Exception, match=message):
            one(spark, hamming_distance_string(F.lit(a), F.lit(b), algo=algo))
    assert one(spark, hamming_distance_string(F.lit(a), F.lit(b), error_mode="null")) is None


def test_argument_errors(spark):
    with pytest.raises(ValueError, match=E.PARSE):
        hamming_distance_string("abc", 3)
    with pytest.raises(Exception, match=E.PARSE):
        one(spark, hamming_distance_string(F.lit("3"), F.lit(3)))
    for k in (None, "HELLO", 1 << 64, True):
        with pytest.raises(ValueError, match=E.PARSE):
            check_hexstrings_within_dist("a", "b", k)
        with pytest.raises(ValueError, match=E.PARSE):
            check_bytes_arrays_within_dist("a", "b", k)
    with pytest.raises(Exception, match=E.BYTES_LENGTH):
        one(spark, hamming_distance_bytes(binary("00"), binary("0000")))


def test_nulls_and_options(spark):
    null = F.lit(None).cast("string")
    assert one(spark, hamming_distance_string(null, F.lit("a"))) is None
    with pytest.raises(Exception, match=E.PARSE):
        one(spark, hamming_distance_string(null, F.lit("a"), null_mode="raise"))
    assert one(spark, hamming_distance_string(F.lit("@`"), F.lit("99"), lenient_digits=True)) == 0
    assert one(spark, hamming_distance_string(F.lit("0" * 31), F.lit("f" * 31), width=31)) == 124
    with pytest.raises(Exception, match=E.STRING_LENGTH):
        one(spark, hamming_distance_string(F.lit("00"), F.lit("00"), width=3))


@pytest.mark.parametrize("algo", sorted(STRATEGIES))
def test_within(spark, algo):
    df = spark.createDataFrame(WITHIN, "a string, b string, k long, e boolean")
    assert all(r.e == r.d for r in df.select("e", check_hexstrings_within_dist("a", "b", F.col("k"), algo=algo).alias("d")).collect())


def test_rows_of_many_widths_with_nulls_and_bad_digits(spark):
    rows = [("0f" * i, "f0" * i) for i in range(40)] + [(None, "00"), ("00", None), ("00", "0g"), ("0" * 64, "0" * 63 + "é"[:1]), ("00", "000")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = df.select(hamming_distance_string("a", "b", algo="extra", error_mode="null").alias("d")).collect()
    assert [r.d for r in got] == [8 * i for i in range(40)] + [None] * 5
    binaries = df.limit(40).select(F.unhex("a").alias("a"), F.unhex("b").alias("b"))
    assert [r.d for r in binaries.select(hamming_distance_bytes("a", "b", algo="extra").alias("d")).collect()] == [8 * i for i in range(40)]


def test_version():
    import bitquarry

    assert bitquarry.__version__ == "0.1.0"


@pytest.mark.parametrize(("a", "b", "k", "message"), WITHIN_ERRORS)
def test_within_errors(spark, a, b, k, message):
    with pytest.raises(Exception, match=message.replace("`", ".")):
        one(spark, check_hexstrings_within_dist(F.lit(a), F.lit(b), k))


@pytest.mark.parametrize("algo", ["native", "extra"])
def test_packed(spark, algo):
    for big, small, k, e in PACKED:
        assert one(spark, check_bytes_arrays_within_dist(binary(big), binary(small), k, algo=algo)) == e


@pytest.mark.parametrize(("big", "small", "k", "message"), PACKED_ERRORS)
def test_packed_errors(spark, big, small, k, message):
    with pytest.raises(Exception, match=message.replace("`", ".")):
        one(spark, check_bytes_arrays_within_dist(binary(big), binary(small), k))


def test_array_form(spark):
    elems = F.array(binary("00FF"), binary("0F0F"), binary("00"))
    assert one(spark, first_within(elems, binary("0F0E"), 1)) == 1
    assert one(spark, first_within(elems, binary("F0F0"), 1)) == -1


def test_set_algo(spark):
    for name in STRATEGIES:
        assert set_algo(name) == ""
        assert one(spark, hamming_distance_string(F.lit("deadbeef"), F.lit("00000000"))) == 24
    assert set_algo("none") == E.NO_ALGO
    with pytest.raises(ValueError, match=E.PARSE):
        set_algo(3)
    set_algo("native")


def test_sql_names(spark):
    register(spark)
    sql = "SELECT hamming_distance_string('deadbeef', '00000000') a, hamming_distance_bytes(X'DEADBEEF', X'00000000') b, check_hexstrings_within_dist('ffff', '0000', 5) c, check_bytes_arrays_within_dist(X'000102', X'03', 0) d"
    assert tuple(spark.sql(sql).first()) == (24, 24, True, -1)
    for bad, message in (("hamming_distance_string('ggg', 'ggg')", E.INVALID_CHAR), ("check_bytes_arrays_within_dist(X'00', X'', 1)", E.EMPTY_ELEM)):
        with pytest.raises(Exception, match=message.replace("`", ".")):
            spark.sql(f"SELECT {bad}").collect()


widths = st.sampled_from([0, 1, 15, 16, 17, 31, 32, 33, 64])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_against_the_model(spark, data):
    rows = []
    for _ in range(40):
        w = data.draw(widths)
        text = st.text("0123456789abcdefABCDEF", min_size=w, max_size=w)
        rows.append((data.draw(text), data.draw(text)))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", *(hamming_distance_string("a", "b", algo=n).alias(n) for n in STRATEGIES), hamming_distance_string(F.upper("b"), "a").alias("back")).collect()
    for r in got:
        assert {r[n] for n in [*STRATEGIES, "back"]} == {model(r.a, r.b)}
