"""Bit distance of two hex strings or binaries of equal, known-good form; four strategies with one result.

``classic`` goes digit by digit, ``sse41`` by chunks of 16 digits of any number, ``extra`` by Arrow batches in numpy,
on their buffers as they are. ``native`` is one word in whole-stage code where the width is known to fit it, else as ``extra``:
a number from 16 digits costs more in the JVM than their way to Python. Join conditions take ``decoded`` codes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CONF, DEFAULT = "bitquarry.algo", "native"
DIGITS = 16  # of one 64-bit word, the most that conv() takes
#: What each byte counts as a hex digit; 255 for those that are none.
NIBBLE = bytes(int(chr(c), 16) if chr(c) in "0123456789abcdefABCDEF" else 255 for c in range(256))


def word(digits: Column) -> Column:
    """1 to 16 hex digits as a signed 64-bit number."""
    return F.conv(digits, 16, -10).cast("long")


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + x)


def _classic(a: Column, b: Column, width: int | None) -> Column:
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: bits_apart(word(x), word(y)))
    return F.when(F.length(a) == 0, F.lit(0).cast("long")).otherwise(_sum(pairs))


def _chunks(a: Column, b: Column, width: int | None) -> Column:
    steps = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / DIGITS).cast("int"))
    part = lambda x, i: word(F.substring(x, i * DIGITS + 1, F.lit(DIGITS)))
    return F.when(F.length(a) == 0, F.lit(0).cast("long")).otherwise(_sum(F.transform(steps, lambda i: bits_apart(part(a, i), part(b, i)))))


def _words(a: Column, b: Column, width: int | None) -> Column:
    return _arrow(a, b, width) if width is None or width > DIGITS else bits_apart(word(a), word(b)) if width else F.lit(0).cast("long")


def _flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and the rows' bounds in them."""
    wide = pa.types.is_large_string(x.type) or pa.types.is_large_binary(x.type)
    _, bounds, data = x.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _row_sums(apart: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits set in each row's bytes; eight bytes at once where all rows have a width that allows it."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    out = np.zeros(n, np.int64)
    if not len(apart):
        return out
    width = int(sizes[0])
    if (sizes == width).all():
        words = apart.view(np.uint64) if width % 8 == 0 else apart
        return np.bitwise_count(words).reshape(n, -1).sum(axis=1, dtype=np.int64)
    some = np.flatnonzero(sizes)
    out[some] = np.add.reduceat(np.bitwise_count(apart), bounds[some], dtype=np.int64)
    return out


def _paired(a: pa.Array, b: pa.Array, digits: bool) -> pa.Array:
    """Distances; -1 where a byte is no digit. Rows of unlike widths, which are an error of the caller's, get 0."""
    fit = np.diff(_flat(a)[1]) == np.diff(_flat(b)[1])
    out = np.zeros(len(a), np.int64)
    if not fit.all():
        a, b = a.filter(pa.array(fit)), b.filter(pa.array(fit))
    (x, bounds), (y, _) = _flat(a), _flat(b)
    if digits:
        x, y = (np.frombuffer(v.tobytes().translate(NIBBLE), np.uint8) for v in (x, y))
    apart = np.bitwise_xor(x, y)
    found = _row_sums(apart, bounds)
    if digits and len(x) and (bad := np.flatnonzero((x | y) > 15)).size:
        found[np.searchsorted(bounds, bad, side="right") - 1] = -1
    out[fit] = found
    return pa.array(out)


def _digit_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    return _paired(a, b, True)


def _begun_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distances; where a byte is no digit, -1 less the distance of what stands before it. For rows of unlike widths see above."""
    found = _paired(a, b, True).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(found < 0).tolist():
        x, y = (np.frombuffer(v[i].as_buffer().to_pybytes().translate(NIBBLE), np.uint8) for v in (a, b))
        upto = int(np.argmax((x | y) > 15))
        found[i] = -1 - int(np.bitwise_count(x[:upto] ^ y[:upto]).sum(dtype=np.int64))
    return pa.array(found)


def _byte_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    return _paired(a, b, False)


def _arrow(a: Column, b: Column, width: int | None) -> Column:
    """-1 where either has a byte that is no digit; a UDF is evaluated for all rows, whatever guards stand around it."""
    return F.arrow_udf(_digit_distances, "long")(*(F.coalesce(x.cast("string"), F.lit("")) for x in (a, b)))


def begun_apart(a: Column, b: Column) -> Column:
    return F.arrow_udf(_begun_distances, "long")(*(F.coalesce(x.cast("string"), F.lit("")) for x in (a, b)))


def binary_apart(a: Column, b: Column) -> Column:
    """Distance of binaries of equal length by Arrow batches."""
    return F.arrow_udf(_byte_distances, "long")(*(F.coalesce(x.cast("binary"), F.lit(bytearray())) for x in (a, b)))


STRATEGIES: dict[str, Callable[[Column, Column, int | None], Column]] = {"classic": _classic, "sse41": _chunks, "native": _words, "extra": _arrow}


def chosen(algo: str | None) -> Callable[[Column, Column, int | None], Column]:
    """The named strategy, or the session's."""
    if algo is None:
        spark = SparkSession.getActiveSession()
        algo = spark.conf.get(CONF, DEFAULT) if spark else DEFAULT
    return STRATEGIES[algo]


def by_arrow(algo: str | None, width: int | None) -> bool:
    """Whether the strategy asks Python for digits of this width, which then also finds those that are none."""
    chosen_one = chosen(algo)
    return chosen_one is _arrow or (chosen_one is _words and (width is None or width > DIGITS))
