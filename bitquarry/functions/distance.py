"""The named column functions.

Errors are raised when a row's value is needed; ``error_mode="null"`` gives null instead. A null
argument gives null, or with ``null_mode="raise"`` an error.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from bitquarry.functions import kernels
from bitquarry.functions.errors import (
    BYTES_LENGTH,
    EMPTY_ELEM,
    INVALID_CHAR,
    NEGATIVE_DIST,
    NEGATIVE_DIST_ARRAY,
    NO_ALGO,
    NOT_MULTIPLE,
    PARSE,
    STRING_LENGTH,
    column,
    distance_limit,
    fail,
)

DIGIT, LENIENT_DIGIT = "[0-9a-fA-F]", "[0-9a-fA-F@`]"


class _Cases:
    """A CASE chain whose checks come in the order in which they are added."""

    def __init__(self, kind: str, error_mode: str):
        if error_mode not in ("raise", "null"):
            raise ValueError(PARSE)
        self.kind, self.error_mode, self.chain = kind, error_mode, F

    def value(self, when: Column, then: Column) -> _Cases:
        self.chain = self.chain.when(when, then.cast(self.kind))
        return self

    def error(self, when: Column, message: str) -> _Cases:
        return self.value(when, fail(message, self.kind) if self.error_mode == "raise" else F.lit(None))

    def end(self, then: Column) -> Column:
        return self.chain.otherwise(then.cast(self.kind))


def _begun(kind: str, error_mode: str, null_mode: str, args: list[tuple[Column, tuple[str, ...]]]) -> _Cases:
    """Types, then nulls."""
    cases = _Cases(kind, error_mode)
    for x, kinds in args:
        cases.error(~F.typeof(x).isin(*kinds, "void"), PARSE)
    missing = args[0][0].isNull()
    for x, _ in args[1:]:
        missing = missing | x.isNull()
    return cases.error(missing, PARSE) if null_mode == "raise" else cases.value(missing, F.lit(None))


_INT = ("tinyint", "smallint", "int", "bigint")


def _digits(x: Column, lenient: bool) -> Column:
    return F.translate(x, "@`", "99") if lenient else x


def hamming_distance_string(
    a: Column | str, b: Column | str, *, width: int | None = None, algo: str | None = None, lenient_digits: bool = False, error_mode: str = "raise", null_mode: str = "null"
) -> Column:
    """Number of bits in which two hex strings of equal length differ.

    ``width``: the number of digits, where all rows have it; rows of another width are an error.
    ``lenient_digits``: ``@`` and `````` count as 9.
    """
    a, b = column(a), column(b)
    distance = kernels.chosen(algo)(_digits(a, lenient_digits), _digits(b, lenient_digits), width)
    valid = rf"\A{LENIENT_DIGIT if lenient_digits else DIGIT}*\z"
    cases = _begun("long", error_mode, null_mode, [(a, ("string",)), (b, ("string",))])
    cases.error(F.octet_length(a) != F.octet_length(b), STRING_LENGTH)
    cases.error(distance < 0 if kernels.by_arrow(algo, width) else ~a.rlike(valid) | ~b.rlike(valid), INVALID_CHAR)
    if width is not None:
        cases.error(F.octet_length(a) != width, STRING_LENGTH)
    return cases.end(distance)


def hamming_distance_bytes(a: Column | str, b: Column | str, *, width: int | None = None, algo: str | None = None, error_mode: str = "raise", null_mode: str = "null") -> Column:
    """Number of bits in which two binaries of equal length differ; strings count as their UTF-8 bytes. ``width`` counts bytes."""
    a, b = column(a), column(b)
    cases = _begun("long", error_mode, null_mode, [(a, ("binary", "string")), (b, ("binary", "string"))])
    cases.error(F.octet_length(a) != F.octet_length(b), BYTES_LENGTH)
    if width is not None:
        cases.error(F.octet_length(a) != width, BYTES_LENGTH)
    digits = None if width is None else 2 * width
    if kernels.by_arrow(algo, digits):
        return cases.end(kernels.binary_apart(a, b))
    return cases.end(kernels.chosen(algo)(F.hex(a.cast("binary")), F.hex(b.cast("binary")), digits))


def check_hexstrings_within_dist(
    a: Column | str, b: Column | str, max_dist: Column | int, *, algo: str | None = None, lenient_digits: bool = False, error_mode: str = "raise", null_mode: str = "null"
) -> Column:
    """Whether two hex strings differ in at most ``max_dist`` bits.

    As its callers know it: a limit over the number of digits is met at once, equal strings are
    within any limit, and digits after the place where the limit is passed are not looked at. Joins
    and filters of this package don't use it; they compare the distance itself.
    """
    a, b, k = column(a), column(b), distance_limit(max_dist)
    digit = LENIENT_DIGIT if lenient_digits else DIGIT
    cases = _begun("boolean", error_mode, null_mode, [(a, ("string",)), (b, ("string",)), (k, _INT)])
    cases.error(F.octet_length(a) != F.octet_length(b), STRING_LENGTH)
    cases.error(k < 0, NEGATIVE_DIST)
    cases.value(k > F.octet_length(a), F.lit(True))
    cases.value(a == b, F.lit(True))
    if kernels.by_arrow(algo, None):
        begun = kernels.begun_apart(_digits(a, lenient_digits), _digits(b, lenient_digits))
        cases.value(F.when(begun < 0, -1 - begun).otherwise(begun) > k, F.lit(False))
        cases.error(begun < 0, INVALID_CHAR)
        return cases.end(F.lit(True))
    good = lambda x: F.octet_length(F.regexp_extract(x, rf"\A{digit}*", 0))
    upto = F.least(good(a), good(b))
    begin = lambda x: _digits(F.substring(x, F.lit(1), upto), lenient_digits)
    cases.value(kernels.chosen(algo)(begin(a), begin(b), None) > k, F.lit(False))
    cases.error(upto < F.octet_length(a), INVALID_CHAR)
    return cases.end(F.lit(True))


def _bytes_apart(a: Column, b: Column) -> Column:
    return kernels.STRATEGIES["sse41"](F.hex(a), F.hex(b), None)


def first_within(elems: Column | str, elem: Column | str, max_dist: Column | int) -> Column:
    """Place (from 0) of the first binary of an array within ``max_dist`` bits of ``elem``, or -1; null if either is null.

    Elements of another length are no match.
    """
    elems, elem, k = column(elems), column(elem), distance_limit(max_dist)
    near = F.transform(elems, lambda e: (F.octet_length(e) == F.octet_length(elem)) & (_bytes_apart(e, elem) <= k))
    return (F.array_position(near, F.lit(True)) - 1).cast("int")


def _first_of_packed(big, small, k):
    """Stops at the first match of each row."""
    import numpy as np
    import pandas as pd

    out = []
    for x, e, most in zip(big, small, k, strict=True):
        if x is None or e is None or pd.isna(most) or not len(e) or len(x) % len(e):
            out.append(-1)
            continue
        rows, one, found = np.frombuffer(x, np.uint8).reshape(-1, len(e)), np.frombuffer(e, np.uint8), -1
        for at in range(0, len(rows), 4096):
            hit = np.flatnonzero(np.bitwise_count(rows[at : at + 4096] ^ one).sum(axis=1, dtype=np.int64) <= most)
            if len(hit):
                found = at + int(hit[0])
                break
        out.append(found)
    return pd.Series(out, dtype="int32")


def check_bytes_arrays_within_dist(
    array_of_elems: Column | str, elem_to_compare: Column | str, max_dist: Column | int, *, algo: str | None = None, error_mode: str = "raise", null_mode: str = "null"
) -> Column:
    """Place (from 0) of the first element of a packed binary within ``max_dist`` bits of ``elem_to_compare``, or -1.

    Elements are as wide as ``elem_to_compare``. The search stops at the first match, but with the strategies ``classic`` and
    ``sse41``, which look at each element.
    """
    big, small, k = column(array_of_elems), column(elem_to_compare), distance_limit(max_dist)
    cases = _begun("int", error_mode, null_mode, [(big, ("binary", "string")), (small, ("binary", "string")), (k, _INT)])
    big, small = big.cast("binary"), small.cast("binary")
    size = F.octet_length(small)
    cases.error(size == 0, EMPTY_ELEM)
    cases.error(k < 0, NEGATIVE_DIST_ARRAY)
    cases.error(F.octet_length(big) % size != 0, NOT_MULTIPLE)
    cases.value(F.octet_length(big) == 0, F.lit(-1))
    if kernels.by_arrow(algo, None):
        return cases.end(F.pandas_udf(_first_of_packed, "int")(big, small, k))
    elems = F.transform(F.sequence(F.lit(0), (F.octet_length(big) / size).cast("int") - 1), lambda i: F.substring(big, i * size + 1, size))
    return cases.end(first_within(elems, small, k))


def set_algo(name: str) -> str:
    """Choose the strategy for the active session; "" if it exists, else why not. Results never depend on it."""
    if not isinstance(name, str):
        raise ValueError(PARSE)
    if name not in kernels.STRATEGIES:
        return NO_ALGO
    SparkSession.active().conf.set(kernels.CONF, name)
    return ""
