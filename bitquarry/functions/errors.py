"""Error texts and argument checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The messages that callers of the named functions match on.
PARSE = "error occurred while parsing arguments"
STRING_LENGTH = "strings are NOT the same length"
BYTES_LENGTH = "bytes are NOT the same length"
INVALID_CHAR = "hex string contains invalid char"
NEGATIVE_DIST = "`max_dist` must be >0"
NEGATIVE_DIST_ARRAY = "`max_dist` must be >=0"
EMPTY_ELEM = "`elem_to_compare` size must be >0"
NOT_MULTIPLE = "`array_of_elems` size must be multiplier of `elem_to_compare`"
NO_ALGO = "Library was built without this algorithm."

LONG_MAX = (1 << 63) - 1


def column(x: Column | str) -> Column:
    """A column, or a column's name."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    raise ValueError(PARSE)


def distance_limit(x: Column | int) -> Column:
    """An integer that fits 64 bits, or a column."""
    if isinstance(x, Column):
        return x
    if isinstance(x, bool) or not isinstance(x, int) or not -LONG_MAX - 1 <= x <= LONG_MAX:
        raise ValueError(PARSE)
    return F.lit(x).cast("long")


def fail(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)
