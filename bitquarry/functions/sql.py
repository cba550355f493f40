"""The named functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from bitquarry.functions import errors as E

_CHUNKS = (
    "CASE WHEN length({a}) = 0 THEN 0L ELSE aggregate(transform(sequence(0, CAST((length({a}) - 1) DIV 16 AS INT)), "
    "i -> CAST(bit_count(CAST(conv(substring({a}, i * 16 + 1, 16), 16, -10) AS BIGINT) ^ CAST(conv(substring({b}, i * 16 + 1, 16), 16, -10) AS BIGINT)) AS BIGINT)), "
    "0L, (t, x) -> t + x) END"
)
_VALID = r"rlike r'\A[0-9a-fA-F]*\z'"


def _raise(message: str, kind: str) -> str:
    return f"CAST(raise_error('{message}') AS {kind})"


def bodies() -> dict[str, str]:
    """Signature and body of each SQL function."""
    upto = r"least(octet_length(regexp_extract(a, r'\A[0-9a-fA-F]*', 0)), octet_length(regexp_extract(b, r'\A[0-9a-fA-F]*', 0)))"
    begun = _CHUNKS.format(a=f"substring(a, 1, {upto})", b=f"substring(b, 1, {upto})")
    each = _CHUNKS.format(a="hex(substring(array_of_elems, j * octet_length(elem_to_compare) + 1, octet_length(elem_to_compare)))", b="hex(elem_to_compare)")
    return {
        "hamming_distance_string(a STRING, b STRING) RETURNS BIGINT": f"""CASE WHEN a IS NULL OR b IS NULL THEN NULL
            WHEN octet_length(a) != octet_length(b) THEN {_raise(E.STRING_LENGTH, "BIGINT")}
            WHEN NOT a {_VALID} OR NOT b {_VALID} THEN {_raise(E.INVALID_CHAR, "BIGINT")}
            ELSE {_CHUNKS.format(a="a", b="b")} END""",
        "hamming_distance_bytes(a BINARY, b BINARY) RETURNS BIGINT": f"""CASE WHEN a IS NULL OR b IS NULL THEN NULL
            WHEN octet_length(a) != octet_length(b) THEN {_raise(E.BYTES_LENGTH, "BIGINT")}
            ELSE {_CHUNKS.format(a="hex(a)", b="hex(b)")} END""",
        "check_hexstrings_within_dist(a STRING, b STRING, max_dist BIGINT) RETURNS BOOLEAN": f"""CASE WHEN a IS NULL OR b IS NULL OR max_dist IS NULL THEN NULL
            WHEN octet_length(a) != octet_length(b) THEN {_raise(E.STRING_LENGTH, "BOOLEAN")}
            WHEN max_dist < 0 THEN {_raise(E.NEGATIVE_DIST, "BOOLEAN")}
            WHEN max_dist > octet_length(a) THEN true WHEN a = b THEN true
            WHEN {begun} > max_dist THEN false
            WHEN {upto} < octet_length(a) THEN {_raise(E.INVALID_CHAR, "BOOLEAN")} ELSE true END""",
        "check_bytes_arrays_within_dist(array_of_elems BINARY, elem_to_compare BINARY, max_dist BIGINT) RETURNS INT": f"""CASE
            WHEN array_of_elems IS NULL OR elem_to_compare IS NULL OR max_dist IS NULL THEN NULL
            WHEN octet_length(elem_to_compare) = 0 THEN {_raise(E.EMPTY_ELEM, "INT")}
            WHEN max_dist < 0 THEN {_raise(E.NEGATIVE_DIST_ARRAY, "INT")}
            WHEN octet_length(array_of_elems) % octet_length(elem_to_compare) != 0 THEN {_raise(E.NOT_MULTIPLE, "INT")}
            WHEN octet_length(array_of_elems) = 0 THEN -1
            ELSE CAST(array_position(transform(sequence(0, CAST(octet_length(array_of_elems) DIV octet_length(elem_to_compare) AS INT) - 1),
                j -> ({each}) <= max_dist), true) - 1 AS INT) END""",
    }


def register(spark: SparkSession) -> None:
    """Create the functions in this session. Spark casts arguments of other types, where the column functions raise."""
    for head, body in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
