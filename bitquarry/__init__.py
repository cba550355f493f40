"""Bitwise distance over tables of fingerprints, on Spark."""

from bitquarry.functions.distance import (
    check_bytes_arrays_within_dist,
    check_hexstrings_within_dist,
    first_within,
    hamming_distance_bytes,
    hamming_distance_string,
    set_algo,
)
from bitquarry.functions.sql import register

__version__ = "0.1.0"
__all__ = [
    "check_bytes_arrays_within_dist",
    "check_hexstrings_within_dist",
    "first_within",
    "hamming_distance_bytes",
    "hamming_distance_string",
    "register",
    "set_algo",
    "__version__",
]
