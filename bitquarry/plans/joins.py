"""Threshold joins of codes by bit distance.

The exact band join cuts codes into more bands than the limit: two codes within it agree in one band
at least. It joins on (band, value) and keeps a pair in the first band that agrees, so no distinct is
needed. Where bands would be too narrow to tell codes apart, blocks of bounded size are compared with each
other in numpy: every pair is looked at, but none is a row that isn't in the result, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bitquarry.functions.kernels import bits_apart

#: Share of all pairs that bands may leave before comparing all pairs is cheaper.
WORTHWHILE = 0.1
#: Codes of a block on average; pairs compared at once.
BLOCK, AT_ONCE = 1 << 12, 1 << 20


def bands(bits: int, limit: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``limit + 1`` bands that share out the bits, none across a word's end."""
    n = limit + 1
    cuts = [bits * i // n for i in range(n + 1)]
    out = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        while a < z:  # a band that crosses a word's end is two, which are bands as well
            stop = min(z, (a // 64 + 1) * 64)
            out.append((a, stop - a))
            a = stop
    return out


def band_value(words: list[Column], first: int, size: int) -> Column:
    shifted = F.shiftrightunsigned(words[first // 64], first % 64)
    return shifted if size == 64 else shifted.bitwiseAND(F.lit((1 << size) - 1).cast("long"))


def share_left(bits: int, limit: int) -> float:
    """Expected share of all pairs of random codes that agree in a band."""
    if limit >= bits:
        return 1.0
    return min(1.0, sum(2.0**-size for _, size in bands(bits, limit)))


def distance(a: str, b: str, n_words: int) -> Column:
    total = F.lit(0).cast("long")
    for i in range(n_words):
        total = total + bits_apart(F.col(f"{a}.w{i}"), F.col(f"{b}.w{i}"))
    return total


def _words(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[0] == "w" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def theta_join(left: DataFrame, right: DataFrame, limit: int, extra: Column | None = None) -> DataFrame:
    """All pairs (a_id, b_id, dist) within the limit, compared one by one on decoded words."""
    d = distance("a", "b", len(_words(left)))
    on = d <= limit if extra is None else (d <= limit) & extra
    return left.alias("a").join(right.alias("b"), on).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), d.alias("dist"))


def band_join(left: DataFrame, right: DataFrame, limit: int, extra: Column | None = None) -> DataFrame:
    """The same pairs by an equi-join on bands."""
    words = _words(left)
    cut = bands(64 * len(words), limit)

    def banded(df: DataFrame, side: str) -> DataFrame:
        values = [band_value([F.col(w) for w in words], *b) for b in cut]
        return df.select("id", *words, F.posexplode(F.array(*values)).alias("band", "value")).alias(side)

    a, b = banded(left, "a"), banded(right, "b")
    earlier = F.lit(False)
    for i, band in enumerate(cut):
        same = band_value([F.col(f"a.{w}") for w in words], *band) == band_value([F.col(f"b.{w}") for w in words], *band)
        earlier = earlier | ((F.col("a.band") > i) & same)
    d = distance("a", "b", len(words))
    on = (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (d <= limit) & ~earlier
    if extra is not None:
        on = on & extra
    return a.join(b, on).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), d.alias("dist"))


def _blocks(left: DataFrame, right: DataFrame, found: Callable[[pa.Table, pa.Table, np.ndarray, int], tuple[np.ndarray, np.ndarray]], kind: str, names: list[str]) -> DataFrame:
    """Each block of the left beside each of the right. ``found`` sees distances of a slice of left rows, from a row on, to a block."""
    words = _words(left)
    n, m = (max(1, -(-df.count() // BLOCK)) for df in (left, right))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        # Each side has columns of its own: a cogroup of a table with itself would lose those that both share.
        return df.select(*(F.col(c).alias(c) for c in ("id", *words)), block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def codes(t: pa.Table) -> list[np.ndarray]:
        return [t.column(w).to_numpy().view(np.uint64) for w in words]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")
        x, y, out = codes(a), codes(b), []
        step = max(1, AT_ONCE // max(1, b.num_rows))
        for at in range(0, a.num_rows if b.num_rows else 0, step):
            apart = sum(np.bitwise_count(p[at : at + step, None] ^ q[None, :]).astype(np.int64) for p, q in zip(x, y, strict=True))
            i, j = found(a, b, apart, at)
            columns = [a.column("id").take(pa.array(i + at)), b.column("id").take(pa.array(j)), pa.array(apart[i, j])]
            out.append(pa.table(columns, names=["a_id", "b_id", "dist"]))
        return pa.concat_tables(out).select(names) if out else pa.table([pa.array([], types[c]) for c in names], names=names)

    types = {"a_id": to_arrow_type(left.schema["id"].dataType), "b_id": to_arrow_type(right.schema["id"].dataType), "dist": pa.int64()}
    both = dealt(left, "i", n, "j", m).groupBy("i", "j").cogroup(dealt(right, "j", m, "i", n).groupBy("i", "j"))
    return both.applyInArrow(run, kind)


def _kind(left: DataFrame, right: DataFrame) -> tuple[str, str]:
    return left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()


def _unlike(a: pa.Table, b: pa.Table, at: int, rows: int) -> np.ndarray:
    """Whether left rows and right rows have different ids."""
    return a.column("id").to_numpy()[at : at + rows, None] != b.column("id").to_numpy()[None, :]


def block_join(left: DataFrame, right: DataFrame, limit: int, extra: Column | None = None) -> DataFrame:
    """The same pairs by blocks. ``extra`` is about ``a.id`` and ``b.id``, and asked of pairs within the limit."""
    a, b = _kind(left, right)
    pairs = _blocks(left, right, lambda x, y, apart, at: np.nonzero(apart <= limit), f"a_id {a}, b_id {b}, dist long", ["a_id", "b_id", "dist"])
    if extra is None:
        return pairs
    return pairs.select(F.struct(F.col("a_id").alias("id")).alias("a"), F.struct(F.col("b_id").alias("id")).alias("b"), "dist").where(extra).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "dist")


def block_nearest(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """a_id, b_id, dist: of each block of the right the k nearest of another id, ties to the smaller id. A left id is one row's."""

    def found(a: pa.Table, b: pa.Table, apart: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        rows, n = apart.shape
        key = np.where(_unlike(a, b, at, rows), apart * n + np.arange(n), np.iinfo(np.int64).max)
        most = min(k, n)
        j = np.argpartition(key, most - 1, axis=1)[:, :most]
        i = np.repeat(np.arange(rows), most)
        own = np.take_along_axis(key, j, axis=1).reshape(-1) < np.iinfo(np.int64).max
        return i[own], j.reshape(-1)[own]

    a, b = _kind(left, right)
    return _blocks(left, right, found, f"a_id {a}, b_id {b}, dist long", ["a_id", "b_id", "dist"])


def ids_with_neighbour(left: DataFrame, right: DataFrame, limit: int) -> DataFrame:
    """``id``, each once, of the left that have another id of the right within the limit: no pair is a row."""
    words = _words(left)
    if share_left(64 * len(words), limit) <= WORTHWHILE:
        return band_join(left, right, limit, F.col("a.id") != F.col("b.id")).select(F.col("a_id").alias("id")).distinct()

    def found(a: pa.Table, b: pa.Table, apart: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        near = (apart <= limit) & _unlike(a, b, at, len(apart))
        i = np.flatnonzero(near.any(axis=1))
        return i, near[i].argmax(axis=1)

    return _blocks(left, right, found, f"a_id {_kind(left, right)[0]}", ["a_id"]).select(F.col("a_id").alias("id")).distinct()


def threshold_join(left: DataFrame, right: DataFrame, limit: int, extra: Column | None = None) -> DataFrame:
    """Whichever of both is expected to compare less; the choice depends on code width and limit alone."""
    bits = 64 * len(_words(left))
    return (band_join if share_left(bits, limit) <= WORTHWHILE else block_join)(left, right, limit, extra)
