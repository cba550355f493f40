"""Operator 10: line dedup by a segment-partition edit join, in DataFrame functions alone.

A line (a text's piece between line feeds) of at least ``least`` characters goes if it is an exact
copy of a line that stands earlier, by document id and line number, or within ``edits`` edits of a
different line whose first copy stands earlier; so of each family of lines the first one stays.

Exact copies fold first, by a 95-bit hash, with partial sums before the shuffle. Each distinct line
is then cut into ``edits + 1`` segments: ``edits`` edits leave one of them whole. Segments are
indexed by number, line length and hash; each line probes the lengths from ``edits`` below its own,
at the places that the edits left and right of the segment allow. Its own segments are both index and
probe, so that keys are shuffled once. Keys that one line alone has go there and then; for the few lines that are left a
64-bit signature is made (the parity of their character pairs by hash: an edit turns 4 bits at most), and lines that
meet at a key are compared where their signatures allow the edits, by a banded bit-parallel
edit distance: the diagonals of the band are the bits of a word, one word for each number of edits. No pair is listed
but those that pass; comparing signatures at a key of m lines takes m * m / 2 word operations.

Defined cases: null texts stay null and have no lines; shorter and empty lines always stay; rows that
repeat a document id hold the same places, so equal lines of theirs at one place stay together, but
each row loses only its own late lines: a document is known by its id and its text's hash; rows with
a null id count as standing before all others; an empty table gives an empty result;
other columns are kept by ``dedup_lines`` and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitquarry.llm.common import free_name

EDITS, LEAST = 2, 20


def places_to_look(edits: int) -> list[tuple[int, int, int]]:
    """(segment, characters that the other line is shorter, move) of all places where a segment of a line within the edits may stand."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(i, less, move) for move in range(low, high + 1)]
    return out


def with_keys(rows: DataFrame, edits: int, least: int) -> DataFrame:
    """Rows with h1, h2, ``line`` and its length ``n`` become key, h1, h2 for each substring that may be a whole segment of a line within the edits, no longer than this one.

    The last bit of h2 is 0 for the line's own segments, by which it is found, and 1 for places where it only looks.
    A line has ``edits + 1`` segments, of which the last ones take what doesn't divide. The places are rows and the key is
    one expression, so that the compiled code stays small.
    """
    k = edits + 1
    looks = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(look, ("i", "less", "move"), strict=True))) for look in places_to_look(edits)))
    rows = rows.select("h1", "h2", "line", "n", F.explode(looks).alias("at")).select("h1", "h2", "line", "n", "at.*")
    other, i = F.col("n") - F.col("less"), F.col("i")
    over = F.pmod(other, F.lit(k))
    short = ((other - over) / k).cast("int")
    size = short + (i >= k - over).cast("int")
    start = short * i + F.greatest(F.lit(0), over - (k - i)) + F.col("move")
    probe = ((F.col("less") != 0) | (F.col("move") != 0)).cast("long")
    fits = (other >= least) & (start >= 0) & (start + size <= F.col("n"))
    return rows.where(fits).select(F.xxhash64(i, other, F.substring("line", start + 1, size)).alias("key"), "h1", F.col("h2").bitwiseOR(probe).alias("h2"))


def signature(line: Column) -> Column:
    """64 bits, each the parity of how often a line has the character pairs of that hash; an edit turns 4 bits at most."""
    chars = F.split(line, "")
    pairs = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(a, b), F.lit(64))))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda out, bit: out.bitwiseXOR(bit))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines, neither null, are within the edits: banded and bit-parallel.

    Bit ``d`` of word ``e`` says that some beginning of b, ``d - edits`` characters longer than what is read of a, is
    within ``e`` edits of it; the words stand in one number, ``wide`` bits each. A character of a moves all diagonals at once:
    equal characters keep a bit, a replaced, left out or added one carries it to the next word.
    """
    wide = 2 * edits + 1
    band, words = (1 << wide) - 1, edits + 1
    n, m = F.char_length(a), F.char_length(b)
    num = lambda x: F.lit(x).cast("long")
    each = lambda x: sum(x << (wide * e) for e in range(words))
    # Characters of a beside those of b on each diagonal; nothing is equal to a null.
    none = F.array_repeat(F.lit(None).cast("string"), 2 * edits)
    padded = F.concat(F.slice(none, 1, edits), F.split(b, ""), none)
    beside = F.arrays_zip(F.split(a, ""), *(F.slice(padded, d + 1, n) for d in range(wide)))

    def added(state: Column) -> Column:
        """Characters of b alone: from word to word, one diagonal up for each."""
        out = state
        for k in range(1, words):
            out = out.bitwiseOR(F.shiftleft(state.bitwiseAND(num(sum((band >> k) << (wide * e) for e in range(words - k)))), k * (wide + 1)))
        return out

    def step(state: Column, at: Column) -> Column:
        same = num(0)
        for d in range(wide):
            same = same + F.when(at.getField("0") == at.getField(str(d + 1)), num(each(1 << d))).otherwise(num(0))
        carried = state.bitwiseOR(F.shiftright(state.bitwiseAND(num(each(band & ~1))), 1)).bitwiseAND(num((1 << wide * edits) - 1))
        once = F.array(state.bitwiseAND(same).bitwiseOR(F.shiftleft(carried, wide)))  # an array gives the value a name
        return F.get(F.transform(once, added), 0)

    start = 0
    for e in range(words):
        for d in range(edits, edits + e + 1):
            start |= 1 << (wide * e + d)
    # Lengths further apart than the edits leave the band.
    end = F.aggregate(beside, num(start), step)
    last = F.call_function("shiftright", end, wide * edits + edits + m - n).bitwiseAND(num(1))
    return F.when(F.abs(n - m) > edits, False).when(n == 0, True).otherwise(last == 1)


def text_key(text_col: str) -> Column:
    """Tells rows apart that share a document id or have none; rows with the same text have the same lines."""
    return F.xxhash64(F.col(text_col).cast("string"))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, own (the text's key), place, line, and the line's two hashes (64 bits, and 31 before a free last one), of lines long enough."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("own")).where("text is not null")
    rows = rows.select("doc_id", "own", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).where(F.char_length("line") >= least)
    second = F.xxhash64(F.lit(1), "line", F.octet_length("line")).bitwiseAND(F.lit(0xFFFFFFFE).cast("long"))
    return rows.select("doc_id", "own", "place", "line", F.xxhash64("line").alias("h1"), second.alias("h2"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """h1, h2, x (doc_id and place of the first copy, and the line), last (doc_id and place of the last copy).

    Each use asks for both, so that its plan is the same up to here and Spark shuffles the lines once.
    """
    place = F.struct("doc_id", "place")
    return lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "place", "line")).alias("x"), F.max(place).alias("last")).where("last is not null")


def met_lines(distinct: DataFrame, edits: int, least: int) -> DataFrame:
    """h1, h2, keys (key and probe): the lines that meet another one at a key, each with those keys (a dozen at most for 2 edits)."""
    rows = distinct.select("h1", "h2", F.col("x.line").alias("line"), F.char_length("x.line").alias("n"))
    rows = with_keys(rows, edits, least)
    there = Window.partitionBy("key")
    probe = F.col("h2").bitwiseAND(F.lit(1).cast("long"))
    both = rows.select("key", "h1", "h2", F.min("h1").over(there).alias("low"), F.max("h1").over(there).alias("high"), F.min(probe).over(there).alias("alone"))
    met = both.where("low < high and alone = 0").select("h1", F.col("h2").bitwiseAND(F.lit(-2).cast("long")).alias("h2"), F.struct("key", probe.cast("byte").alias("probe")).alias("k"))
    return met.groupBy("h1", "h2").agg(F.collect_list("k").alias("keys"))


def near_lines(distinct: DataFrame, edits: int, least: int) -> DataFrame:
    """h1, h2 of each distinct line that is near an earlier one."""
    met = met_lines(distinct, edits, least).join(distinct, ["h1", "h2"])
    met = met.select("h1", "h2", F.struct("x.doc_id", "x.place").alias("first"), F.col("x.line").alias("line"), signature(F.col("x.line")).alias("bits"), F.explode("keys").alias("k"))
    met = met.select(F.col("k.key").alias("key"), F.col("k.probe").alias("probe"), "h1", "h2", "first", "line", "bits")
    # Both sides are whole here and the conditions hold for pairs, so that one exchange serves both; what is cheap is asked first.
    a, b = met.alias("a"), met.alias("b")
    meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.probe") >= 2 * F.col("b.probe"))
    other = (F.col("a.h1") != F.col("b.h1")) | (F.col("a.h2") != F.col("b.h2"))
    alike = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= 4 * edits
    near = F.when(other & alike, within_edits(F.col("a.line"), F.col("b.line"), edits)).otherwise(False)
    later = F.when(F.col("a.first") > F.col("b.first"), F.struct("a.h1", "a.h2")).otherwise(F.struct("b.h1", "b.h2"))
    return a.join(b, meets & near).select(later.alias("later")).select("later.*").distinct()


def late_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, own and place of each line that goes."""
    lines = lines_of(docs, id_col, text_col, least)
    distinct = distinct_lines(lines)
    near = near_lines(distinct, edits, least).withColumn("near", F.lit(True))
    # A line's fate is its first copy's: copies carry only their hashes and places from here on. Turned hashes are dealt
    # anew, so that Spark can split the places of a line that very many documents have.
    fate = distinct.join(near, ["h1", "h2"], "left").select(F.bitwise_not("h1").alias("g1"), "h2", F.struct("x.doc_id", "x.place").alias("first"), "last", F.coalesce("near", F.lit(False)).alias("near"))
    fate = fate.where(F.col("near") | (F.col("first") != F.col("last"))).drop("last")
    places = lines.select(F.bitwise_not("h1").alias("g1"), "h2", "doc_id", "own", "place")
    gone = places.join(fate, ["g1", "h2"]).where(F.col("near") | ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))))
    return gone.select("doc_id", "own", "place")


def removed(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __own (the text's key) and __gone, the sorted places of the lines that go, of each document that loses any.

    The array has at most one entry for each line of the document.
    """
    gone = late_lines(docs, edits, least, id_col, text_col).distinct()
    return gone.groupBy(F.col("doc_id").alias("__id"), F.col("own").alias("__own")).agg(F.array_sort(F.collect_list("place")).alias("__gone"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their late lines taken out; all columns stay as they are but the text."""
    found, own, places = (free_name(docs, c) for c in ("__id", "__own", "__gone"))
    gone = removed(docs, edits, least, id_col, text_col).toDF(found, own, places)
    both = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(found)) & (text_key(text_col) == F.col(own)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col(places), i)), "\n")
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(kept)
    return both.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, and the removed lines' numbers (from 0), comma-joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = removed(docs)
    sizes = docs.select("doc_id", text_key("text").alias("own"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    sizes = sizes.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    both = sizes.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("own") == F.col("__own")), "left")
    return both.select("doc_id", "n_lines", F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("__gone").cast("array<string>"), ","), F.lit("")).alias("removed"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS place, unnest(s) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), k AS (SELECT * FROM l WHERE length(line) >= 20
), d AS (
  SELECT line, length(line) AS n, min(struct_pack(doc_id := doc_id, place := place)) AS first, count(*) AS copies FROM k GROUP BY line
), near AS (
  SELECT DISTINCT a.line FROM d a JOIN d b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND b.first < a.first AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= 2
), gone AS (
  SELECT DISTINCT k.doc_id, k.place FROM k JOIN d USING (line) LEFT JOIN near ON near.line = k.line
  WHERE near.line IS NOT NULL OR struct_pack(doc_id := k.doc_id, place := k.place) <> d.first
), g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS removed FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(string_split(t.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '') AS removed
FROM documents t LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM t.doc_id
"""
