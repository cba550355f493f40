"""Registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitquarry.functions.distance import (
    check_bytes_arrays_within_dist,
    check_hexstrings_within_dist,
    first_within,
    hamming_distance_bytes,
    hamming_distance_string,
)
from bitquarry.functions.kernels import STRATEGIES
from bitquarry.functions.sql import register
from bitquarry.operators import search
from bitquarry.plans.joins import band_join, theta_join
from bitquarry.sources.fingerprints import decoded, shared_folder, sign_code, stream, table
from bitquarry.streaming.stateless import stream_within

LIMIT, NARROW = 20, 6


def _neighbours(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    """Each document's digest beside that of the next id: doc_id, a, b."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(code).alias("code"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("code").alias("b"))
    return docs.join(after, "doc_id").select("doc_id", F.col("code").alias("a"), "b")


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", sign_code("embedding").alias("code"))
    return decoded(rows, "vec_id", "code", 16)


def p1_string_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, "md5(text)").select("doc_id", hamming_distance_string("a", "b", width=32).alias("dist"))


def p1_sha256_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, "sha2(text, 256)").select("doc_id", hamming_distance_string("a", "b", width=64).alias("dist"))


def p1_odd_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, "substr(md5(text), 1, 31)").select("doc_id", hamming_distance_string("a", "b").alias("dist"))


def p2_bytes_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, "unhex(md5(text))").select("doc_id", hamming_distance_bytes("a", "b", width=16).alias("dist"))


def p3_within_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 20, 32, 33)))).alias("max_dist")
    rows = _neighbours(spark, sf_dir, "md5(text)").select("doc_id", "a", "b", limits)
    return rows.select("doc_id", "max_dist", check_hexstrings_within_dist("a", "b", F.col("max_dist")).alias("within"))


def _elements(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Per user the digests of their events in order of the event id; a user's events are one row's array by the operator's nature."""
    events = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", F.unhex(F.md5(F.concat_ws("|", "event_type", F.col("event_id").cast("string")))).alias("e")).alias("x"))
    return events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("elems"))


def p4_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = first_within("elems", F.unhex(F.md5(F.lit("probe"))), 50)
    return _elements(spark, sf_dir, 50).select("user_id", place.alias("place"))


def p4_packed_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.unhex(F.array_join(F.transform("elems", lambda e: F.hex(e)), ""))
    rows = _elements(spark, sf_dir, 50).select("user_id", packed.alias("packed"))
    return rows.select("user_id", check_bytes_arrays_within_dist("packed", F.unhex(F.md5(F.lit("probe"))), 50, algo="extra").alias("place"))


def p5_strategy_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _neighbours(spark, sf_dir, "md5(text)")
    distances = F.array(*(F.struct(F.lit(n).alias("algo"), hamming_distance_string("a", "b", algo=n).alias("dist")) for n in sorted(STRATEGIES)))
    return rows.select("doc_id", F.inline(distances))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four functions by their SQL names."""
    register(spark)
    return _neighbours(spark, sf_dir, "md5(text)").selectExpr(
        "doc_id",
        "hamming_distance_string(a, b) AS by_string",
        "hamming_distance_bytes(unhex(a), unhex(b)) AS by_bytes",
        "check_hexstrings_within_dist(a, b, 20L) AS within",
        "check_bytes_arrays_within_dist(unhex(concat(a, b)), unhex(b), 0L) AS place",
    )


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from a constant by language and source, with subtotals."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", hamming_distance_string(F.md5("text"), F.lit("0" * 32), width=32).alias("d"))
    total = docs.rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("d").alias("sum_dist"), F.min("d").alias("min_dist"), F.max("d").alias("max_dist"))
    return total.select("lang", "source", "n", "sum_dist", "min_dist", "max_dist")


def similarity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("code"))
    return search.similarity_filter(rows, "code", "0" * 32, 56).select("doc_id", "dist")


def similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pairs_within(_codes(spark, sf_dir), LIMIT)


def band_join_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring digests and vectors' codes by bands alone."""
    codes = _codes(spark, sf_dir)
    return band_join(codes, codes, 17, F.col("a.id") < F.col("b.id"))


def theta_join_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    return theta_join(codes, codes, 17, F.col("a.id") < F.col("b.id"))


def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    return search.with_neighbour(codes, codes, LIMIT)


def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    return search.without_neighbour(codes, codes, LIMIT)


def top_k_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    return search.nearest(codes, codes, 3)


def nearest_to_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("code"))
    return search.nearest_to(rows, "code", "0" * 32, 10, "doc_id").select("doc_id", "dist")


def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _neighbours(spark, sf_dir, "md5(text)").select(hamming_distance_string("a", "b", width=32).alias("dist"))
    return rows.groupBy("dist").agg(F.count("*").alias("n"))


def consecutive_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return search.consecutive(turns, F.md5("text"), ["conv_id"], ["turn", "text"], 32).select("conv_id", "turn", "dist")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance 0 is equality of digests: counted, not paired."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def label_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of ones of the digests by label, and each label's rank by it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", hamming_distance_string(F.md5("text"), F.lit("0" * 32), width=32).alias("d"))
    sums = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("d").alias("sum_dist"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sum_dist"), "quality", "toxic")))


def long_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p4, with each packed row cut into pieces that are searched apart."""
    packed = F.unhex(F.array_join(F.transform("elems", lambda e: F.hex(e)), ""))
    rows = _elements(spark, sf_dir, 50).select("user_id", packed.alias("packed"))
    return search.first_match_long(rows, "user_id", md5(b"probe").digest(), 50, piece=8).select(F.col("id").alias("user_id"), "place")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents near one constant, another, both, or the first alone."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("code"))
    a, b = (search.similarity_filter(rows, "code", q, 60).select("doc_id") for q in ("0" * 32, "0f" * 16))
    kinds = {"either": a.union(b).distinct(), "both": a.intersect(b), "first": a.exceptAll(b)}
    out = [df.select(F.lit(kind).alias("kind"), "doc_id") for kind, df in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _from_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source", hamming_distance_string(F.md5("text"), F.lit("0" * 32), width=32).alias("d"))


def group_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from a constant by all subsets of language and source; ``level`` tells a subtotal from a null."""
    return _from_zero(spark, sf_dir).cube("lang", "source").agg(F.grouping_id("lang", "source").cast("long").alias("level"), F.count("*").alias("n"), F.sum("d").alias("sum_dist"))


def group_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by language and by source, without their combinations."""
    lang, source = F.col("lang"), F.col("source")
    sums = _from_zero(spark, sf_dir).groupingSets([[lang], [source]], lang, source).agg(F.count("*").alias("n"), F.sum("d").alias("sum_dist"), F.grouping_id().cast("long").alias("level"))
    return sums.select("lang", "source", "level", "n", "sum_dist")


def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """similarity_filter over a stream, written to files that outlive lost executors and read back."""
    path = shared_folder(spark, "stream")
    near = stream_within(stream(spark, sf_dir, "documents"), "text", "0" * 32, 56).select("doc_id", "dist")
    near.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(near.schema).parquet(f"{path}/out")


_ALL = (
    p1_string_distance, p1_sha256_distance, p1_odd_width, p2_bytes_distance, p3_within_dist, p4_first_match, p4_packed_first_match, p5_strategy_invariance,
    sql_functions, group_stats, similarity_filter, similarity_join, band_join_narrow, theta_join_narrow, semi_join, anti_join, top_k_neighbours,
    nearest_to_constant, distance_histogram, consecutive_distance, exact_duplicates, label_distance,
    long_first_match, set_operations, group_cube, group_sets, stream_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def _next(code: str) -> str:
    return f"n AS (SELECT a.doc_id, a.code AS a, b.code AS b FROM (SELECT doc_id, {code} AS code FROM documents) a JOIN (SELECT doc_id, {code} AS code FROM documents) b ON b.doc_id = a.doc_id + 1)"


def _xor(a: str, b: str) -> str:
    return f"CAST(bit_count(xor(from_hex({a})::BIT, from_hex({b})::BIT)) AS BIGINT)"


_CODES = """c AS (SELECT vec_id AS id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT AS code FROM embeddings)"""
_DIST = "CAST(bit_count(xor(a.code, b.code)) AS BIGINT)"


def _pairs(limit: int) -> str:
    return f"WITH {_CODES} SELECT a.id AS a_id, b.id AS b_id, {_DIST} AS dist FROM c a JOIN c b ON a.id < b.id WHERE {_DIST} <= {limit}"


def oracle_sql() -> dict[str, str]:
    zero = "'" + "0" * 32 + "'"
    probe = "md5('probe')"
    first = f"""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place,
        {_xor("md5(event_type || '|' || event_id)", probe)} AS d FROM events)
        SELECT user_id, CAST(coalesce(min(place) FILTER (WHERE d <= 50), -1) AS INTEGER) AS place FROM e GROUP BY user_id"""
    near_zero, near_other = (f"SELECT doc_id FROM documents WHERE {_xor('md5(text)', q)} <= 60" for q in (zero, "'" + "0f" * 16 + "'"))
    from_zero = f"(SELECT lang, source, {_xor('md5(text)', zero)} AS d FROM documents)"
    near = f"SELECT DISTINCT a.id FROM c a JOIN c b ON a.id <> b.id WHERE {_DIST} <= {LIMIT}"
    return {
        "p1_string_distance": f"WITH {_next('md5(text)')} SELECT doc_id, {_xor('a', 'b')} AS dist FROM n",
        "p1_sha256_distance": f"WITH {_next('sha256(text)')} SELECT doc_id, {_xor('a', 'b')} AS dist FROM n",
        "p1_odd_width": f"WITH {_next('substr(md5(text), 1, 31)')} SELECT doc_id, {_xor('a', 'b')} AS dist FROM n",
        "p2_bytes_distance": f"WITH {_next('md5(text)')} SELECT doc_id, {_xor('a', 'b')} AS dist FROM n",
        "p3_within_dist": f"""WITH {_next('md5(text)')} SELECT doc_id, CAST(k AS BIGINT) AS max_dist,
            CASE WHEN k > strlen(a) THEN true WHEN a = b THEN true ELSE {_xor('a', 'b')} <= k END AS within
            FROM n, (SELECT unnest([0, 20, 32, 33]) AS k)""",
        "p4_first_match": first,
        "p4_packed_first_match": first,
        "p5_strategy_invariance": f"WITH {_next('md5(text)')} SELECT doc_id, algo, {_xor('a', 'b')} AS dist FROM n, (SELECT unnest(['classic', 'extra', 'native', 'sse41']) AS algo)",
        "sql_functions": f"""WITH {_next('md5(text)')} SELECT doc_id, {_xor('a', 'b')} AS by_string, {_xor('a', 'b')} AS by_bytes,
            a = b OR {_xor('a', 'b')} <= 20 AS within, CAST(CASE WHEN a = b THEN 0 ELSE 1 END AS INTEGER) AS place FROM n""",
        "group_stats": f"""SELECT lang, source, count(*) AS n, CAST(sum(d) AS BIGINT) AS sum_dist, min(d) AS min_dist, max(d) AS max_dist
            FROM (SELECT lang, source, {_xor('md5(text)', zero)} AS d FROM documents) GROUP BY ROLLUP (lang, source)""",
        "similarity_filter": f"SELECT doc_id, {_xor('md5(text)', zero)} AS dist FROM documents WHERE {_xor('md5(text)', zero)} <= 56",
        "similarity_join": _pairs(LIMIT),
        "band_join_narrow": _pairs(17),
        "theta_join_narrow": _pairs(17),
        "semi_join": f"WITH {_CODES} {near}",
        "anti_join": f"WITH {_CODES}, y AS ({near}) SELECT id FROM c WHERE id NOT IN (SELECT id FROM y)",
        "top_k_neighbours": f"""WITH {_CODES}, p AS (SELECT a.id AS a_id, b.id AS b_id, {_DIST} AS dist FROM c a JOIN c b ON a.id <> b.id),
            r AS (SELECT a_id, CAST(row_number() OVER (PARTITION BY a_id ORDER BY dist, b_id) AS INTEGER) AS rank, b_id, dist FROM p) SELECT * FROM r WHERE rank <= 3""",
        "nearest_to_constant": f"SELECT doc_id, {_xor('md5(text)', zero)} AS dist FROM documents ORDER BY dist, doc_id LIMIT 10",
        "distance_histogram": f"WITH {_next('md5(text)')} SELECT {_xor('a', 'b')} AS dist, count(*) AS n FROM n GROUP BY 1",
        "consecutive_distance": f"""SELECT conv_id, turn, {_xor('code', 'before')} AS dist FROM (SELECT conv_id, turn, md5(text) AS code,
            lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before FROM conversations) WHERE before IS NOT NULL""",
        "exact_duplicates": "SELECT md5(text) AS code, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
        "label_distance": f"""WITH s AS (SELECT quality, toxic, count(*) AS n, CAST(sum({_xor('md5(text)', zero)}) AS BIGINT) AS sum_dist FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
            SELECT *, CAST(row_number() OVER (ORDER BY sum_dist DESC, quality, toxic) AS INTEGER) AS rank FROM s""",
        "long_first_match": first,
        "set_operations": f"""SELECT 'either' AS kind, doc_id FROM ({near_zero} UNION {near_other}) UNION ALL SELECT 'both', doc_id FROM ({near_zero} INTERSECT {near_other})
            UNION ALL SELECT 'first', doc_id FROM ({near_zero} EXCEPT ALL {near_other})""",
        "group_cube": f"SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS n, CAST(sum(d) AS BIGINT) AS sum_dist FROM {from_zero} GROUP BY CUBE (lang, source)",
        "group_sets": f"""SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS n, CAST(sum(d) AS BIGINT) AS sum_dist
            FROM {from_zero} GROUP BY GROUPING SETS ((lang), (source))""",
        "stream_filter": f"SELECT doc_id, {_xor('md5(text)', zero)} AS dist FROM documents WHERE {_xor('md5(text)', zero)} <= 56",
    }
