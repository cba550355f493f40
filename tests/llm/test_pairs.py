"""Operators 3, 9 and 10 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_tables import table
from pyspark.sql import functions as F

from bitquarry.llm import op3_jaccard
from bitquarry.llm.components import components
from bitquarry.llm.op3_jaccard import CountForest, Jaccard, jaccard_components, point
from bitquarry.llm.op9_top_k import top_k
from bitquarry.llm.op10_line_dedup import dedup_lines, op10_line_dedup, removed, signature, within_edits

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = SPLIT.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_components(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([2, 4, 8, 30, 90, 300]))
        for _ in range(rng.choice([1, 2, 4, 25])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    shared = "one very common passage that many of these texts have in common with each other"
    out += [shared + " " + " ".join(rng.choices(vocabulary, k=40)) for _ in range(60)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "percent", "chunk"), [(4, 85, 1 << 24), (5, 80, 1500)])
def test_components_equal_brute_force(spark, copies, odd_texts, k, percent, chunk, monkeypatch):
    monkeypatch.setattr(op3_jaccard, "CHUNK", chunk)  # small: most links cross the tasks' own joins
    texts = copies + odd_texts
    df = table(spark, texts).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, Jaccard(k, percent)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts, k, percent)


def test_signatures_are_shuffled_packed(spark):
    rng = np.random.default_rng(4)
    keys, nodes = (rng.integers(-(1 << 63), 1 << 63, 30_000) for _ in range(2))
    rows = op3_jaccard.packed(keys, nodes)
    assert sum(len(x) for c in rows.columns[1:] for x in c.to_pylist()) == 10 * len(keys) and rows.num_rows <= 1 << op3_jaccard.RANGE_BITS
    want = sorted(zip((keys.view(np.uint64) >> np.uint64(16)).tolist(), (nodes.view(np.uint64) >> np.uint64(24)).tolist(), strict=True))
    for part in ([rows], [rows.slice(0, 7), rows.slice(7)], [op3_jaccard.packed(keys[:1], nodes[:1]), op3_jaccard.packed(keys[1:], nodes[1:])]):
        back = [op3_jaccard.unpacked(x) for x in part]
        assert sorted(x for k, n in back for x in zip(k.tolist(), n.tolist(), strict=True)) == want
    a, b = op3_jaccard.meetings(np.array([5, 5, 7, 5, 7, 8], np.uint64), np.array([3, 1, 2, 1, 3, 9], np.uint64))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 1), (3, 2)]
    # Sets whose short nodes are alike are of one family, also if they met no other; a set alone is of none.
    sets = spark.createDataFrame([(-1, 1, 0, 0, 5), (-2, 2, 1, 1, 5), (1 << 40, 3, 2, 2, 5), (1 << 41, 4, 3, 3, 5), (1 << 42, 5, 4, 4, 5)], "h1 long, h2 long, row long, doc_id long, n long")
    family = spark.createDataFrame([(1 << 16, 7), (1 << 17, 7)], "node long, family long")
    got = sorted((r.family, r.row) for r in op3_jaccard.sharded(sets, family).collect())
    assert got == [(7, 2), (7, 3), ((1 << 40) - 1, 0), ((1 << 40) - 1, 1)]


def test_sets_that_link_share_as_many_signatures_as_they_must():
    rng, tried = np.random.default_rng(5), 0
    for percent in (80, 85):
        for n in [n for n in (8, 12, 30, 100, 700, 3000) for _ in range(8)]:
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
            least = -(-percent * n // 100)
            sets = [np.unique(pool[:n]), np.unique(pool[: rng.integers(least, n + 1)])]  # as far apart as links may be
            frequent = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()] for x in sets]))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            names, owners = op3_jaccard.signatures(np.concatenate(sets), bounds, percent, frequent, rng.integers(4, 1 << 20, len(frequent)))
            both = np.intersect1d(names[owners == 0], names[owners == 1])
            differ = [2 * len(x) * (100 - percent) // (100 + percent) for x in sets]
            need = 1 + max(map(op3_jaccard.further, differ))
            assert max(np.bincount((both & op3_jaccard.BAND > 0).astype(int))) >= need  # of one band
            tried += need > 2
    assert tried > 20


def test_sets_that_meet_by_chance_are_no_family(spark):
    """A chain of texts, each of which has a passage of the next, and near copies; before, whoever shared one signature was of one family."""
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(1 << 40)}" for _ in range(300)] for _ in range(120)]
    for a, b in zip(texts, texts[1:]):
        b[:14] = a[-14:]
    near = [t[:150] + ["other"] + t[151:] for t in texts[::12]]
    docs = table(spark, [" ".join(t) for t in texts + near]).repartition(3)
    measure = Jaccard(5, 80)
    own = op3_jaccard.described(docs, measure, "doc_id", "text")
    family = op3_jaccard.families(docs, own, measure, "doc_id", "text")
    members = op3_jaccard.sharded(own, family).groupBy("family").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).collect()
    assert sorted(r.ids for r in members) == [[12 * i, 120 + i] for i in range(10)]
    assert {r.doc_id: r.component_id for r in jaccard_components(docs, measure).collect()} == {i: i if i < 120 else 12 * (i - 120) for i in range(130)}


def test_sets_that_link_share_a_signature_and_strangers_none():
    rng = np.random.default_rng(2)
    measure, tried = Jaccard(4, 85), 0
    for n, share in [(n, share) for n in (1, 5, 12, 60, 400, 1500) for share in (0, 0.3, 0.9, 1) for _ in range(5)]:
        pool = rng.integers(0, 1 << 63, 3 * n + 5, dtype=np.uint64) * np.uint64(2)
        base, other = np.unique(pool[:n]), np.unique(pool[-n:])
        sets = [base, other, np.zeros(0, np.uint64)]
        for gone in (0, 0.02, 0.06):
            sets.append(np.union1d(base[rng.random(len(base)) >= gone], pool[n:][: rng.integers(0, n // 10 + 1)]))
        frequent = np.unique(np.concatenate([x[rng.random(len(x)) < share] for x in sets]))
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        names, owners = op3_jaccard.signatures(np.concatenate(sets), bounds, 85, frequent, rng.integers(4, 1 << 20, len(frequent)))
        by = [set(names[owners == i].tolist()) for i in range(len(sets))]
        assert not by[2] and (n < 60 or not by[0] & by[1])  # also where all tokens are frequent: empty groups are the last to sign
        for i in range(len(sets)):
            for j in range(i):
                if len(sets[i]) and len(sets[j]) and measure.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                    assert by[i] & by[j]
                    tried += 1
    assert tried > 100


def test_components_of_repeated_and_null_ids_and_empty_tables(spark, empty):
    df = table(spark, ["a b c d e", "a b c d e", "a b c d e", "x y z w v", None], [7, 7, 3, None, 1])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 2, None), (1, 0, 1)], key=str)
    assert jaccard_components(empty).count() == 0


def test_bounds_lose_no_link():
    rng = np.random.default_rng(3)
    measure = Jaccard(4, 85)
    for base in (3, 50, 3000, 4090, 33_000):
        whole = rng.integers(0, 1 << 63, 2 * base, dtype=np.uint64)
        sets = []
        for _ in range(12):
            s = np.union1d(whole[: base - rng.integers(0, base // 12 + 1)], rng.integers(0, 1 << 63, rng.integers(0, base // 12 + 1), dtype=np.uint64))
            sets.append(s)
        sets.sort(key=len)
        forest = CountForest(measure)
        for i, s in enumerate(sets):
            near = set(forest.near(point(s), len(s)))
            for j in range(i):
                if measure.linked(len(np.intersect1d(s, sets[j])), len(s), len(sets[j])):
                    assert j in near
            forest.add(point(s), len(s))


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1002] == 1000


def plain_top(rows, k, every):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("dims", [1, 7, 64])
def test_top_k_equals_brute_force(spark, dims):
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(0, 1) * 3 ** (d % 3) for d in range(dims)]) for i in range(400)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 450)]  # ties
    rows += [(1000, None), (1001, [None] * dims), (1002, [float("nan")] * dims), (1003, [float("inf")] * dims), (None, [1.0] * dims), (1050, [1.0] * (dims + 1)), (1100, [0.0] * dims)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, rank string, score string").repartition(3)
    assert sorted(map(tuple, top_k(df).collect())) == plain_top(rows, 5, 50)


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (3, [2.0]), (0, [5.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df).collect())) == [(0, 1, 3, 256 * 512), (0, 1, 3, 5 * 256 * 512)]
    assert top_k(df.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_dedup(texts, edits, least):
    first = {}
    for i, t in enumerate(texts):
        for j, line in enumerate(t.split("\n") if t is not None else []):
            if len(line) >= least:
                first.setdefault(line, (i, j))
    lines = sorted(first, key=first.get)
    counts = [Counter(line) for line in lines]

    def close(i, j):  # letters that only one of both has are edits as well
        a, b = counts[i], counts[j]
        return abs(len(lines[i]) - len(lines[j])) <= edits and (a - b).total() <= edits and (b - a).total() <= edits and edit_distance(lines[i], lines[j]) <= edits

    near = {b for n, b in enumerate(lines) if any(close(i, n) for i in range(n))}
    out = []
    for i, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        gone = [j for j, line in enumerate(t.split("\n")) if len(line) >= least and (line in near or first[line] != (i, j))]
        out.append((gone, "\n".join(line for j, line in enumerate(t.split("\n")) if j not in gone)))
    return out


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_line_dedup_equals_brute_force(spark, edits, tmp_path):
    rng = random.Random(edits)
    base = ["".join(rng.choices("abcé ", k=rng.randint(3, 40))) for _ in range(25)]

    def changed(line):
        w = list(line)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "日"])
        return "".join(w)

    texts = ["\n".join(changed(rng.choice(base)) for _ in range(rng.randint(1, 8))) for _ in range(45)] + [None, "", "\n\n", "short", base[0] + "\n", base[0]]
    df = table(spark, texts).repartition(3)
    want = plain_dedup(texts, edits, 6)
    got = {r.doc_id: r for r in dedup_lines(df, edits, 6).collect()}
    assert [got[i].text for i in range(len(texts))] == [None if w is None else w[1] for w in want]
    assert dedup_lines(df, edits, 6).columns == df.columns
    gone = {r["__id"]: r["__gone"] for r in removed(df, edits, 6).collect()}
    assert gone == {i: w[0] for i, w in enumerate(want) if w and w[0]}


def test_line_dedup_runs_no_python(spark, odd):
    for df in (dedup_lines(odd), removed(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_odd_tables(spark, odd, empty, odd_texts, tmp_path):
    assert dedup_lines(odd).count() == len(odd_texts)
    assert dedup_lines(empty).count() == 0
    line = "a line that is long enough to count"
    df = table(spark, [line, line, line + "!", line], [2, 2, None, 5])
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(df).collect()), key=str)
    assert got == sorted([(2, ""), (2, ""), (None, line + "!"), (5, "")], key=str)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in op10_line_dedup(spark, str(tmp_path)).where("doc_id is not null").collect()) == [(2, 1, 1, "0"), (2, 1, 1, "0"), (5, 1, 1, "0")]


@pytest.mark.parametrize("shared", [None, 3])
def test_line_dedup_rows_that_share_an_id_lose_their_own_lines(spark, shared, tmp_path):
    a1, a2, b1, c1 = (word * 7 for word in ("clean ", "alone ", "twice ", "early "))
    texts, ids = [f"{a1}\n{a2}", f"{b1}\n{b1}", f"{c1}\n{a2[::-1]}", c1], [shared, shared, shared, 9]
    df = table(spark, texts, ids)
    assert sorted(r.text for r in dedup_lines(df).collect()) == sorted([texts[0], b1, texts[2], ""])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op10_line_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(shared, 2, 0, ""), (shared, 2, 1, "1"), (shared, 2, 0, ""), (9, 1, 1, "0")], key=str)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_band_equals_levenshtein(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(1500):
        a = [rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        rows.append(("".join(a), "".join(b)))
    rows += [("x" * 3000, "x" * 2998 + "yy"), ("", ""), ("", "ab"), ("abcd", "")]
    apart = F.bit_count(signature(F.col("a")).bitwiseXOR(signature(F.col("b"))))
    got = spark.createDataFrame(rows, "a string, b string").select(within_edits(F.col("a"), F.col("b"), edits).alias("near"), apart.alias("apart"), F.levenshtein("a", "b").alias("d")).collect()
    assert all(r.near == (r.d <= edits) for r in got) and all(r.apart <= 4 * r.d for r in got)
