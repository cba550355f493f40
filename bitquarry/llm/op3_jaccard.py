"""Operator 3: n-gram Jaccard join with R-trees over count vectors.

A text's set is its distinct hashes of k-word shingles. Its tokens are hashed into groups.

1. Families. Two sets over the threshold differ in at most d tokens, d by their sizes, so of d + 1 groups one holds
   the same tokens in both: each set's groups, by the hash of what they hold, are its signatures, and sets that share one
   are of one family, directly or through others. Sizes are parted into bands so wide that only neighbours
   can link; each set signs for its own band and the next. Some groups more than d + 1 are made, and as many need not
   sign: in each set those that say least, empty ones and then those whose tokens are the most frequent in the corpus.
   Some more than that, a share of d, are made and sign, so that sets that link share several signatures: a set that shares
   fewer with others links with none and goes, then those that shared with it alone, and so on. So meetings by chance,
   of which a set has the more the larger the corpus is, don't chain strangers into families. A signature is
   shuffled as its gap from the one before it and a short hash of its set, 10 bytes together. Signatures
   and sets that the shorter hashes confuse only make a family larger, for links are verified on the sets.
2. Join. The sets of a family, in shards of bounded size if it is large, are joined shard by shard: a set is the
   point of its counts by group, R-trees index the points, two sets share at most the sum of the smaller counts, and
   with anything below a tree's node at most the sum of the minima with the node's largest counts. What the bounds
   leave, and what no links found so far connect, is verified on the sets; the links that connect are kept.
3. Components of the links.

Links between sets that others already connect within a shard or two are not listed, for they change nothing.
The work on a family of m different sets that don't link grows with m * m vector operations; the rows don't.

Defined cases: null and empty texts and those without words have an empty set, which links with
nothing; repeated rows are copies of each other; rows with a null id link with nothing
and have a null component; an empty table gives an empty result; other columns
are not looked at. Sets are known by 128-bit hashes, their members by 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm.common import bounded_batches, discard, drop_shuffles, flat_bytes, saved, saved_paths, sliced, text_of, tidy
from bitquarry.llm.components import components
from bitquarry.llm.text import NOT_SPACE, distinct_by_row, mix, shingles, words

WORDS, PERCENT = 4, 85
#: Entries of a leaf of a tree and children of a node.
LEAF, FAN = 64, 8
#: Groups of a point for sets of fewer shingles than stated: the bound stays sharp while sets have few shingles a group.
GROUPS = ((4096, 128), (32768, 1024), (1 << 62, 8192))
#: Bytes of text cut at once; bytes whose families a task folds at once.
PIECE, CHUNK = 1 << 20, 16 << 20
#: Tokens that count as frequent: so many at most, each in a share of some chunk of texts.
FREQUENT, SHARE = 1 << 16, 0.0005
#: Signatures are cut to KEY_BITS, sets' first hashes to NODE_BITS: of 10^10 signatures and 4 * 10^7 sets, some hundred thousand
#: and some hundred pairs meet by chance. A chunk's signatures are dealt by their first RANGE_BITS; what follows those, and a node,
#: takes 40 bits at most.
KEY_BITS, NODE_BITS, RANGE_BITS = 48, 40, 12
#: The bit of a signature that tells the two bands of a set apart.
BAND = np.uint64(1 << (64 - KEY_BITS))
#: Of the groups in which sets that link may differ, one in MORE gives a further group that signs; there is one further group at least.
MORE = 8
#: Rounds in which sets that share too few signatures go, at most, and the share of rows gone in a round below which it is the last.
ROUNDS, FEW = 12, 0.01
#: Tokens of a shard of a family (a larger set is one by itself): a task holds two shards.
SHARD = 1 << 21
#: Buckets of document ids, of which those that hold a wanted text are sent to all tasks.
BUCKETS = 1 << 20


@lru_cache
def bands(percent: int) -> np.ndarray:
    """The least size of each band: sets that link are of one band or of neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def further(differ: int) -> int:
    """Groups that sign beyond those that make sure of a shared one, by the number of differing tokens."""
    return 1 + differ // MORE if differ else 0


def least_shared(n: Column, percent: int) -> Column:
    """Of a set of ``n`` tokens that links with another: signatures of one band that it shares with others, at least.

    One fewer than ``further`` promises where that leaves two, for the cut of two signatures may be the same.
    """
    differ = F.floor(2 * n * (100 - percent) / (100 + percent))  # that of its band is no smaller
    return F.when(differ > 0, F.greatest(F.lit(2), 1 + F.floor(differ / MORE))).otherwise(1)


@lru_cache
def levels(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs whose larger set is of a band: the groups to make, and how many of a set's need not sign.

    Of sets that link at least ``1 + further(differ)`` groups that are alike sign in both.
    """
    at = bands(percent)
    groups, spare = [], []
    for b in range(len(at) - 1):
        differ = 2 * (int(at[b + 1]) - 1) * (100 - percent) // (100 + percent)
        weak, least = 0, differ + 1 + further(differ)
        for _ in range(8):  # groups that a set of the band below is likely to leave empty, twice over
            weak = int(2 * (least + weak) * exp(-int(at[max(0, b - 1)]) / (least + weak)) + 1) if differ else 0
        groups.append(least + weak)
        spare.append(weak)
    return np.array(groups, np.int64), np.array(spare, np.int64)


@dataclass(frozen=True)
class Jaccard:
    """Shingles of ``words`` words; two sets link if 100 times their intersection is at least ``percent`` times their union."""

    words: int = WORDS
    percent: int = PERCENT

    def linked(self, shared, n, m):
        return 100 * shared >= self.percent * (n + m - shared)

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        values, bounds = self.flat_sets(column)
        return [values[bounds[i] : bounds[i + 1]] for i in range(len(column))]

    def flat_sets(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' sets one after the other, and each text's bounds in them."""
        hashes, bounds = words(*flat_bytes(column), NOT_SPACE)
        return distinct_by_row(*shingles(hashes, bounds, self.words))


def identities(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, as signed 64-bit integers; 0 for empty sets."""
    n = np.diff(bounds).astype(np.uint64)
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(seed)))])
        out.append(np.where(n > 0, mix((total[bounds[1:]] - total[bounds[:-1]]) ^ n), np.uint64(0)).view(np.int64))
    return out[0], out[1]


def signatures(values: np.ndarray, bounds: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (unsigned) of the sets, and the set of each. ``frequent``, ``counts``: sorted tokens that many texts have, and how many.

    A set's groups are in an order that what they hold alone fixes: those with a token that isn't frequent, then the others by their rarest token,
    the more frequent the later, empty ones last. The last ``spare`` of them don't sign. Of the groups that hold the same in two sets that link, all but the last ``spare``
    in this order are then none of the last ``spare`` of either. The last bit that is left of a signature when it is cut is that of its band.
    """
    at, (groups, spare) = bands(percent), levels(percent)
    n = np.diff(bounds)
    live = np.flatnonzero(n > 0)
    if not len(live):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = np.searchsorted(at, n, side="right") - 1
    rarity = np.full(len(values), 63, np.uint8)
    if len(frequent):
        found = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        rarity = np.where(frequent[found] == values, (62 - np.log2(counts).astype(np.uint8))[found], rarity)
    hashed, spread = mix(values ^ np.uint64(0xD6E8FEB86659FD93)), (values >> np.uint64(32)).astype(np.int64)
    low, high = (hashed & np.uint64(0xFFFFFFFF)).astype(np.float64), (hashed >> np.uint64(32)).astype(np.float64)
    names, owners = [], []
    for up in (0, 1):
        level = np.where(n > 0, own + up, 0)
        g = np.where(n > 0, groups[level], 0)
        first = np.concatenate([[0], np.cumsum(g)])
        place = np.repeat(first[:-1], n) + (spread * np.repeat(g, n) >> 32)  # ascending, as a set's values are
        total = first[-1]
        # Sums of 32-bit halves are exact in doubles for sets of fewer than 2^21 tokens a group.
        sums = np.bincount(place, weights=low, minlength=total).astype(np.uint64) + (np.bincount(place, weights=high, minlength=total).astype(np.uint64) << np.uint64(32))
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        rank = np.zeros(total, np.uint64)
        rank[place[starts]] = np.maximum.reduceat(rarity, starts)
        owner = np.repeat(np.arange(len(n)), g)
        number = np.arange(total) - np.repeat(first[:-1], g)
        tag = (level.astype(np.uint64)[owner] << np.uint64(40)) + number.astype(np.uint64)
        name = mix(sums ^ mix(tag))
        name = (name & ~BAND) | (level.astype(np.uint64)[owner] << np.uint64(64 - KEY_BITS) & BAND)
        rank = (rank << np.uint64(58)) | (name >> np.uint64(6))
        order = np.lexsort((rank, owner))
        least = rank[order[first[:-1][live] + spare[level[live]]]]  # of each set's groups that sign; any alike sign too
        signs = rank >= np.repeat(least, g[live])
        names.append(name[signs])
        owners.append(owner[signs])
    return np.concatenate(names), np.concatenate(owners)


def once(names: np.ndarray, owners: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and nodes of these sets, those of equal sets once."""
    first = np.zeros(len(nodes), bool)
    first[np.unique(nodes, return_index=True)[1]] = True
    kept = first[owners]
    return names[kept], nodes[owners[kept]]


def packed(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """Signatures and their sets' first hashes, a row for each range of signatures: the gaps between those in ascending order, and the nodes.

    Numbers are stored as their lower 32 and upper 8 bits; in chunks of the usual size the gaps' upper bits are zeros, which the shuffle's compression takes out.
    """
    keys, nodes = keys.view(np.uint64) >> np.uint64(64 - KEY_BITS), short_nodes(nodes)
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    low = np.uint64(KEY_BITS - RANGE_BITS)
    ranges, starts = np.unique(keys >> low, return_index=True)
    gaps = np.diff(keys, prepend=np.uint64(0))
    gaps[starts] = keys[starts] - (ranges << low)
    ends = np.append(starts, len(keys))

    def column(values: np.ndarray) -> pa.Array:
        offsets = (ends * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ranges), [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    halves = [column(half) for x in (gaps, nodes) for half in (x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint8))]
    return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), *halves], names=["range", "gaps", "gaps_up", "nodes", "nodes_up"])


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The signatures (cut to KEY_BITS) and short nodes of ``packed`` rows."""
    (gaps, bounds), (gaps_up, starts), (nodes, _), (nodes_up, _) = (flat_bytes(batch.column(c)) for c in ("gaps", "gaps_up", "nodes", "nodes_up"))
    gaps, nodes = (low.view(np.uint32).astype(np.uint64) | (up.astype(np.uint64) << np.uint64(32)) for low, up in ((gaps, gaps_up), (nodes, nodes_up)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gaps)])
    first = (batch.column("range").to_numpy().astype(np.uint64) << np.uint64(KEY_BITS - RANGE_BITS)) - sums[starts[:-1]]  # wraps around, and back
    return sums[1:] + np.repeat(first, np.diff(starts)), nodes


def short_nodes(nodes: np.ndarray) -> np.ndarray:
    return nodes.view(np.uint64) >> np.uint64(64 - NODE_BITS)


def shared(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures that several nodes have, and these nodes, each once."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    as_before = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
    many = as_before[:-1] | as_before[1:] if len(keys) else np.zeros(0, bool)
    return keys[many], nodes[many]


def meetings(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a node and the least node with which it shares a signature."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    low = np.repeat(np.minimum.reduceat(nodes, starts), np.diff(np.append(starts, len(keys)))) if len(keys) else nodes
    met = np.unique(np.stack([nodes, low], axis=1)[nodes != low], axis=0)
    return met[:, 0], met[:, 1]


def point(tokens: np.ndarray) -> np.ndarray:
    groups = next(g for most, g in GROUPS if len(tokens) < most)
    return np.minimum(np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 65535).astype(np.uint16)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """The same point with fewer groups."""
    return p if len(p) == groups else np.minimum(p.reshape(-1, groups).sum(axis=0, dtype=np.int64), 65535).astype(np.uint16)


def shared_by(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


class CountTree:
    """R-tree of count vectors that come in ascending order of their sums.

    Entries fill a leaf after the other and leaves an inner node after the other, so that a node's sums are a short range;
    nodes hold the largest count of each group, and queries pass over nodes and entries by summed minima, from the root down. Counts
    are cut at 65,535, which only loosens the bound: it then stays true through ``slack``.
    """

    def __init__(self, measure: Jaccard, groups: int):
        self.measure, self.n, self.slack = measure, 0, 0
        self.sizes = np.zeros(LEAF, np.int64)
        self.levels = [np.zeros((LEAF, groups), np.uint16), np.zeros((1, groups), np.uint16)]  # entries, leaves, inner nodes up to a root
        self.spans = [1, LEAF]  # entries below a node of each level

    def add(self, p: np.ndarray, size: int) -> None:
        if self.n == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sizes[self.n] = size
        if self.n == self.spans[-1]:  # the root is full: it becomes a child of a new one
            self.levels.append(self.levels[-1][:1].copy())
            self.spans.append(self.spans[-1] * FAN)
        for k, span in enumerate(self.spans):
            at = self.n // span
            if at == len(self.levels[k]):
                self.levels[k] = np.concatenate([self.levels[k], np.zeros_like(self.levels[k])])
            np.maximum(self.levels[k][at], p, out=self.levels[k][at])
        self.slack = max(self.slack, size - int(p.sum(dtype=np.int64)))
        self.n += 1

    def near(self, p: np.ndarray, size: int) -> np.ndarray:
        """Entries that the bounds leave, for a vector of at least their size."""
        first = int(np.searchsorted(self.sizes[: self.n], -(-self.measure.percent * size // 100)))
        if first >= self.n:
            return np.zeros(0, np.int64)
        slack = self.slack + size - int(p.sum(dtype=np.int64))
        at = np.zeros(1, np.int64)
        for k in range(len(self.spans) - 1, -1, -1):
            span = self.spans[k]
            at = at[((at + 1) * span > first) & (at * span < self.n)]
            shared = np.minimum(self.levels[k][at], p).sum(axis=1, dtype=np.int64) + slack
            least = self.sizes[np.maximum(at * span, first)]
            at = at[self.measure.linked(np.minimum(shared, size if k else least), size, least)]
            if k and len(at):
                fan = span // self.spans[k - 1]
                at = (at[:, None] * fan + np.arange(fan)).reshape(-1)
        return at


class CountForest:
    """A tree for each number of groups; sets come in ascending order of their sizes."""

    def __init__(self, measure: Jaccard):
        self.measure, self.n = measure, 0
        self.trees: dict[int, tuple[CountTree, list[int]]] = {}

    def add(self, p: np.ndarray, size: int) -> None:
        if len(p) not in self.trees:
            self.trees[len(p)] = CountTree(self.measure, len(p)), []
        tree, places = self.trees[len(p)]
        tree.add(p, size)
        places.append(self.n)
        self.n += 1

    def near(self, p: np.ndarray, size: int) -> list[int]:
        """Places, in the order of adding, of what the bounds leave."""
        return [places[i] for groups, (tree, places) in self.trees.items() for i in tree.near(folded(p, groups), size).tolist()]


def frequent_tokens(rows: DataFrame, measure: Jaccard) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that most texts have, FREQUENT at most, sorted, and their counts; counted where a share of some CHUNK of texts has them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, n, held = [], 0, 0

        def flush() -> pa.RecordBatch:
            tokens, count = np.unique(np.concatenate(sets), return_counts=True)
            some = count >= max(4, SHARE * n)
            return pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(count[some])], names=["token", "n"])

        for b in sliced(batches, "text", PIECE):
            sets.append(measure.flat_sets(b.column("text"))[0])
            n += b.num_rows
            held += int(flat_bytes(b.column("text"))[1][-1])
            if held >= CHUNK:
                yield flush()
                sets, n, held = [], 0, 0
        if sets:
            yield flush()

    top = rows.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)
    found = top.toArrow()
    tokens, counts = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def described(docs: DataFrame, measure: Jaccard, id_col: str, text_col: str) -> DataFrame:
    """row (its number), doc_id, n, h1, h2 (the set's identity) of each text, written out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", PIECE):
            values, bounds = measure.flat_sets(b.column("text"))
            h1, h2 = identities(values, bounds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds)), pa.array(h1), pa.array(h2)], names=["doc_id", "n", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col))
    return saved(rows.mapInArrow(run, "doc_id long, n long, h1 long, h2 long").withColumn("row", F.monotonically_increasing_id()), "sets")


def relatives(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct a, b (short nodes) that connect the sets that share signatures, written out, but no set that shares fewer than one that links.

    ``met``: key, node of signatures that several nodes have; ``nodes``: h1 and n of each set.
    """
    spark = met.sparkSession
    node = F.shiftrightunsigned("h1", 64 - NODE_BITS).alias("node")
    least = nodes.select(node, "n").groupBy("node").agg(F.min("n").alias("n")).select("node", least_shared(F.col("n"), percent).alias("least"))
    least, asked = saved_paths(least.join(met.select("node").distinct(), "node"), "least-shared")
    before, path = met.count(), None
    for _ in range(ROUNDS):
        unit = met.groupBy("node", F.col("key").bitwiseAND(1).alias("band")).agg(F.count("*").alias("shares"))
        enough = unit.join(least, "node").where("shares >= least").select("node", "band")
        kept, first = saved_paths(met.withColumn("band", F.col("key").bitwiseAND(1)).join(enough, ["node", "band"]).select("key", "node"), "sharing")
        keys = kept.groupBy("key").agg(F.count("*").alias("sets"), F.min("node").alias("low")).where("sets > 1").select("key", "low")
        met, second = saved_paths(kept.join(keys, "key").select("key", "node", "low"), "sharing")
        for old in (first, path):
            if old:
                discard(spark, old)
        drop_shuffles(spark)
        before, path, gone = met.count(), second, before - met.count()
        if gone <= FEW * (before + gone):
            break
    out = saved(met.where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "relatives")
    for old in (path, asked):
        discard(spark, old)
    return out


def families(docs: DataFrame, nodes: DataFrame, measure: Jaccard, id_col: str, text_col: str) -> DataFrame:
    """Step 1: node (short, of a set's first hash) and family of each set that shares signatures enough with others, written out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).where("doc_id is not null").select("text")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(rows, measure))  # FREQUENT numbers at most

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, owners, nodes, held, seen = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            return packed(*once(np.concatenate(names), np.concatenate(owners), np.concatenate(nodes)))

        for b in sliced(batches, "text", PIECE):
            values, bounds = measure.flat_sets(b.column("text"))
            node, _ = identities(values, bounds)
            name, owner = signatures(values, bounds, measure.percent, *frequent.value)
            names.append(name)
            owners.append(owner + seen)
            nodes.append(node)
            seen += len(node)
            held += int(flat_bytes(b.column("text"))[1][-1])
            if held >= CHUNK:
                yield flush()
                names, owners, nodes, held, seen = [], [], [], 0, 0
        if nodes:
            yield flush()

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []

        def flush(keep: int) -> pa.RecordBatch:
            """What is shared below signature ``keep``; the rest stays held."""
            k, n = np.concatenate(keys), np.concatenate(nodes)
            done = k < np.uint64(keep)
            keys[:], nodes[:] = [k[~done]], [n[~done]]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in shared(k[done], n[done])], names=["key", "node"])

        for b in batches:
            if not b.num_rows:
                continue
            k, n = unpacked(b)
            keys.append(k)
            nodes.append(n)
            last = b.column("range")[-1].as_py() << (KEY_BITS - RANGE_BITS)
            if int(keys[0][0]) < last:
                yield flush(last)
        if keys:
            yield flush(1 << KEY_BITS)

    signed = rows.mapInArrow(run, "range int, gaps binary, gaps_up binary, nodes binary, nodes_up binary")
    met = signed.repartition("range").sortWithinPartitions("range").mapInArrow(meet, "key long, node long")
    met, path = saved_paths(met, "met")
    edges = relatives(met, nodes, measure.percent)
    discard(docs.sparkSession, path)
    return components(edges).select("node", F.col("label").alias("family"))


def sharded(nodes: DataFrame, family: DataFrame) -> DataFrame:
    """row, doc_id, n, h1, h2, family, shard, shards: the sets of families, written out. ``nodes``: one row for each set."""
    # Sets that one short node confuses are of one family, whether or not it met another.
    known = nodes.withColumn("node", F.shiftrightunsigned("h1", 64 - NODE_BITS)).join(family, "node", "left")
    known = saved(known.withColumn("family", F.coalesce("family", "node")).drop("node"), "relations")
    sizes = known.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).where("sets > 1")
    shards = F.ceil(F.col("total") / SHARD).cast("int").alias("shards")
    both = known.join(sizes.select("family", shards), "family")
    return saved(both.withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")), "shards")


def joined(sets: list[tuple[int, int, np.ndarray]], measure: Jaccard, across: bool) -> list[tuple[int, int]]:
    """Links that connect all sets (row, shard, tokens) that link; ``across``: only those of different shards are asked."""
    sets = sorted(sets, key=lambda x: (len(x[2]), x[0]))
    shard = np.array([x[1] for x in sets])
    label, forest, links = np.arange(len(sets)), CountForest(measure), []
    for i, (row, _, tokens) in enumerate(sets):
        p, n = point(tokens), len(tokens)
        near = np.array(forest.near(p, n), np.int64)
        if across:
            near = near[shard[near] != shard[i]]
        for j in near[::-1].tolist():
            if label[j] != label[i] and measure.linked(shared_by(tokens, sets[j][2]), n, len(sets[j][2])):
                links.append((row, sets[j][0]))
                label[label == label[i]] = label[j]
        forest.add(p, n)
    return links


def linked(members: DataFrame, docs: DataFrame, measure: Jaccard, id_col: str, text_col: str) -> DataFrame:
    """Step 2: a, b (rows) of links that connect the sets of each family, written out."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    wanted = F.broadcast(members.select(bucket.alias("bucket")).distinct())  # BUCKETS numbers at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).where("doc_id is not null")
    # Few texts are shuffled that aren't asked for; the rest is one plan at every size.
    rows = rows.withColumn("bucket", bucket).join(wanted, "bucket", "left_semi").drop("bucket").join(members.hint("merge"), "doc_id")

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", PIECE):
            values, bounds = measure.flat_sets(b.column("text"))
            h1, h2 = identities(values, bounds)
            same = np.flatnonzero((h1 == b.column("h1").to_numpy()) & (h2 == b.column("h2").to_numpy()))
            tokens = pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in same.tolist()], pa.binary())
            own = b.take(pa.array(same))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("family", "shard", "shards", "row")), tokens], names=["family", "shard", "shards", "row", "tokens"])

    sets = rows.mapInArrow(cut, "family long, shard int, shards int, row long, tokens binary")
    blocks = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    blocks = blocks.select("family", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard", "row", "tokens")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def flush() -> pa.RecordBatch:
            links = joined(list(held.values()), measure, at[1] != at[2])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for family, i, j, shard, row, tokens in zip(*(b.column(c) for c in ("family", "i", "j", "shard", "row", "tokens")), strict=True):
                key = (family.as_py(), i.as_py(), j.as_py())
                if key != at:
                    if len(held) > 1:
                        yield flush()
                    at, held = key, {}
                held[row.as_py()] = (row.as_py(), shard.as_py(), np.frombuffer(tokens.as_py(), np.uint64))
        if len(held) > 1:
            yield flush()

    dealt = blocks.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return saved(dealt.mapInArrow(run, "a long, b long"), "links")


def jaccard_components(docs: DataFrame, measure: Jaccard = Jaccard(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    bounded_batches(docs.sparkSession)
    own = described(docs, measure, id_col, text_col)
    live = own.where("n > 0 and doc_id is not null")
    nodes = saved(live.groupBy("h1", "h2").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "nodes")
    members = sharded(nodes, families(docs, nodes, measure, id_col, text_col))
    drop_shuffles(docs.sparkSession)  # that of the signatures, before the families' texts and sets are shuffled
    labels = components(linked(members, docs, measure, id_col, text_col)).withColumnRenamed("node", "row")
    named = saved(nodes.join(labels, "row", "left").select("h1", "h2", F.coalesce("label", "row").alias("label"), "doc_id"), "named")
    least = saved(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    of = saved(named.join(least, "label").select("h1", "h2", "component_id"), "component-ids")
    out = own.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(of, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
