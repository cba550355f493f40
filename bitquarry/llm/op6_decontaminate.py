"""Operator 6: benchmark decontamination with an FM-index of each training shard.

A shard is what a task holds of the texts at a time (a few megabytes). Its words become symbols:
those that occur in test phrases get a number each, all others part the text like its ends, and
runs of symbols that are shorter than the shortest phrase are left out, as they cannot hold one.
The shard's suffix array gives its Burrows-Wheeler transform, which is kept as a wavelet tree;
phrases are searched from their last word to their first, all at once, by ranks in it. Occurrences
are located by stepping back to a sampled suffix position. Their spans are merged by document.

Phrases are written to the shared folder and read in blocks, so a task's memory doesn't grow with
the number of test items.

Defined cases: null and empty texts have no words; items without words or with a null id are left
out; items that repeat an id or a text are joined by id; repeated documents are judged alike; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm.common import filesystem, flat_bytes, shared_dir, sliced, text_of, tidy
from bitquarry.llm.text import ALNUM, words

WINDOW = 13
SHARD_BYTES, SAMPLE, PHRASES = 4 << 20, 8, 1 << 16


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit (zeros before ones on each level)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.ones, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(at)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, one = self.ones[level], (symbol >> b) & 1 == 1
            lo, up = ones[low], ones[at]
            low = np.where(one, self.zeros[level] + lo, low - lo)
            at = np.where(one, self.zeros[level] + up, at - up)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in range(self.bits):
            ones = self.ones[level]
            one = ones[at + 1] - ones[at]
            out = out * 2 + one
            at = np.where(one == 1, self.zeros[level] + ones[at], at - ones[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; 0 ends a run, and the zeros differ, in order of their places."""
    n = len(text)
    zero = text == 0
    n_zero = int(zero.sum())
    rank = text.astype(np.int64) + n_zero
    rank[zero] = np.arange(n_zero)
    k = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1 if k < n else 0
        sa = np.argsort(key, kind="stable")
        s = key[sa]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[sa] = new
        if new[-1] == n - 1 or k >= n:
            return sa
        k *= 2


class FmIndex:
    """Of a sequence of symbols from 1 on, in runs that each end with a 0."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        sa = suffix_array(text)
        last = text[sa - 1]  # of the first suffix: the sequence's final 0
        self.tree = WaveletTree(last, max(1, int(n_symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        kept = (sa % SAMPLE == 0) | (last == 0)  # every run's start is sampled, so no step crosses a 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = sa[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of all phrases, given as rows of symbols that end at the last column."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.tree.n, np.int64)
        for t in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= t) & (hi > lo))
            if not len(live):
                break
            c = phrases[live, -t]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            sampled = self.kept[rows + 1] > self.kept[rows]
            done = left[sampled]
            out[done] = self.places[self.kept[rows[sampled]]] + steps[done]
            left, rows = left[~sampled], rows[~sampled]
            c = self.tree.access(rows)
            rows = self.before[c] + self.tree.rank(c, rows)
            steps[left] += 1
        return out


def runs_of(symbols: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least ``least`` symbols over 0 within a document, each closed by a 0; and each symbol's place."""
    known = np.flatnonzero(symbols)
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(bounds, known, side="right")
    new = np.ones(len(known), bool)
    new[1:] = (np.diff(known) > 1) | (np.diff(row) > 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(known)))
    keep = size >= least
    own = known[np.repeat(keep, size)]
    size = size[keep]
    total = np.cumsum(size + 1)
    text, place = np.zeros(int(total[-1]) if len(total) else 0, np.int64), np.zeros(int(total[-1]) if len(total) else 0, np.int64)
    at = np.arange(len(own)) + np.repeat(np.arange(len(size)), size)
    text[at], place[at] = symbols[own], own
    return text, place


class Phrases:
    """A block of test phrases: their words as symbols, and the items that have them."""

    def __init__(self, packed: list[bytes], items: list[int]):
        keys = {p: i for i, p in enumerate(dict.fromkeys(packed))}
        of = np.array([keys[p] for p in packed])
        order = np.argsort(of, kind="stable")
        self.items, self.item_bounds = np.array(items, np.int64)[order], np.searchsorted(of[order], np.arange(len(keys) + 1))
        hashes = [np.frombuffer(p, "<u8") for p in keys]
        self.lengths = np.array([len(h) for h in hashes])
        self.vocabulary = np.unique(np.concatenate(hashes))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.rows = np.zeros((len(hashes), int(self.lengths.max())), np.int64)
        for i, h in enumerate(hashes):
            self.rows[i, -len(h) :] = np.searchsorted(self.vocabulary, h) + 1

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out

    def occurrences(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (phrase, place of its first word)."""
        text, place = runs_of(self.symbols(hashes), bounds, int(self.lengths.min()))
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = FmIndex(text, len(self.vocabulary))
        lo, hi = index.search(self.rows, self.lengths)
        n = hi - lo
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(lo)), n), place[index.locate(rows)]


def phrase_rows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """item_id and the packed word hashes of each of its windows; an item of fewer words is one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", SHARD_BYTES):
            hashes, bounds = words(*flat_bytes(b.column("text")), ALNUM)
            items, out = [], []
            for i, item in enumerate(b.column("item_id").to_pylist()):
                h = hashes[bounds[i] : bounds[i + 1]].astype("<u8")
                for at in range(max(1, len(h) - window + 1) if len(h) else 0):
                    items.append(item)
                    out.append(h[at : at + window].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(out, pa.binary())], names=["item_id", "phrase"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col)).where("item_id is not null")
    return rows.mapInArrow(run, "item_id long, phrase binary").distinct()


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with a window in the text, sorted as strings), and spans.

    ``spans`` are the merged hit spans to be removed: start and end in code points, end exclusive.
    """
    path = shared_dir(docs.sparkSession, "phrases")
    phrase_rows(benchmark, window, item_col, text_col).orderBy("phrase").write.parquet(path)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def blocks() -> Iterator[Phrases]:
        fs, at = filesystem(path)
        packed, items = [], []
        for b in pads.dataset(at, filesystem=fs, format="parquet").to_batches(columns=["phrase", "item_id"], batch_size=1 << 14):
            for p, i in zip(b.column("phrase").to_pylist(), b.column("item_id").to_pylist(), strict=True):
                if len(packed) >= PHRASES and p != packed[-1]:
                    yield Phrases(packed, items)
                    packed, items = [], []
                packed.append(p)
                items.append(i)
        if packed:
            yield Phrases(packed, items)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None  # the phrases, if they are one block
        for b in sliced(batches, "text", SHARD_BYTES):
            flat, offsets = flat_bytes(b.column("text"))
            hashes, bounds = words(flat, offsets, ALNUM)
            n = b.num_rows
            change = np.zeros(len(hashes) + 1, np.int32)
            pairs = [np.zeros((0, 2), np.int64)]
            got = [] if only is None else only
            for block in blocks() if only is None else only:
                if only is None:
                    got = [*got[:1], block]
                phrase, place = block.occurrences(hashes, bounds)
                np.add.at(change, place, 1)
                np.add.at(change, place + block.lengths[phrase], -1)
                row = np.searchsorted(bounds, place, side="right") - 1
                if len(row):
                    row, phrase = np.unique(np.column_stack([row, phrase]), axis=0).T
                    sizes = np.diff(block.item_bounds)[phrase]
                    at = np.repeat(block.item_bounds[phrase], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    pairs.append(np.unique(np.column_stack([np.repeat(row, sizes), block.items[at]]), axis=0))
            if only is None and len(got) < 2:
                only = got
            hit = np.cumsum(change)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[bounds[1:]] - total[bounds[:-1]]
            items: list[list[int]] = [[] for _ in range(n)]
            for r, i in np.unique(np.concatenate(pairs), axis=0).tolist():
                items[r].append(i)
            spans: list[list[dict]] = [[] for _ in range(n)]
            for r in np.flatnonzero(n_hit).tolist():
                spans[r] = _spans(flat[offsets[r] : offsets[r + 1]], hit[bounds[r] : bounds[r + 1]])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(bounds)), pa.array(n_hit), pa.array([sorted(x, key=str) for x in items], pa.list_(pa.int64())), pa.array(spans, pa.list_(span))],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id").cast("long"), text_of(text_col))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>")


def _spans(data: np.ndarray, hit: np.ndarray) -> list[dict]:
    """Merged spans of hit words, in code points."""
    inside = ALNUM[data]
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
    return [{"start": int(points[starts[a]]), "end": int(points[stops[z]])} for a, z in zip(first, last, strict=True)]


def contaminated() -> Column:
    """A document whose hit words are a twentieth of its words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_overlaps(docs, benchmark)
    joined = F.array_join(F.col("items").cast("array<string>"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), contaminated().alias("contaminated"))
