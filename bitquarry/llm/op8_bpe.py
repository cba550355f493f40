"""Operator 8: BPE encoding and decoding by a segment tree over adjacent pair ranks.

The leaves of the tree hold ``rank << 32 | position`` of each adjacent pair of a word, so that its
root is the leftmost of the lowest-ranked pairs. A merge changes three leaves, each in
logarithmic time; the word is done when the root holds no pair.

Pieces of ASCII and of the letters up to U+00FF are lower-cased and cut into words here; for others the library's own
normaliser and pre-tokenizer are asked, as their Unicode tables differ from Python's.

Defined cases: null and empty texts have no ids; repeated rows give repeated rows; a null id column
stays null; other columns of the input are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm.common import bounded_batches, sliced, text_of, tidy

TOKENIZER = "word_bpe_49k.json"
_NONE = 1 << 62
#: White space of the normaliser; str.split() also takes U+001C to U+001F, which are symbols here.
_SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROL = regex.compile("[\x1c-\x1f]")
#: Pieces that normalise to their lower case: ASCII and the letters of Latin-1, nothing that combines.
_LATIN = regex.compile("[\0-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: Entries that a worker's caches of the library's pieces and of words hold, and the longest key that is kept. When half of the
#: words are new, those that weren't asked for meanwhile are dropped.
CHUNKS, WORDS, LONGEST = 50_000, 450_000, 48


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """Byte-level BPE writes each byte as one printable character: itself, or the next free one from U+0100."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class SegmentTreeBpe:
    """Codec of one tokenizer file whose model is BPE with a word-end suffix over byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model["end_of_word_suffix"] or ""
        symbols = _byte_symbols()
        self.inner = [self.vocab[c] for c in symbols]
        self.last = [self.vocab[c + suffix] for c in symbols]
        self.pair = {self.vocab[a] << 20 | self.vocab[b]: rank << 32 for rank, (a, b) in enumerate(model["merges"])}
        self.made = [0] * len(model["merges"])
        for pair, rank in self.pair.items():
            a, b = model["merges"][rank >> 32]
            self.made[rank >> 32] = self.vocab[a + b]
        names = {i: t for t, i in (self.vocab | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" not in split or not all(t.startswith("<|") for t in self.special):
            raise ValueError(f"a pre-tokenizer or special tokens of another kind: {path}")
        self.words, self.latin_words = regex.compile(split, regex.ASCII), regex.compile(split)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.symbols = {c: b for b, c in enumerate(symbols)}
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.forget()

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(data)
        if n == 0:
            return []
        inner, pair = self.inner, self.pair
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if n == 1:
            return ids
        get, made = pair.get, self.made
        size = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            m = get(ids[i] << 20 | ids[i + 1])
            if m is not None:
                tree[size + i] = m | i
        for x in range(size + n - 2 >> 1, 0, -1):  # nodes after these hold no pair
            a, b = tree[2 * x], tree[2 * x + 1]
            tree[x] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while (top := tree[1]) != _NONE:
            i = top & 0xFFFFFFFF
            j = after[i]
            new = ids[i] = made[top >> 32]
            ids[j] = -1
            k = after[i] = after[j]
            p = before[i]
            m = None
            if k < n:
                before[k] = i
                m = get(new << 20 | ids[k])
            changed = [(size + i, _NONE if m is None else m | i)]
            if k < n and tree[size + j] != _NONE:
                changed.append((size + j, _NONE))
            if p >= 0:
                m = get(ids[p] << 20 | new)
                value = _NONE if m is None else m | p
                if tree[size + p] != value:
                    changed.append((size + p, value))
            for x, value in changed:
                tree[x] = value
                while x > 1:
                    other = tree[x ^ 1]
                    if other < value:
                        value = other
                    x >>= 1
                    if tree[x] == value:
                        break
                    tree[x] = value
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token of lower-cased ASCII and Latin-1."""
        got = self.word_cache.get(word)
        if got is None:
            got = self.old_words.get(word)
            if got is None:
                got = array("I", self.merge(word.encode())).tobytes()
            if len(word) <= LONGEST:
                if len(self.word_cache) >= WORDS // 2:
                    self.old_words, self.word_cache = self.word_cache, {}
                self.word_cache[word] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a piece without white space."""
        if chunk.isascii():
            return b"".join(map(self._word, self.words.findall(chunk.lower())))
        if _LATIN.fullmatch(chunk):
            return b"".join(map(self._word, self.latin_words.findall(chunk.lower())))
        got = self.chunk_cache.get(chunk)
        if got is None:
            symbols = self.symbols
            got = b"".join(array("I", self.merge(bytes([symbols[c] for c in w]))).tobytes() for w, _ in self.cut(self.normalise(chunk)))
            if len(chunk) <= LONGEST:
                if len(self.chunk_cache) >= CHUNKS:
                    self.chunk_cache.clear()
                self.chunk_cache[chunk] = got
        return got

    def _plain(self, text: str) -> bytes:
        text = text.lower() if text.isascii() or _LATIN.fullmatch(text) else text
        chunks = [x for x in _SPACE.split(text) if x] if _CONTROL.search(text) else text.split()
        known, out = self.word_cache, []
        for c in chunks:
            got = known.get(c)  # a piece that is a known word is that word alone
            if got is None:
                got = self._chunk(c)
                known = self.word_cache
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, special tokens of the file taken where their strings stand."""
        if self.specials is None or "<|" not in text:
            return np.frombuffer(self._plain(text), dtype="<u4")
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), dtype="<u4")

    def forget(self) -> None:
        self.chunk_cache: dict[str, bytes] = {}
        self.word_cache: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder, so tokens are joined by spaces; unknown ids are left out."""
        return " ".join(map(self.names.__getitem__, ids))


_CODECS: dict[str, SegmentTreeBpe] = {}


def codec(path: str) -> SegmentTreeBpe:
    """One codec for each worker and file; its caches outlive a task."""
    if path not in _CODECS:
        _CODECS[path] = SegmentTreeBpe(path)
    return _CODECS[path]


def _each(path: str, emit: Callable[[SegmentTreeBpe, str], tuple], schema: pa.Schema) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in sliced(batches, "text"):
            rows = [emit(bpe, t) for t in b.column("text").to_pylist()]
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *columns], schema=schema)
        bpe.forget()  # an idle worker keeps its memory

    return run


def _full(bpe: SegmentTreeBpe, text: str) -> tuple:
    ids = bpe.encode(text)
    return len(ids), ids.astype(np.int32), bpe.decode(ids.tolist())


_DECIMAL: list[str] = []


def _digest(bpe: SegmentTreeBpe, text: str) -> tuple:
    ids = bpe.encode(text).tolist()
    decoded = bpe.decode(ids)
    if not _DECIMAL:
        _DECIMAL.extend(map(str, range(len(bpe.names))))
    line = " ".join(map(_DECIMAL.__getitem__, ids))
    return len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids of every text and the text decoded from them.

    Returns doc_id, n_tokens, and either ids (array) and decoded (string), or with ``digests`` the
    SHA-256 of both, made in the same pass so that the ids need not leave the worker.
    """
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col))
    base = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    if digests:
        schema = pa.schema([*base, ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        return rows.mapInArrow(_each(path, _digest, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    schema = pa.schema([*base, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return rows.mapInArrow(_each(path, _full, schema), "doc_id long, n_tokens long, ids array<int>, decoded string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
