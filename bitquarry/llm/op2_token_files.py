"""Operator 2: token-id files with fixed-width bit packing.

Each id takes the minimum number of bits of its vocabulary. A file holds, little-endian:
magic ``BPK1``; bits, ids in a block, documents, ids, blocks (5 x uint64); block byte offsets
(blocks + 1 x uint64); document ids (int64; the smallest value stands for null); document id
counts (uint64); the blocks. Bit k of an id stands at bit ``i * bits + k`` of its block, so that
8 ids fill ``bits`` whole bytes and numpy packs or unpacks them lane by lane; any id of the file
can be read from the one block that holds it.

Defined cases: a null text is empty and has the end id alone; rows with a null doc_id come first;
repeated rows are written as often as they come (ties in doc_id by text); an empty table gives no
file and no row; other columns of the input are not looked at.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm.common import filesystem, flat_bytes, saved, shared_dir, sliced, text_of, write_file

TOKENIZER, END_ID = "word_bpe_49k.json", 2
MAGIC, BLOCK, FILE_IDS = b"BPK1", 1 << 13, 1 << 23
NULL_ID = -(1 << 63)
#: Entries of a worker's cache of pieces, the longest piece that is kept, and new pieces in a string; bytes of text cut at once.
CACHE, LONGEST, JOINED, PIECE = 600_000, 48, 1000, 8 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width little-endian bit packing; the last byte is filled up with zero bits."""
    n = len(ids)
    if bits == 16:
        return ids.astype("<u2").tobytes()
    lanes = np.zeros((-(-n // 8), 8), np.uint64)
    lanes.reshape(-1)[:n] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        v = lanes[:, k] << np.uint64(shift)
        for b in range(-(-(shift + bits) // 8)):
            out[:, at + b] |= ((v >> np.uint64(8 * b)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    raw = np.zeros(-(-n // 8) * bits, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    rows = raw.reshape(-1, bits).astype(np.uint64)
    out = np.zeros((len(rows), 8), np.uint32)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        v = np.zeros(len(rows), np.uint64)
        for b in range(-(-(shift + bits) // 8)):
            v |= rows[:, at + b] << np.uint64(8 * b)
        out[:, k] = (v >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.uint64)]).astype("<u8")
    head = MAGIC + struct.pack("<5Q", bits, BLOCK, len(doc_ids), len(ids), len(blocks))
    return b"".join([head, offsets.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), *blocks])


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read(44)
        if head[:4] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.bits, self.block, self.n_docs, self.n_ids, n_blocks = struct.unpack("<5Q", head[4:])
        self.offsets = np.frombuffer(self.file.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(self.file.read(8 * self.n_docs), "<i8")
        self.counts = np.frombuffer(self.file.read(8 * self.n_docs), "<u8").astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.base = 44 + 8 * (n_blocks + 1) + 16 * self.n_docs

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        a, z = start // self.block, (start + n - 1) // self.block
        self.file.seek(self.base + int(self.offsets[a]))
        data = self.file.read(int(self.offsets[z + 1] - self.offsets[a]))
        parts = []
        for b in range(a, z + 1):
            got = data[self.offsets[b] - self.offsets[a] : self.offsets[b + 1] - self.offsets[a]]
            parts.append(unpack(got, self.bits, min(self.block, self.n_ids - b * self.block)))
        ids = np.concatenate(parts)
        return ids[start - a * self.block : start - a * self.block + n]

    def close(self) -> None:
        self.file.close()


class CachedEncoder:
    """The tokenizers library over whole texts, each distinct piece between white space encoded once.

    The file's normaliser and pre-tokenizer never look across white space, so pieces between blanks, tabs and line ends
    are encoded by the library apart from their texts and their ids joined; new pieces go to it many in a string, and
    its offsets tell whose ids are whose. Texts of ASCII alone are lower-cased first, as the normaliser would. Texts
    with ``<|``, with which special tokens begin, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if not all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"special tokens that don't begin with <|: {path}")
        self.kind = np.dtype("<u2" if self.vocabulary() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces without special tokens."""
        out = []
        for i in range(0, len(pieces), JOINED):
            own = pieces[i : i + JOINED]
            e = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
            begins = np.cumsum([0, *map(len, own)]) + np.arange(len(own) + 1)
            tokens = np.fromiter((x[0] for x in e.offsets), np.int64, len(e.ids))
            at = (np.searchsorted(tokens, begins) * self.kind.itemsize).tolist()
            ids = np.array(e.ids, self.kind).tobytes()
            out += [ids[x:y] for x, y in zip(at, at[1:])]
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The packed ids of each text (none null), with the id ``end`` after them where it is given."""
        flat, offsets = flat_bytes(texts)  # some kernels go wrong on arrays that begin within their buffers
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(flat))
        special = pc.match_substring(texts, "<|")
        lower = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        split = pc.ascii_split_whitespace(pc.if_else(special, "", lower))
        words = split.flatten().dictionary_encode()
        # A letter or digit of ASCII and a stop or comma are never one word of the pre-tokenizer: final ones are pieces of their own.
        both = words.dictionary
        core = pc.ascii_rtrim(both, ".,")
        cut = pc.and_(pc.not_equal(pc.binary_length(core), pc.binary_length(both)), pc.match_substring_regex(core, "[A-Za-z0-9]$"))
        stops = _ends(both.filter(cut), core.filter(cut))
        cores = pa.concat_arrays([pc.if_else(cut, core, both), stops]).dictionary_encode()
        pieces = cores.dictionary.to_pylist()
        got = list(map(self.cache.get, pieces))
        new = [x for x, y in zip(pieces, got) if y is None]
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
            learnt = iter(self.learn(new))
            got = [next(learnt) if y is None else y for y in got]
            self.cache.update((x, y) for x, y in zip(pieces, got) if len(x) <= LONGEST)
        of = cores.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tail = np.full(len(both), -1)
        tail[np.flatnonzero(cut.to_numpy(zero_copy_only=False))] = of[len(both) :]
        at, bounds = words.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        at = np.column_stack([of[: len(both)][at], tail[at]]).reshape(-1)
        there = at >= 0
        bounds = np.concatenate([[0], np.cumsum(there)])[2 * bounds]
        at = at[there]
        # Whole texts with special tokens, and the end id, are pieces of their own, put in at their places.
        extra = [(int(bounds[i]), self.whole(texts_of)) for i, texts_of in _chosen(special, texts)]
        if extra:
            at = np.insert(at, [p for p, _ in extra], len(got) + np.arange(len(extra)))
            bounds = bounds + np.concatenate([[0], np.cumsum(special.to_numpy(zero_copy_only=False))])
            got += [x for _, x in extra]
        if end is not None:
            at = np.insert(at, bounds[1:], len(got))
            bounds = bounds + np.arange(len(bounds))
            got.append(np.array([end], self.kind).tobytes())
        ids = np.frombuffer(b"".join(got), self.kind)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize
        starts, n = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((ends[bounds] * self.kind.itemsize).astype(np.int64)), pa.py_buffer(out)])


def _ends(whole: pa.Array, begins: pa.Array) -> pa.Array:
    """What follows each of the beginnings."""
    values, offsets = flat_bytes(whole)
    n = pc.binary_length(whole).to_numpy() - pc.binary_length(begins).to_numpy()
    out = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    at = np.arange(out[-1]) + np.repeat(offsets[1:] - n - out[:-1], n)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(out), pa.py_buffer(values[at]))


def _chosen(mask: pa.Array, texts: pa.Array) -> list[tuple[int, str]]:
    return list(zip(np.flatnonzero(mask.to_numpy(zero_copy_only=False)).tolist(), texts.filter(mask).to_pylist(), strict=True))


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts' ids in ascending id order. Returns the manifest: bucket, part, uri, n_docs, n_ids.

    Ids are dealt out by range of doc_id, with bounds from a quantile sketch of that column alone,
    after encoding: the packed ids are what is shuffled. Each task writes files of a bounded number
    of ids under names of its own, so that a repeated task does no harm; the manifest names the
    files of the attempts that counted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(rows.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    bounds = [int(b) for b in bounds]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in sliced(batches, "text", PIECE):
            ids = enc.encode(b.column("text"), end_id).cast(pa.binary())
            keys = b.column("doc_id").to_pylist()
            bucket = [0 if k is None else bisect_left(bounds, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), b.column("doc_id"), ids], names=["bucket", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind, bits = enc.kind, bits_for(enc.vocabulary())
        tag, held, keys, bucket, total, part = uuid.uuid4().hex, [], [], None, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, keys, total, part
            ids = np.frombuffer(b"".join(held), kind)
            counts = np.array([len(h) // kind.itemsize for h in held])
            uri = f"{folder}/{bucket:08d}-{part:06d}-{tag}.bpk"
            write_file(uri, file_bytes(np.array([NULL_ID if k is None else k for k in keys], np.int64), counts, ids, bits))
            row = pa.RecordBatch.from_pylist([{"bucket": bucket, "part": part, "uri": uri, "n_docs": len(keys), "n_ids": len(ids)}], schema=_MANIFEST)
            held, keys, total, part = [], [], 0, part + 1
            return row

        for b in batches:
            for at, key, ids in zip(b.column("bucket").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if held and (at != bucket or total >= FILE_IDS):
                    yield flush()
                if at != bucket:
                    bucket, part = at, 0
                held.append(ids)
                keys.append(key)
                total += len(ids) // kind.itemsize
        if held:
            yield flush()

    coded = rows.mapInArrow(encode, "bucket int, doc_id long, ids binary")
    dealt = coded.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    return saved(dealt.mapInArrow(write, "bucket int, part int, uri string, n_docs long, n_ids long"), "token-manifest")


_MANIFEST = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids (packed unsigned 32-bit), ids_crc32.

    The manifest has one small row for each file, of millions of ids each; their sizes are summed
    up on the driver to give each file its place.
    """
    spark = manifest.sparkSession
    files, start = [], 0
    for r in manifest.orderBy("bucket", "part").collect():
        files.append((r.uri, start))
        start += r.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist(), strict=True):
                f = TokenFile(uri)
                i = 0
                while i < f.n_docs:
                    j = max(i + 1, int(np.searchsorted(f.starts, f.starts[i] + (1 << 20))))
                    ids = f.read(int(f.starts[i]), int(f.counts[i:j].sum())).astype("<u4")
                    at = np.concatenate([[0], np.cumsum(f.counts[i:j])])
                    crc = [zlib.crc32(ids[at[k] : at[k + 1]]) for k in range(j - i)]
                    keys = pa.array(f.doc_ids[i:j], mask=f.doc_ids[i:j] == NULL_ID)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(base + f.starts[i:j]), pa.array(f.counts[i:j]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j
                f.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(files, "uri string, base long").repartition(len(files))
    return listed.mapInArrow(read, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, shared_dir(spark, "token-files"), public_tokenizers.path(TOKENIZER))
    return read_token_files(manifest)
