"""Operators 2 and 8 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bitquarry.llm.common import shared_dir
from bitquarry.llm.op2_token_files import END_ID, TokenFile, bits_for, encoder, file_bytes, pack, read_token_files, unpack, write_token_files
from bitquarry.llm.op8_bpe import SegmentTreeBpe, codec, encode_decode, tokenizer_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 15, 16, 17, 20, 31, 32])
def test_packing_round_trip(bits):
    for n in (0, 1, 7, 8, 9, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint32)
        data = pack(ids, bits)
        assert len(data) == -(-n * bits // 8) and (unpack(data, bits, n) == ids).all()
    assert [bits_for(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access(tmp_path):
    ids = np.random.default_rng(1).integers(0, 1 << 17, 50_000).astype(np.uint32)
    counts = np.array([0, 10, 40_000, 9_990])
    (tmp_path / "x.bpk").write_bytes(file_bytes(np.array([3, 5, 8, 9]), counts, ids, 17))
    f = TokenFile(str(tmp_path / "x.bpk"))
    for a, n in ((0, 50_000), (0, 0), (8191, 2), (8192, 1), (49_999, 1), (123, 30_000)):
        assert (f.read(a, n) == ids[a : a + n]).all()
    assert f.starts.tolist() == [0, 0, 10, 40_010]
    f.close()


def test_files_hold_what_the_library_encodes(spark, odd, odd_texts, library):
    got = read_token_files(write_token_files(odd, shared_dir(spark, "t"), PATH)).orderBy("doc_id").collect()
    start = 0
    for i, (r, text) in enumerate(zip(got, odd_texts, strict=True)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, END_ID]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_of_an_empty_table(spark, empty):
    assert read_token_files(write_token_files(empty, shared_dir(spark, "t"), PATH)).count() == 0


def test_files_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "b"), (None, "c"), (5, "a"), (1, None)], "doc_id long, text string")
    got = read_token_files(write_token_files(df, shared_dir(spark, "t"), PATH)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (5, 3, 2), (5, 5, 2)]


def test_segment_tree_equals_library(odd_texts, library):
    bpe, rng = SegmentTreeBpe(PATH), random.Random(3)
    more = ["".join(rng.choices("abcdefin thera'0.,é\u0301ß\u1100ÅÅ ", k=rng.randint(0, 200))) for _ in range(500)]
    for text in [*(t or "" for t in odd_texts), *more]:
        want = library.encode(text, add_special_tokens=False)
        assert bpe.encode(text).tolist() == want.ids
        assert bpe.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_rows(odd, odd_texts, library):
    whole = {r.doc_id: r for r in encode_decode(odd).collect()}
    digests = {r.doc_id: r for r in encode_decode(odd, digests=True).collect()}
    for i, text in enumerate(odd_texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert whole[i].ids == ids and whole[i].n_tokens == digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(whole[i].decoded.encode()).hexdigest()


def test_bpe_of_an_empty_table(empty):
    assert encode_decode(empty).count() == 0


def test_worker_caches_stay_bounded(monkeypatch):
    import bitquarry.llm.op8_bpe as m

    monkeypatch.setattr(m, "CHUNKS", 5)
    monkeypatch.setattr(m, "WORDS", 5)
    bpe = SegmentTreeBpe(tokenizer_path())
    text = " ".join(f"word{i}" for i in range(50))
    assert bpe.encode(text).tolist() == codec(tokenizer_path()).encode(text).tolist()
    assert len(bpe.chunk_cache) <= 6 and len(bpe.word_cache) <= 6


def test_every_code_point_and_special_strings_in_any_case(library):
    texts = [f"a{chr(c)}." for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(3)
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x2FFF), rng.randrange(32, 127), 32])) for _ in range(30)) for _ in range(5000)]
    texts += ["<|ENDOFTEXT|>", "ab<|EndOfText|>cd", "<|endoftext|> x", "A<|startoftext|>B", "it's IT'S 'Re x'll.", "\x01\x1c a\x1fb", "", " ", "<|", "a.,b.,", ".,", "Ab.,. É.,"]
    bpe, cached = codec(tokenizer_path()), encoder(tokenizer_path())
    for at in range(0, len(texts), 50_000):
        some = texts[at : at + 50_000]
        want = [e.ids for e in library.encode_batch_fast(some, add_special_tokens=False)]
        assert [np.frombuffer(x, cached.kind).tolist() for x in cached.encode(pa.array(["É"] * 3 + some)[3:]).to_pylist()] == want
        assert [bpe.encode(t).tolist() for t in some] == want
    assert [np.frombuffer(x, cached.kind).tolist() for x in cached.encode(pa.array(texts[-12:]), 2).to_pylist()] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts[-12:]]


def test_latin_pieces_are_cut_here_and_words_in_use_stay_cached(library, monkeypatch):
    import bitquarry.llm.op8_bpe as m

    bpe = SegmentTreeBpe(PATH)
    monkeypatch.setattr(bpe, "cut", None)
    for text in ("Straße, ÀÉÎ'S größer.ÿ1é2", "Ça VA'LL été\x1c déjà", "«É» z"[1:2] + "Ñ" * 60):
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(m, "WORDS", 8)
    asked, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda word: asked.append(word) or merge(word))
    bpe.forget()
    for i in range(30):
        bpe.encode(f"common new{'x' * i}")
    assert asked.count(b"common") == 1 and len(bpe.word_cache) + len(bpe.old_words) <= 8
