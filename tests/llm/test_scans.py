"""Operators 4, 5, 6 and 7 against plain versions of what they compute."""

import base64
import hashlib
import io
import random
import re
import string
import zlib

import pyarrow as pa
import pyarrow.fs
import pytest
from llm_tables import table
from pyspark.sql import functions as F

from bitquarry.llm import op4_warc, op6_decontaminate, op7_url_filter
from bitquarry.llm.automaton import compile_rules, scan
from bitquarry.llm.common import flat_bytes, shared_dir
from bitquarry.llm.op5_secrets import BASE, MORE, Scanner, op5_secrets, scan_secrets

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    data, out = text.encode(), []
    for k, rule in enumerate(BASE + MORE):
        for m in (ASSIGN if rule.kind == "assign" else re.compile(rule.pattern.encode())).finditer(data):
            if len(m[1] if rule.kind == "assign" else m[0]) >= rule.least:
                out.append((len(data[: m.start()].decode()), k, len(data[: m.end()].decode())))
    return [((BASE + MORE)[k].kind, s, e) for s, k, e in sorted(out)]


@pytest.fixture(scope="module")
def secret_texts():
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "abc", "abcdef1", "AKIA", "AKIAKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef" * 2]
    bits += ["é", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "AIza" + "x" * 40, "sk_live_" + "9" * 20, "xoxb-123-abcdefghijk", "K", "ſecret", "/+"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(400)] + ["a" * 5000, "", "token=" + "a" * 3000 + " AKIA" + "0" * 3000]


def test_secrets_equal_a_regex_search(spark, secret_texts, odd_texts):
    texts = secret_texts + odd_texts
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in scan_secrets(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_secrets(t or "")


def test_secrets_query(spark, secret_texts, tmp_path):
    table(spark, secret_texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op5_secrets(spark, str(tmp_path)).collect():
        spans = plain_secrets(secret_texts[r.doc_id])
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        joined = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in x)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest() and r.spans == joined(spans)


def test_no_secrets_in_an_empty_table(empty):
    assert scan_secrets(empty).count() == 0


def test_automaton_lanes_equal_one_run():
    import numpy as np

    dfa = compile_rules([("a(b|c)+d?", False), ("[0-9]{3}", False), ("XY", True)])
    rng = np.random.default_rng(2)
    stream = rng.choice(np.frombuffer(b"abcd01XYxy", np.uint8), 5000)
    whole = scan(dfa, stream, lane=5000)
    for lane in (1, 7, 64):
        assert all((a == b).all() for a, b in zip(scan(dfa, stream, lane=lane), whole, strict=True))
    assert len(Scanner().all.accepts) < 2000


def pages_table(spark, htmls, urls=None):
    urls = urls or [f"http://h.example/{i}" for i in range(len(htmls))]
    rows = [(i, u, h, "x", "y") for i, (u, h) in enumerate(zip(urls, htmls, strict=True))]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string, first string")


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_warc_round_trip(spark, split):
    rng = random.Random(5)
    htmls = [None, "", "", "same", "same", "same", "é" * 3000, "x" * 300_000] + ["".join(rng.choices(string.printable, k=rng.randint(0, 4000))) for _ in range(12)] + ["WARC/1.1\r\n\r\n\x1f"]
    urls = [None, "no scheme", "http://a b/\n", "http://é.example/"] + [f"http://h.example/{i}" for i in range(len(htmls) - 4)]
    manifest = op4_warc.write_warc(pages_table(spark, htmls, urls), shared_dir(spark, "w"))
    if split == 37:  # so small ranges are read in this process: each record once, whichever range it begins in
        got = []
        for m in manifest.collect():
            fs, path = pa.fs.FileSystem.from_uri(m.uri)
            with fs.open_input_file(path) as f:
                data = f.read()
            for a in range(0, min(len(data), 9000), split):
                got += list(op4_warc.members(io.BytesIO(data), len(data), a, min(a + split, len(data), 9000)))
            assert got[-len(got) :]
            want, at = [], 0
            while at < len(data) and at < 9000:
                z = zlib.decompressobj(31)
                want.append(z.decompress(data[at:]))
                at = len(data) - len(z.unused_data)
            assert got == want
            got = []
        return
    rows = {r.record_id: r for r in op4_warc.read_warc(manifest, split=split, payloads=True).collect()}
    assert len(rows) == len(htmls)
    first = {}
    for i, h in enumerate(htmls):
        r, data = rows[f"<urn:page:{i}>"], (h or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if data in first:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", f"<urn:page:{first[data]}>", None)
        else:
            first[data] = i
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)


def test_warc_least_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (2, "u", "long one"), (None, "u", "long one"), (2, "u", "long one")], "page_id long, url string, html string")
    got = op4_warc.read_warc(op4_warc.write_warc(df, shared_dir(spark, "w"), least=3)).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to or "") for r in got) == sorted(
        [("<urn:page:1>", "response", ""), ("<urn:page:2>", "response", ""), ("<urn:page:2>", "response", ""), ("<urn:page:2>", "response", ""), ("<urn:page:none>", "revisit", "<urn:page:2>")]
    )
    assert op4_warc.read_warc(op4_warc.write_warc(df.limit(0), shared_dir(spark, "w"))).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))]


def plain_overlaps(texts, items, window):
    phrases = {}
    for item, text in items:
        w = [x[0] for x in plain_words(text)]
        for a in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[a : a + window]), set()).add(item)
    out = []
    for text in texts:
        w = plain_words(text)
        hit, found = [False] * len(w), set()
        for n in {len(p) for p in phrases}:
            for a in range(len(w) - n + 1):
                own = phrases.get(tuple(x[0] for x in w[a : a + n]))
                if own:
                    found |= own
                    hit[a : a + n] = [True] * n
        spans = []
        for (_, s, e), h, before in zip(w, hit, [False, *hit], strict=False):
            if h and before:
                spans[-1][1] = e
            elif h:
                spans.append([s, e])
        out.append((len(w), sum(hit), sorted(found, key=str), spans))
    return out


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_overlaps_equal_a_plain_search(spark, odd_texts, block, monkeypatch):
    rng = random.Random(7)
    alphabet = ["a", "B", "c", "é", "the", "zz9"]
    texts = ["".join(rng.choice(alphabet) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randint(0, 50))) for _ in range(60)] + odd_texts
    items = [(rng.randint(0, 15), " ".join(rng.choices([*alphabet, "q"], k=rng.randint(0, 6)))) for _ in range(14)] + [(99, None), (100, odd_texts[12]), (11, "ärger")]
    benchmark = spark.createDataFrame([*items, (None, "a b c")], "item_id long, text string")
    monkeypatch.setattr(op6_decontaminate, "PHRASES", block)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], [list(s) for s in r.spans]) for r in op6_decontaminate.find_overlaps(table(spark, texts), benchmark, 3).collect()}
    assert [got[i] for i in range(len(texts))] == plain_overlaps(texts, items, 3)


def test_overlaps_of_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op6_decontaminate.find_overlaps(odd, none).agg(F.sum("n_hit")).first()[0] == 0
    assert op6_decontaminate.find_overlaps(empty, none).count() == 0


URLS = {
    "http://www.A.net/x": ("www.a.net", "/x", "net/", "block"),
    "https://example.net/en/1?q": ("example.net", "/en/1", "example.net/en/", "allow"),
    "https://m.Example.net/de/1": ("m.example.net", "/de/1", "net/", "block"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
    "http://x.example.com/de/#a": ("x.example.com", "/de/", "example.com/de/", "block"),
    "http://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
    "http://a.net": ("a.net", "", None, None),
    "http://a.net?x/y": ("a.net", "", None, None),
    "ftp://a://b/c": ("a:", "//b/c", None, None),
    "http:///path": ("", "/path", None, None),
    "no url": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, score string")
    got = {r.page_id: r for r in op7_url_filter.filter_urls(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ("allow", "block") and verdict in (None, got[i].verdict)
    assert op7_url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in op7_url_filter.filter_urls(df.where("page_id >= 10")).collect()} == {"allow"}


def test_url_models_tell_classes_apart(spark):
    rng = random.Random(8)
    bad = [f"http://{rng.choice(['win', 'cheap'])}-{rng.choice(['pills', 'casino'])}{rng.randint(1, 99)}.{{}}/{rng.choice(['buy', 'spin'])}/{rng.randint(1, 999)}" for _ in range(300)]
    good = [f"http://{rng.choice(['news', 'blog', 'wiki'])}.{rng.choice(['garden', 'museum'])}.{{}}/fr/{rng.choice(['roses', 'painting'])}-{rng.randint(1, 999)}" for _ in range(300)]
    urls = [u.format("net") for u in bad[:200]] + [u.format("org") for u in good[:200]] + [u.format("info") for u in bad[200:] + good[200:]]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in op7_url_filter.filter_urls(rows).collect()}
    right = sum(got[i] == "block" for i in range(400, 500)) + sum(got[i] == "allow" for i in range(500, 600))
    assert right >= 190


def test_url_likelihood_is_the_models(spark):
    import math
    from collections import Counter

    import numpy as np

    texts, query = ["abcab", "abd"], "abx"
    counts = np.zeros(op7_url_filter.SLOTS)
    op7_url_filter.count(*flat_bytes(pa.array(texts)), counts)
    both, alone = Counter(), Counter()
    for t in texts:
        for i in range(len(t)):
            for k in range(min(i, op7_url_filter.ORDER) + 1):
                both[t[i - k : i], t[i]] += 1
                alone[t[i - k : i]] += 1
    total = 0
    for i in range(len(query)):
        p = 1 / 256
        for k in range(min(i, op7_url_filter.ORDER) + 1):
            c = query[i - k : i]
            p = (both[c, query[i]] + op7_url_filter.SMOOTH * p) / (alone[c] + op7_url_filter.SMOOTH)
        total += math.log(p)
    assert abs(op7_url_filter.log_likelihood(*flat_bytes(pa.array([query])), counts)[0] - total) < 1e-9


def test_url_ngrams_have_a_count_each():
    rng = random.Random(5)
    flat, offsets = flat_bytes(pa.array(["".join(rng.choices(string.printable + "é日", k=rng.randint(0, 60))) for _ in range(3_000)]))
    seen = {}
    data = flat.tobytes()
    for k, (at, both, alone) in enumerate(op7_url_filter.grams(flat, offsets)):
        for i, x, y in zip(at.tolist()[::7], both.tolist()[::7], alone.tolist()[::7], strict=True):
            assert seen.setdefault(x, (k, data[i - k : i + 1], 1)) == (k, data[i - k : i + 1], 1)
            assert seen.setdefault(y, (k, data[i - k : i], 0)) == (k, data[i - k : i], 0)


def test_url_counts_of_many_ngrams_are_exact(spark):
    import pyarrow.parquet as pq

    from bitquarry.llm.common import filesystem

    rng = random.Random(6)
    texts = [("".join(rng.choices(string.ascii_lowercase, k=40)), rng.choice(["block", "allow"])) for _ in range(9_000)]
    fs, at = filesystem(op7_url_filter.fit(spark.createDataFrame(texts, "text string, rule_verdict string")))
    got = {r["key"]: (r["block"], r["allow"]) for r in pq.read_table(at, filesystem=fs).to_pylist()}
    assert len(got) > op7_url_filter.SLOTS  # they would share the slots of one table
    want = {}
    for t, verdict in texts:
        for i in range(len(t)):
            for k in range(min(i, op7_url_filter.ORDER) + 1):
                for bit, gram in ((1, t[i - k : i + 1]), (0, t[i - k : i])):
                    n = want.setdefault((2 * k + bit) << 48 | int.from_bytes(gram.encode(), "big"), [0, 0])
                    n[verdict == "allow"] += 1
    assert got == {k: tuple(n) for k, n in want.items()}


def test_url_models_read_whole_urls(spark):
    rng = random.Random(10)
    bad, good = (lambda: f"?{rng.choice(['casino', 'pills'])}={rng.randint(1, 999)}#spin"), (lambda: f"?{rng.choice(['roses', 'museum'])}={rng.randint(1, 999)}#read")
    urls = [f"http://a.net/fr/{bad()}" for _ in range(200)] + [f"http://a.org/fr/{good()}" for _ in range(200)]
    urls += [f"http://a.info/fr/{bad()}" for _ in range(50)] + [f"http://a.info/fr/{good()}" for _ in range(50)]
    urls += [f"a.info/fr/{bad()}" for _ in range(50)] + [f"a.info/fr/{good()}" for _ in range(50)]  # without a scheme
    got = {r.page_id: r for r in op7_url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for start, verdict in ((400, "block"), (450, "allow"), (500, "block"), (550, "allow")):
        assert sum(got[i].verdict == verdict for i in range(start, start + 50)) >= 48
    assert {(got[i].host, got[i].path) for i in range(500, 600)} == {("", "")}
