"""The pipeline's stages, each against a plain version on its own input."""

import random

import pytest
from test_pairs import plain_components, plain_dedup
from test_scans import plain_overlaps
from test_toxicity import corpus

import corpus_pipeline as p
from bitquarry.llm.op8_bpe import codec, tokenizer_path


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(9)
    texts, toxic = corpus(700, 2)
    texts = [t[:90] + "\n" + t[90:] if i % 3 else t for i, t in enumerate(texts)]
    items = [(i, " ".join(f"bench{i}w{j}" for j in range(18))) for i in range(8)] + [(8, None), (9, "")]
    for i in range(20):
        texts[i] = texts[i][:60] + "\n" + rng.choice(items[:8])[1] + "\n" + texts[i][60:200]
    passage = "this passage of quite a few words stands in very many of the texts again and again"
    for i in range(100, 300):
        texts[i] = texts[i] + "\n" + passage
    near = [texts[i] + " tail" for i in range(300, 360)]  # too long for the line stage to take
    texts += near + texts[:30] + ["", None, None]
    toxic += toxic[300:360] + toxic[:30] + [0, 0, 0]
    ids = [*range(len(texts) - 1), None]
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, toxic[i]) for i in ids if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, toxic


def ordered(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_stages(spark, sf):
    d, toxic = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before, seen = docs.columns, ordered(docs), []
    for name, stage in p.STAGES:
        path = f"{d}/{name}"
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        after = ordered(docs)
        if name != "bpe":
            assert docs.columns == columns
        texts = [r.text for r in before]
        if name == "toxicity":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            bad = {i for i, t in enumerate(toxic) if t}
            assert len(gone & bad) >= 0.9 * len(bad) and len(gone - bad) <= 0.03 * len(toxic)
            assert set(after) <= set(before)
        elif name == "line_dedup":
            want = [None if w is None else w[1] for w in plain_dedup(texts, 2, 20)]
            assert [(r.doc_id, r.text, r.n_chars) for r in after] == [(r.doc_id, w, None if w is None else len(w)) for r, w in zip(before, want, strict=True)]
        elif name == "jaccard_join":
            label = plain_components([t if r.doc_id is not None else None for t, r in zip(texts, before, strict=True)], 5, 80)
            assert after == [r for i, r in enumerate(before) if label[i][1] == i]
            assert len(after) < len(before) - 15
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            hits = plain_overlaps(texts, items, 13)
            assert after == [r for r, (n, h, _, _) in zip(before, hits, strict=True) if not (h > 0 and 20 * h >= n)]
            assert len(after) < len(before)
        else:
            bpe = codec(tokenizer_path())
            for r, b in zip(after, before, strict=True):
                assert r.ids == bpe.encode(b.text or "").tolist() and r.n_tokens == len(r.ids) and r.decoded == bpe.decode(r.ids)
        seen.append(len(after))
        before = after
    assert sorted(r.doc_id or -1 for r in p.run(spark, d).select("doc_id").collect()) == sorted(r.doc_id or -1 for r in before)


def test_rows_are_judged_by_their_own_text(spark, tmp_path):
    passage, one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "pabc")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, one), (None, one + " end"), (None, two), (None, two + " end"), (None, None), (None, None), (2, three), (2, one + " tail"), (2, passage), (None, passage + " end"), (7, two)]
    schema = "doc_id long, text string"
    got = {(r.doc_id, r.text) for r in p.drop_contaminated(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()}
    assert got == {r for r in rows if not (r[1] or "").startswith("p0")}
    got = sorted(((r.doc_id, r.text) for r in p.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, one), (7, two), (2, three), (2, passage), (None, None), (None, None)], key=str)


def test_numbers_of_rows_read_from_files_need_no_copy(spark, tmp_path):
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:5])] + [(3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/a b=1%")
    read = spark.read.parquet(f"{tmp_path}/a b=1%")
    got = p.numbered(read)
    assert not any("/numbered-" in f for f in got.inputFiles())
    first = {tuple(r) for r in got.collect()}
    assert len({r[-1] for r in first}) == len(first) == len(rows) and {tuple(r) for r in got.repartition(2).collect()} == first
    assert sorted(map(tuple, p.drop_near_duplicates(spark, read, str(tmp_path)).collect())) == rows[:40]
    assert any("/numbered-" in f for f in p.numbered(read.where("doc_id > 1")).inputFiles())
