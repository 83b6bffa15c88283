"""The pipeline, stage by stage, against plain Python on a small corpus."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from latticeflow.llm import packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEXICON = {
    "en": "the and of house water with from river stone".split(),
    "fr": "les des une maison eau avec rivière pierre été".split(),
    "de": "der und das haus wasser mit fluss stein schön".split(),
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(240):
        lang = ("en", "fr", "de")[i % 3]
        words = [rng.choice(LEXICON[lang]) + rng.choice(["", "a", "er", "en"]) for _ in range(rng.randrange(30, 80))]
        if i % 8 == 0:
            words[::9] = ["vile"] * len(words[::9])
        rows.append((i, " ".join(words), lang, f"s{i % 4}"))
        labels.append((i, 1, int(i % 8 == 0)))
    for i in range(240, 260):  # copies and near copies of clean documents
        own = rows[(i - 240) * 8 + 1][1].split(" ")
        if i % 2:
            own[-1] = "zz"
        rows.append((i, " ".join(own), rows[(i - 240) * 8 + 1][2], "s0"))
    rows += [(300, None, "en", "s0"), (301, "12345 !!!", "en", "s0"), (302, "", None, None)]
    full = [(*r, len(r[1]) if r[1] else None) for r in rows]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, full


@pytest.fixture(scope="module")
def stages(spark, corpus):
    path, _ = corpus
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        out.append(docs)
    return out


def test_each_stage_returns_documents(corpus, stages, spark):
    columns = spark.read.parquet(f"{corpus[0]}/documents.parquet").dtypes
    assert all(s.dtypes == columns for s in stages[:-1])


def test_language_id_keeps_clean_text(corpus, stages):
    got = {r.doc_id: r.lang for r in stages[0].collect()}
    assert set(got) == {r[0] for r in corpus[1]} - {300, 301, 302}
    assert all(got[r[0]] == r[2] for r in corpus[1] if r[0] in got)


def test_toxicity_drops_the_toxic(stages):
    before, after = ({r.doc_id for r in s.collect()} for s in stages[:2])
    assert before - after == {i for i in range(240) if i % 8 == 0}


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def test_one_document_of_each_group_stays(stages):
    before = {r.doc_id: shingles(r.text) for r in stages[1].collect()}
    root = {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(before)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(before[i] & before[j]) >= 80 * len(before[i] | before[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({find(i) for i in ids})
    assert any(find(i) != i for i in ids)


def test_the_mix_meets_its_targets(stages):
    words, size = {}, {}
    for r in stages[2].collect():
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text))
    texts = {r.doc_id: WORD.findall(r.text) for r in stages[2].collect()}
    for r in stages[3].collect():
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text))
        own, taken = texts[r.doc_id], WORD.findall(r.text)
        assert set(taken) <= set(own) and len(taken) <= len(own) and r.n_chars == len(r.text)
    total, capped = sum(size.values()), set()
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    while True:
        left = total - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in size if x not in capped) for s in size}
        over = {s for s in size if target[s] > 3 * size[s]} - capped
        if not over:
            break
        capped |= over
    assert all(abs(words[s] - target[s]) <= 129 for s in size)


def test_packing_covers_the_mix(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_encoder_paths()[0])
    expected = []
    for r in stages[3].collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        expected += [(r.doc_id, k, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), 1024))]
    got = stages[4].collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted(expected)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024


def test_run_is_the_stages(spark, corpus, stages):
    whole = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert whole(corpus_pipeline.run(spark, corpus[0])) == whole(stages[4])


def test_nothing_and_very_long_texts_pass_through(spark, tmp_path):
    """Without documents there are no pieces; a text of a megabyte is one like any other."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    none, long = str(tmp_path / "none"), str(tmp_path / "long")
    for path, rows in ((none, []), (long, [(1, " ".join(LEXICON["en"] * 25_000), "en", "s", 1), (2, " ".join(LEXICON["de"] * 30), "de", "s", 1), (3, " " * 1_000_000, "en", None, 1), (None, None, None, None, None)])):
        spark.createDataFrame(rows, kinds).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(2, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
    got = corpus_pipeline.run(spark, long).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r.length <= 1024 for r in got)


def test_language_id_moves_no_text_to_few_sources(spark, corpus, stages):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the table of guesses is large
    try:
        out = corpus_pipeline.language_id(spark, docs, corpus[0])
        rows = sorted(map(repr, out.collect()))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == sorted(map(repr, stages[0].collect()))


def test_many_sources_give_the_same_languages(spark, corpus, stages, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.langid, "PRIOR_CELLS", 0)
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    assert sorted(map(repr, corpus_pipeline.language_id(spark, docs, corpus[0]).collect())) == sorted(map(repr, stages[0].collect()))
