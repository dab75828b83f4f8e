from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from heliograph.llm import language_id, near_dedup, token_counts
from heliograph.llm.common import table
from test_decontamination import brute as matches
from test_substring_dedup import brute as repeats
from test_substring_dedup import words_of


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """What each stage was given and what it returned."""
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(at)
        after = spark.read.parquet(at)
        out.append((name, docs, after))
        docs = after
    return out


def of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_and_columns(steps, spark, sf):
    assert [s[0] for s in steps] == ["language-id", "near-dedup", "substring-dedup", "decontamination", "byte-level-bpe"]
    for _, _, after in steps[:-1]:
        assert after.columns == table(spark, sf, "documents").columns
    assert steps[-1][2].columns == [*table(spark, sf, "documents").columns, "tokens", "decoded"]


def test_language_id_keeps_clean_documents(steps):
    _, before, after = steps[0]
    kept = of(after)
    assert len(kept) > 0.9 * before.count()
    got = {r.doc_id: r for r in language_id.identify(before, language_id.train(before)).collect()}
    for r in before.collect():
        if got[r.doc_id].lang == "und":
            assert r.doc_id not in kept
        elif got[r.doc_id].lang == r.lang:
            assert r.doc_id in kept


def test_near_dedup_keeps_one_of_each_group(steps):
    _, before, after = steps[1]
    gone = {r.doc_id: r.kept_id for r in near_dedup.near_duplicates(before).collect()}
    assert set(of(after)) == set(of(before)) - {i for i, k in gone.items() if i != k}


def test_substring_dedup_cuts_what_occurred_before(steps):
    _, before, after = steps[2]
    cut = repeats(list(of(before).items()))
    want = {}
    for i, t in of(before).items():
        w = [x for n, x in enumerate(words_of(t)) if n not in cut.get((i, False), ((), 0))[0]]
        if w:
            want[i] = w
    assert {i: words_of(t) for i, t in of(after).items()} == want


def test_decontamination_drops_documents_with_passages(steps, spark, sf):
    _, before, after = steps[3]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert set(of(after)) == set(of(before)) - {m[0] for m in matches(list(of(before).items()), items)}


def test_encoding(steps):
    enc = token_counts.encoder(token_counts.RANKS)
    for r in steps[4][2].collect():
        assert list(r.tokens) == enc.encode_ordinary(r.text) and r.decoded == r.text


def test_run_is_the_stages_in_a_row(steps, spark, sf):
    assert {(r.doc_id, r.text, tuple(r.tokens)) for r in corpus_pipeline.run(spark, sf).collect()} == {(r.doc_id, r.text, tuple(r.tokens)) for r in steps[-1][2].collect()}


def test_empty_table_and_nulls(spark, sf):
    docs = table(spark, sf, "documents")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "web", 3), (2, "", None, None, 0)], docs.schema))
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf)
        assert rows.count() == 0


def test_odd_rows_pass_through_all_stages(spark, sf):
    """Very long texts, repeated rows, ties, rows without an id, and columns of the names that stages use themselves."""
    docs = table(spark, sf, "documents")
    words = sorted({w for r in docs.where("lang = 'en'").collect() for w in r.text.split() if w.isalpha()})
    rng = random.Random(0)
    prose = lambda n: " ".join(rng.choices(words, k=n))
    long, tie, lone = prose(150_000), prose(80), prose(90)
    rows = [(10**6, long, "en", "x", len(long)), *[(10**6 + 1, tie, "en", "x", len(tie))] * 3, (10**6 + 2, tie, "en", "y", len(tie)), (None, tie, "en", "z", len(tie)), *[(None, lone, "en", "z", len(lone))] * 2]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    names = ["key", "sig", "node", "region", "kept", "g", "_near_key", "_cuts", "tokens", "place", "_filter_at"]
    now = odd.selectExpr("*", *[f"concat('{n}', source) AS `{n}`" for n in names])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = spark.createDataFrame(stage(spark, now, sf).collect(), now.schema) if i < 4 else stage(spark, now, sf)
        if i < 4:
            assert now.columns == [*docs.columns, *names]
    got = now.where("doc_id >= 1000000 OR doc_id IS NULL").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1000000", long), ("1000001", tie), ("None", lone)])
    assert all(r.decoded == r.text and r.sig == "sig" + r.source and len(r.tokens) > 80 for r in got)
