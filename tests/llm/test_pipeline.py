"""The pipeline against its operators' plain versions, stage by stage."""

from collections import Counter

import corpus_pipeline
from tests.llm.odd import ROWS, none, odd
from tests.llm.test_first import base_spans, check_packed, library
from tests.llm.test_jaccard import plain
from tocsin.llm import jaccard, pii, quality, toxicity


def test_stages(spark, sf, tmp_path):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    had = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if k == 0:
            want = {r.doc_id for r in quality.judge(docs, labels).collect() if r.kept}
        elif k == 1:
            want = {r.doc_id for r in toxicity.score(docs, labels).collect() if not r.predicted}
        elif k == 2:
            want = {i for i, (_, c) in plain(list(had.items())).items() if i == c}
        out = stage(spark, docs, sf)
        if k == 4:
            check_packed(out.collect(), {i: [*x, 1] for i, x in library(had).items()})
            continue
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r.doc_id: r.text for r in docs.collect()}
        assert set(got) == want and (k == 3 or all(got[i] == had[i] for i in got))
        if k == 3:
            assert all(not any(s for s in base_spans(t).values()) for t in got.values())
            assert all(got[i] == pii.redacted(had[i], pii.find(had[i])) for i in got)
        had = got
    assert len(had) > 50


def test_empty_and_odd(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    had = Counter((r.doc_id, r.text, r.sequence_id) for r in odd(spark).collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, none(spark), sf).count() == 0
        out = stage(spark, odd(spark), sf)
        rows = out.collect()
        if k == 4:
            pieces = Counter(r.doc_id for r in rows)
            assert all(pieces[i] >= 1 for i, _, _ in had) and pieces[3] == 2 and {r.piece for r in rows if r.doc_id == 11} == set(range(pieces[11]))
            continue
        assert out.columns == odd(spark).columns
        got = Counter((r.doc_id, r.text, r.sequence_id) for r in rows)
        if k == 0:
            bad = {t for _, t, _ in had if t is None or len(t.split()) < 10}
            assert not bad & {t for _, t, _ in got} and got <= had and len(got) >= 1
        elif k == 1:
            toxic = Counter(r.doc_id for r in toxicity.score(odd(spark), labels).collect() if r.predicted)
            assert got <= had and sum(got.values()) == len(ROWS) - sum(toxic.values()) and {None, "", " "} <= {t for _, t, _ in got}
        elif k == 3:
            assert Counter(i for i, _, _ in got.elements()) == Counter(i for i, _, _ in had.elements())
            assert got == Counter((i, t if t is None else pii.redacted(t, pii.find(t)), s) for i, t, s in had.elements())


def test_near_duplicates_by_row(spark, sf):
    """Of repeated ids one row of each group stays, and rows without an id stay if they are like no other."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(5, a), (5, a), (5, b), (3, b), (7, None), (None, c), (None, a), (9, c + " d"), (None, "only here and nowhere else"), (None, "only here and nowhere else"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(5, a), (3, b), (7, None), (9, c + " d"), (None, "only here and nowhere else"), (8, "")]))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, odd(spark), sf).collect()]
    had = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert (None, "no id here at all") in kept and len(had) - len(kept) == 1 and sum(i == 3 for i, _ in kept) == 2


def test_near_duplicates_keep_clashing_columns(spark, sf):
    """Columns named like the stage's own keys come out as they went in."""
    rows = [(k, f"text {k} that is like no other {k} at all {k}", 70 + k, f"k{k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key bigint, key string")
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, sf).select(docs.columns).collect())) == rows


def test_near_duplicates_definition(spark, sf, monkeypatch):
    """The stage names its own size and percent; the operator's defaults don't bear on it."""
    seen, own = [], jaccard.near_duplicates
    monkeypatch.setattr(jaccard, "near_duplicates", lambda docs, size=None, percent=None: seen.append((size, percent)) or own(docs, size, percent))
    corpus_pipeline.near_duplicates(spark, none(spark), sf)
    assert seen == [(4, 85)]
