"""Decontamination against a plain version that compares every window at every position."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.odd import TEXTS, none, odd
from tocsin.llm import decontaminate as dc
from tocsin.llm.queries import ORACLE_SQL, QUERIES

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, size=10):
    """What is to come out, for rows (doc_id, text) and (item_id, text)."""
    wins = set()
    for i, t in items:
        w = split(t)
        wins |= {(i, tuple(w[s : s + size])) for s in range(max(1, len(w) - size + 1)) if w}
    out = []
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for i, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    ids |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(spark, docs, items, size=10):
    return sorted((tuple(r) for r in dc.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), size).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "Élan", "x9", "d" * 30] if seed % 2 else [f"w{k}" for k in range(40)]
    some = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, some(rng.choice([0, 1, 2, 3, 9, 10, 11, 30]))) for k in range(12)] + [(3, some(14)), (None, some(12)), (12, None)]
    docs = [(k, " ".join([some(rng.randrange(60)), rng.choice(items)[1] or "", some(rng.randrange(5)), rng.choice(items)[1] or ""])) for k in range(30)]
    return [*docs, docs[0], (4, docs[5][1]), (None, docs[6][1]), (99, None), (98, ""), (97, " .,;")], items


@pytest.mark.parametrize(("seed", "size"), [(1, 10), (2, 10), (3, 4), (4, 1)])
def test_against_every_window(spark, seed, size):
    docs, items = corpus(seed)
    assert got(spark, docs, items, size) == plain(docs, items, size)


def test_blocks_and_spans(spark, monkeypatch):
    """Many blocks of windows, and hits that are merged in many spans, give the same."""
    monkeypatch.setattr(dc, "BLOCK_ROWS", 7)
    monkeypatch.setattr(dc, "SPAN", 8)
    docs, items = corpus(6)
    assert got(spark, docs, items) == plain(docs, items)


def test_long_text_of_one_passage(spark):
    """One passage again and again through a long text: all its words are hit, and no span holds more than its words."""
    passage = " ".join(f"p{k}" for k in range(25))
    docs = [(1, " ".join([passage] * 8000)), (2, passage), (3, "p1 p2 p3 p4 p5 p6 p7 p8 p9")]
    rows = got(spark, docs, [(7, passage), (8, "p24 p0")])
    assert [r[:4] for r in rows] == [(1, 200_000, 200_000, 2), (2, 25, 25, 1), (3, 9, 0, 0)]


def test_odd_and_empty(spark):
    items = [(1, TEXTS[5]), (2, "no id here at all"), (3, "thing w5"), (4, "中文字符")]
    want = plain([(r.doc_id, r.text) for r in odd(spark).collect()], items)
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], f"{ITEMS}, window string, win string")
    assert sorted((tuple(r) for r in dc.decontaminate(odd(spark).withColumns({"words": F.col("text"), "row": F.lit(1), "p": F.lit(2)}), bench).collect()), key=repr) == want
    assert dc.decontaminate(none(spark), bench).count() == 0
    left = dc.clean(odd(spark), bench)
    assert left.columns == odd(spark).columns and left.count() == sum(not r[-1] for r in want)
    assert not any(r.contaminated or r.n_items for r in dc.decontaminate(odd(spark), bench.where("false")).collect())


def test_native(spark, sf):
    plan = QUERIES["op12_decontamination"](spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = QUERIES["op12_decontamination"](spark, sf).collect()
    want = con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({ORACLE_SQL['op12_decontamination']})").fetchall()
    assert sorted(map(tuple, rows)) == sorted(want) and any(r.contaminated for r in rows)
