"""The n-gram join against all pairs."""

import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.odd import ROWS, none, odd
from tocsin.llm import common, jaccard, queries


def plain(docs):
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 85 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def same(got, docs):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(docs)


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    same(queries.op10_ngram_join(spark, sf).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_sql():
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = plain(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert {i: (n, c) for i, n, c in con.execute(queries.ORACLE_SQL["op10_ngram_join"]).fetchall()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed, monkeypatch):
    """Groups whose members lie around the threshold, and a passage that many share."""
    monkeypatch.setattr(jaccard, "LIST", 16)
    monkeypatch.setattr(jaccard, "CROSS", 8)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, docs = [word() for _ in range(60)], []
    for _ in range(8):
        base = [word() for _ in range(rng.choice([3, 5, 20, 80, 150]))]
        for _ in range(rng.choice([2, 10, 40])):
            new = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                new[rng.randrange(len(new))] = word()
            docs.append(" ".join(new))
    docs += [" ".join([word() for _ in range(rng.randrange(0, 30))] + passage) for _ in range(60)]
    rng.shuffle(docs)
    rows = list(enumerate(docs, 100))
    same(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)


def test_odd(spark):
    got = jaccard.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ROWS) and [r.component_id for r in got if r.doc_id is None] == [None]
    same([r for r in got if r.doc_id not in (None, 3)], [(r[0], r[1]) for r in ROWS if r[0] not in (None, 3)])
    assert jaccard.near_duplicates(none(spark)).count() == 0


def test_large_group(spark, monkeypatch):
    """A group that is longer than a list becomes one component in the first wave: its second wave has no pairs."""
    monkeypatch.setattr(jaccard, "LIST", 8)
    rng, base = random.Random(9), [f"w{k}" for k in range(120)]
    docs = []
    for k in range(150):
        new = list(base)
        new[rng.randrange(len(new))] = f"x{k}"
        docs.append(" ".join(new))
    seen, own = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: seen.append(pairs.count()) or own(pairs, *a))
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 150 and seen[1] == 0 < seen[0] < 150 * 149 / 2


def test_half_digests(tmp_path, monkeypatch):
    """Classes that agree in half a digest stay apart: every copy of them stands for its class."""
    monkeypatch.setattr(jaccard, "signature", lambda s: b"samehalf" + int(s[0]).to_bytes(8, "big"))
    texts = ["a b c d", "e f g h i", "a b c d", "x y z w v", "e f g h i"]
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5], "text": texts})
    (sets,) = jaccard._sets(4)([docs])
    names = sets.column("cls").to_pylist()
    assert names[0] == names[2] != names[1] and len({n[:8] for n in names}) == 1
    store = jaccard.Store(f"file://{tmp_path}", 6, 2)
    repeated = pa.RecordBatch.from_arrays([pa.array([names[0], names[1]], pa.binary()), pa.array([1, 2], pa.int64())], names=["cls", "rep"])
    for b in jaccard._send_copies(6)([repeated]):
        t = pa.Table.from_batches([b])
        for k in t.column("bucket").to_pylist():
            list(jaccard._write_copies(store)(k, t))
            store = store.sealed([k])
    ((classes, kept),) = jaccard._standing(store, 4, [docs])
    assert classes == names and len(kept) == 5
    # one repeated class alone: its copies are told from another class of the same half
    one = jaccard.Store(f"file://{tmp_path}/one", 6, 2)
    common.make_dir(one.folder)
    (b,) = jaccard._send_copies(6)([repeated.slice(0, 1)])
    (k,) = b.column("bucket").to_pylist()
    list(jaccard._write_copies(one)(k, pa.Table.from_batches([b])))
    ((classes, _),) = jaccard._standing(one.sealed([k]), 4, [docs])
    assert classes == [names[0], names[1], names[3], names[4]]


def test_spread_join(spark):
    """A join whose largest keys are joined apart is the plain join."""
    left = spark.range(3000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count("*").alias("m")).where("k <> 3").withColumn("w", F.col("k") * 10)
    for hot in (10, 400, 10**9):
        got = sorted(map(tuple, common.spread_join(left, right, "k", "m", hot).select("k", "v", "w").collect()))
        assert got == sorted((k, v, 10 * k) for k, v in left.collect() if k != 3)


def test_spread_join_of_a_hot_key(spark):
    """With three quarters of all rows on one key, no partition has much more than the others."""
    left = spark.range(200_000, numPartitions=8).select(F.when(F.col("id") % 4 < 3, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count("*").alias("m")).withColumn("w", F.col("k") + 1)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(kept, ("false", "-1"), strict=True):
            spark.conf.set(c, v)
        out = common.spread_join(left, right, "k", "m")
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 200_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_components(spark):
    chain = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(101, 120).select(F.lit(100).cast("bigint").alias("a"), F.col("id").alias("b"))
    got = {r.v: r.c for r in jaccard.components(chain.unionByName(star)).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 120), 100)}


def test_link_counts(spark):
    """All links of a group of near copies, with exact copies, a short text, an empty one and a row without an id."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(90)]
    docs = []
    for _ in range(40):
        new = list(base)
        for _ in range(rng.randrange(0, 4)):
            new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
        docs.append(" ".join(new))
    rows = [*enumerate([*docs, *docs[:9], "a few", "A few", "", None, "other words in this one here"]), (None, docs[0])]
    sets = [(i, {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := (t or "").lower().split()) else set()) for i, t in rows]
    want = {i: (len(a), sum(j is not None and j != i and len(a & b) * 100 >= 85 * len(a | b) > 0 for j, b in sets)) for i, a in sets if i is not None}
    got = jaccard.link_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.n_links) for r in got if r.doc_id is not None} == want
    assert [r.n_links for r in got if r.doc_id is None] == [0] and len(got) == len(rows)
    assert max(n for _, n in want.values()) > 10 and jaccard.link_counts(none(spark)).count() == 0


def test_components_read_links_once(spark, monkeypatch):
    """A chain of dense groups takes several rounds, but all of them together join little more than the links."""
    joined = []
    monkeypatch.setattr(jaccard, "spread_join", lambda left, right, key, size: joined.append(left.count()) or common.spread_join(left, right, key, size))
    n = 20
    dense = [(k * n + i, k * n + j) for k in range(n) for i in range(n) for j in range(i + 1, n)]
    chain = [(k * n - 1, k * n) for k in range(1, n)]
    got = jaccard.components(spark.createDataFrame(dense + chain, "a bigint, b bigint")).collect()
    assert sorted((r.v, r.c) for r in got) == [(v, 0) for v in range(n * n)]
    assert sum(joined) <= 3 * len(dense)
