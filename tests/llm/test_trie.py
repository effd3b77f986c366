"""The prefix trie against a plain one of tuples, and against SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tocsin.llm import trie as tr
from tocsin.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(table):
    own = {}
    for c, t, role, text in table:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append((t is not None, t or 0, role.encode(), code, (role, text)))
    own = {c: [x[-1] for x in sorted(rows)] for c, rows in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), ([], []))[0].append(c)
        nodes[tuple(path)][1].append(c)
    out = []
    for path, (members, ends) in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below)
        saved = sum((len(nodes[p][0]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        sha = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]][0]) if path else None, len(members), kids, leaves, saved, sha))
    return sorted(out, key=repr)


def got(spark, table):
    df = spark.createDataFrame([(*r, "clash") for r in table], f"{SCHEMA}, codes string").repartition(3)
    out = tr.trie(tr.rebuilt(tr.sequences(df)))
    assert sorted(out.columns) == sorted(COLUMNS)
    return sorted(map(tuple, out.select(COLUMNS).collect()), key=repr)


def table(seed, convs, turns):
    rng = random.Random(seed)
    texts = ["hello there", "hello  there", "", None, "a b c\td", "no break"]
    rows = []
    for c in rng.sample(range(200), convs):
        rows += [(c, t if rng.random() < 0.9 else rng.choice([None, 2]), rng.choice(["user", "user", None]), rng.choice(texts[: 2 + seed % 5])) for t in range(rng.randrange(1, turns))]
    return [*rows, (None, 0, "user", "of no conversation"), rows[0]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain(spark, seed):
    some = table(seed, 80, 7)
    assert got(spark, some) == plain(some)


def test_many_shards(spark, monkeypatch):
    """With a shard for every few turns, nodes that many shards share are merged to the same."""
    monkeypatch.setattr(tr, "SHARD_TURNS", 9)
    monkeypatch.setattr(tr, "ID_BLOCK", 7)
    some = table(4, 120, 6)
    assert got(spark, some) == plain(some)


def test_copies_and_a_long_one(spark):
    """A third are copies of one conversation, and one is very long."""
    rows = [(c, t, "user", f"turn {t}") for c in range(20_000, 23_000) for t in range(3)] + [(5, t, "user", f"word {t}") for t in range(3000)]
    rows += [(c, 0, "user", f"own {c}") for c in range(100, 180)]
    out = got(spark, rows)
    root = next(r for r in out if r[1] == 0)
    deep = 3000 - zlib.crc32(b"5") % 4  # its first turns are those of conversation 0, which isn't there
    assert root[3] == 3081 and sum(r[1] > 3 for r in out) == deep - 3 and max(r[1] for r in out) == deep
    assert next(r for r in out if r[0] == 20_000 and r[1] == 1)[3] == 3000


def test_tree():
    rng = random.Random(5)
    seqs = sorted({tuple(rng.choices(range(30), k=rng.randrange(6))) for _ in range(500)})
    tree = tr.TernaryTree()
    ends = {seqs[k]: tree.insert(list(seqs[k])) for k in tr.median_first(len(seqs))}
    assert len(set(ends.values())) == len(seqs) and all(tree.insert(list(s)) == n for s, n in ends.items())
    assert len(tree.turn) == len({s[:d] for s in seqs for d in range(len(s) + 1)}) and all(tree.up[v] < v for v in range(1, len(tree.turn)))
    assert sorted(tr.median_first(9)) == list(range(9)) and next(tr.median_first(9)) == 4


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "x")]) == []
    assert got(spark, [(3, None, None, None)]) == plain([(3, None, None, None)])


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rows = sorted(map(tuple, QUERIES["op13_trie"](spark, sf).select(COLUMNS).collect()), key=repr)
    assert rows == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op13_trie']})").fetchall(), key=repr)
    assert rows == plain([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
