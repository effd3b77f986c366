"""Conversation repair against a plain version that tries all edits, and against SQL."""

import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import pytest

from tocsin.llm import repair as rp
from tocsin.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def best_edits(rows):
    """(cost, audit, repaired rows) over all edits of rows (role, text, fault), by definition; at most two turns inserted in a row."""

    @cache
    def best(k, so_far, inserts):
        """so_far: initials of the roles given, all but the last two of which no longer matter."""
        found = []
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", so_far):
            found.append((0, "", ()))

        def then(cost, letter, row, k_, inserts_):
            after = so_far + row[0][:1] if row else so_far
            if row and (row[0] == "" or not any(re.fullmatch("(s?(ua)+)?", after + x) for x in ("", "a", "ua"))):
                return
            after = after if len(after) < 4 else "su"[after[0] != "s" :] + "a" * (after[-1] == "a")  # as good as the whole
            if (rest := best(k_, after, inserts_)) is not None:
                found.append((cost + rest[0], letter + rest[1], ((row,) if row else ()) + rest[2]))

        if inserts < 2:
            for role in ("user", "assistant"):
                then(5, "I", (role, ""), k, inserts + 1)
        if k < len(rows):
            role, text, fault = rows[k]
            then(2, "D", None, k + 1, 0)
            if fault not in ("b", "d"):
                more = 5 * (fault == "t")
                then(more, "K", (role, text), k + 1, 0)
                for other in ("user", "assistant"):
                    then(1 + more, "R", (other, text), k + 1, 0)
        return min(found, key=lambda x: x[:2], default=None)

    return best(0, "", 0)


def plain(table, damage):
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for c, t, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
            if how == 0:
                continue
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            rows += [(t, "user" if how == 4 else role, text)] * (1 + (how == 3))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            ends = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not ends else "d" if (role, text) in seen else "t" if ends[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, kept = best_edits([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def got(spark, table, damage=True):
    df = spark.createDataFrame([(*r, "clash") for r in table], f"{SCHEMA}, segment string").repartition(3)
    out = rp.repair(df, also=rp.damaged) if damage else rp.repair(df)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=repr)


def table(seed, convs, turns):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua"]
    texts = ["Yes.", "No!", "cut off", "end? \n", "", " \t", None, "x. ", "y\u0085", "Yes."]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(turns)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None]), ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles), f"turn {t}." if rng.random() < 0.5 else rng.choice(texts)))
    return rows


@pytest.mark.parametrize(("seed", "damage"), [(1, True), (2, False)])
def test_against_all_edits(spark, seed, damage):
    some = table(seed, 60, 11)
    assert got(spark, some, damage) == plain(some, damage)


def test_segments(spark, monkeypatch):
    """Cut at every third turn, and composed, the edits are those of the whole."""
    monkeypatch.setattr(rp, "SEGMENT", 3)
    some = table(3, 12, 60)
    assert got(spark, some) == plain(some, True)


def test_search_in_any_state():
    """Between any two states, composed from any cut, paths are the least."""
    rng = random.Random(4)
    for _ in range(150):
        codes = [(rng.choice("uuaas?"), rng.choice(["", "", "", "b", "d", "t"])) for _ in range(rng.randrange(1, 9))]
        k = rng.randrange(len(codes) + 1)
        for begin in range(4):
            whole = {e: (c, a) for b, e, c, a in rp.paths(codes) if b == begin}
            parts = {}
            for b, m, c, a in rp.paths(codes[:k]):
                for m2, e, c2, a2 in rp.paths(codes[k:]):
                    if b == begin and m == m2:
                        parts[e] = min(parts.get(e, (c + c2, a + a2)), (c + c2, a + a2))
            assert parts == whole


def test_long_conversation(spark):
    """One conversation holds nearly all rows: it is searched in segments, and streamed to its digest."""
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t} of it.") for t in range(20_000)] + [(8, 0, "user", "hello."), (8, 1, "assistant", "yes.")]
    out = {r[0]: r for r in got(spark, rows)}
    assert out[7][6] > 1000 and len(out[7][7]) > 18_000 and out[8][1:6] == plain(rows[-2:], True)[0][1:6]
    assert {r[0]: r[6:8] for r in got(spark, rows, False)} == {7: (0, "K" * 20_000), 8: (0, "KK")}


def test_empty_and_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "hello.")]
    assert got(spark, rows) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(spark, [r for r in rows if r[0] is None]) == []


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rows = sorted(map(tuple, QUERIES["op11_repair"](spark, sf).select(COLUMNS).collect()))
    assert rows == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op11_repair']})").fetchall())
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows == sorted(plain([tuple(r) for r in table], True))
