"""Streams against their batch forms: over several parts, with state read back, and ends by timers."""

import hashlib
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_domain import at, event
from tocsin.operators import correlate, parse
from tocsin.plans import queries
from tocsin.plans.settings import Settings
from tocsin.sources import shared
from tocsin.streaming import jobs, live, timers

SF = "/root/testdata/sf0.001"


def by_scope(df):
    out = {}
    for r in df.orderBy("scope", "seq").collect():
        out.setdefault(r.scope, []).append((r.seq, r.event_id, r.action, r.reason, r.incident.id, r.incident.status, len(r.incident.trajectory)))
    return out


def same_but_for_ends(stream, batch, ended):
    """The stream's decisions are the batch's, then the ends of what was still active."""
    assert {k for k in stream if k != "clock"} == set(batch)
    for scope, rows in batch.items():
        more = stream[scope][len(rows) :]
        assert stream[scope][: len(rows)] == rows and all(r[2] == "expire" for r in more)
        if ended:
            last = {r[4]: r[5] for r in rows}
            assert {r[4] for r in more} == {i for i, status in last.items() if status in ended}


def test_correlated_in_parts(spark):
    e = queries.correlator_events(spark, SF).where("scope IN ('1', '2', '3')").cache()
    got = queries._in_parts(e, "timestamp", "test-correlate", timers.correlated, queries._clock(e))
    same_but_for_ends(by_scope(got), by_scope(correlate.correlate(e)), {"active"})


@pytest.mark.parametrize("ttl", [None, 4000])
def test_replies_to_resting_impacts(spark, ttl):
    """A reply goes to an impact long beyond the active window, fetched from where it rests; with a time to live it may be gone."""
    settings = Settings(impact_ttl=ttl) if ttl else Settings()
    some = [event(1, 0, location=at(50.1, 36.2), event_type="impact"), event(2, 10, location=at(49.0, 35.0), event_type="impact", channel="z")]
    some += [event(k, 400 * k, location=at(48.0 + k / 10, 33.0), channel="other") for k in range(3, 20)]
    some += [event(20, 8100, location=at(50.1, 36.2), reply_to=1), event(21, 12_000, location=at(50.2, 36.3), reply_to=20), event(22, 20_000, location=at(49.0, 35.0), channel="z", reply_to=2), event(23, 20_100, location=at(49.0, 35.0), channel="z", reply_to=22)]
    rows = spark.createDataFrame([{"scope": "s", **x, "timestamp": x["timestamp"] + 1_700_000_000} for x in some], correlate.EVENT)
    got = queries._in_parts(rows, "timestamp", "test-resting", lambda s: timers.correlated(s, settings), queries._clock(rows))
    batch = by_scope(correlate.correlate(rows, settings))
    same_but_for_ends(by_scope(got), batch, {"active", "impact"} if ttl else {"active"})
    assert ("reply_link" in {r[3] for r in batch["s"] if r[1] == "e20"}) == (ttl is None)


def test_dedup_is_what_makes_keys_unique(spark, monkeypatch):
    """Without the operator the query's rows are others, so its comparison with SQL says something."""
    assert {r.n for r in queries.stream_dedup(spark, SF).collect()} == {1}
    monkeypatch.setattr(jobs, "deduplicated", lambda s, *a: s)
    assert max(r.n for r in queries.stream_dedup(spark, SF).collect()) > 1


def test_districts_by_the_clock():
    """Changes by ends are those of looking at every millisecond."""
    rng, s = random.Random(1), Settings(override_ms=13, cooldown_ms=7)
    for _ in range(200):
        times = {t: [(rng.choice(["tick", "tick", "mark", "reset"]), rng.choice([0, 0, 1, 2])) for _ in range(rng.choice([1, 1, 2]))] for t in rng.sample(range(1, 80), rng.randrange(1, 12))}
        of, got = timers.Clocked(s), []
        for t in sorted(times):
            got += of.apply(t, times[t])
            of = timers.Clocked(s, *of.state())
        got += of.until_time(200)
        raw, override, until, prev, ended, shown, want = 0, 0, 0, 0, None, (0, None), []
        for t in range(1, 200):
            if until <= t:
                override = 0
            for kind, rank in sorted(times.get(t, []), key=lambda x: (("reset", "mark", "tick").index(x[0]), x[1])):
                if kind == "reset":
                    raw, override, until, prev, ended = 0, 0, 0, 0, None
                elif kind == "mark":
                    override, until = max(override, rank), t + 13
                else:
                    raw = rank
            rank = max(raw, override)
            ended = None if rank else t if prev else ended
            prev = rank
            now = (rank, {2: "red", 1: "orange"}.get(rank, "green" if ended is not None and t - ended < 7 else None))
            if now != shown:
                shown = now
                want.append((t, *now))
        assert got == want


def test_ends_after_ends(spark):
    """Where no row comes any more, an end that another one brings about is told too: green ends after the override, and each incident at its time."""
    day = 86_400_000
    rows = [(f"d{d}", day + 1000 * k + d, 0, "tick") for d in range(40) for k in range(4)] + [(f"d{d}", day + 5000 * (d + 1), 1 + d % 2, "mark") for d in range(40)]
    given = spark.createDataFrame(rows, "id string, at_ms bigint, rank int, kind string")
    clock = spark.createDataFrame([("clock", 3 * day, 0, "tick")], given.schema)
    got = {}
    for r in queries._in_parts(given, "at_ms", "test-ends", timers.level_changes, clock).orderBy("at_ms").collect():
        got.setdefault(r.id, []).append((r.at_ms, r.rank, r.level))
    s = Settings()
    marks = {d: (day + 5000 * (d + 1), 1 + d % 2) for d in range(40)}
    assert got == {f"d{d}": [(at_ms, rank, "red" if rank == 2 else "orange"), (at_ms + s.override_ms, 0, "green"), (at_ms + s.override_ms + s.cooldown_ms, 0, None)] for d, (at_ms, rank) in marks.items()}

    some = [event(k, 250 * k, location=at(48.0 + k / 2, 33.0), channel=f"c{k}", weapon_type=("shahed", "kab")[k % 2]) for k in range(12)]
    e = spark.createDataFrame([{"scope": scope, **x, "timestamp": x["timestamp"] + 1_700_000_000} for scope in "abcdef" for x in some], correlate.EVENT)
    ends = by_scope(queries._in_parts(e, "timestamp", "test-ends", timers.correlated, queries._clock(e)))
    for scope in "abcdef":
        opened = {r[4] for r in ends[scope] if r[2] == "new"}
        assert len(opened) > 5 and [r[0] for r in ends[scope]] == list(range(len(ends[scope]))) and {r[4] for r in ends[scope] if r[2] == "expire"} == opened


def test_events_of_a_batch_are_held_as_columns():
    """A scope's batch isn't held as plain values, its decisions neither; order and values are those of plain ones."""
    rng = random.Random(2)
    rows = [{"scope": "s", **event(k, rng.randrange(30_000), location=at(48.0 + rng.random(), 33.0), heading=at(49.0, 34.0) if k % 3 else None), "event_id": f"{k:06d}"} for k in range(6000)]
    frames = [pd.DataFrame(rows[k : k + 1500], columns=timers.ARROW_EVENT.names) for k in range(0, 6000, 1500)]
    held = timers.Ordered(iter(frames))
    assert list(held) == correlate.events_of(pd.concat(frames, ignore_index=True)) and held.newest == max(r["timestamp"] for r in rows)
    assert held.rows.nbytes < 300 * len(rows)

    class State:
        def __init__(self):
            self.of = {}

        def __getattr__(self, name):
            return {"iterator": lambda: iter(()), "exists": lambda: False, "listTimers": lambda: iter(())}.get(name, lambda *a: None)

    of, made = timers.Correlating(Settings()), []
    for name in ("handle", "live", "resting", "replies", "channels", "told"):
        setattr(of, name, State())
    for frame in of.handleInputRows(("s",), iter(frames), None):
        assert len(frame) <= timers.SOME
        made += frame["seq"].tolist()
    assert made == list(range(len(made))) and len(made) >= 6000


def places(spark, names):
    return spark.createDataFrame([(k, n, 50.0 + k, 36.0, "village", None, [n.lower()]) for k, n in enumerate(names, 1)], "id bigint, canonical string, lat double, lng double, type string, parent string, aliases array<string>")


def test_messages_to_incidents(spark):
    """A gazetteer change takes hold with the next batch; a batch that is tried again keeps its version, and nothing that it stored stays."""
    folder = shared.shared_folder(spark, "test-live")
    gazetteer = f"{folder}/gazetteer"
    rows = [(k + 1, "c", text, 1_700_000_000 + 60 * k) for k, text in enumerate(["Шахед курсом на Alpha", "Шахед курсом на Beta", "Взрывы в районе Alpha", "Шахед курсом на Beta", "дефендеры Alpha"])]
    messages = spark.createDataFrame(rows, "id bigint, channel_name string, text string, timestamp bigint")
    with pytest.raises(ValueError, match="no gazetteer"):
        live.version_of(spark, 0, gazetteer, folder)
    assert live.publish_gazetteer(places(spark, ["Alpha"]), gazetteer) == 1
    before = {p.name for p in Path(folder.removeprefix("file://")).parent.iterdir()}
    for k, part in enumerate([messages.where("id <= 2"), messages.where("id > 2")]):
        part.write.parquet(f"{folder}/in/{k}")
        events = live.parse_stream(spark.readStream.schema(messages.schema).parquet(f"{folder}/in/*"), gazetteer, folder)
        live.publish_gazetteer(places(spark, ["Alpha", "Beta"]), gazetteer)
    assert {p.name for p in Path(folder.removeprefix("file://")).parent.iterdir()} == before
    got = {r.id: (r.gazetteer_version, r.heading and r.heading.canonical_name, r.location and r.location.canonical_name) for r in events.collect()}
    assert got == {1: (1, "Alpha", None), 2: (1, None, None), 3: (2, None, "Alpha"), 4: (2, "Beta", None), 5: got[5]}
    assert live.version_of(spark, 0, gazetteer, folder) == 1 and live.version_of(spark, 1, gazetteer, folder) == 2 and live.version_of(spark, 2, gazetteer, folder) == 3
    decided = correlate.correlate(live.correlator_rows(events)).collect()
    routed = {r.event_id: r for r in parse.routed(events, queries.TRACKED)[0].collect()}
    assert {d.event_id for d in decided} == {i for i, r in routed.items() if r.location or r.heading or r.event_type == "impact"} and len(decided) >= 3
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events/*")
    by_stream = jobs.drained(timers.correlated(live.correlator_rows(stream)), f"{folder}/incidents").collect()
    assert {(d.seq, d.action, d.incident.id) for d in by_stream} == {(d.seq, d.action, d.incident.id) for d in decided}


def whole_fold(rows, settings=None):
    """Decisions of one fold over each scope's whole history."""
    out = {}
    for scope in {r["scope"] for r in rows}:
        c = correlate.Correlator(settings or Settings())
        some = sorted((r for r in rows if r["scope"] == scope), key=lambda r: (r["timestamp"], r["event_id"]))
        out[scope] = [(k, d["event_id"], d["action"], d["reason"], d["incident"]["id"], d["incident"]["status"], len(d["incident"]["trajectory"]), d["best"]) for k, d in enumerate(c.run(some))]
    return out


@pytest.mark.parametrize("ttl", [None, 3000])
def test_histories_cut_at_gaps(spark, ttl):
    """Cut at gaps, folded apart and numbered, decisions are those of one fold; replies and links over cuts hold."""
    rng, rows, settings = random.Random(5), [], Settings(impact_ttl=ttl) if ttl else Settings()
    for scope in ("a", "b"):
        t = 1_700_000_000
        for k in range(220):
            t += rng.choice([20, 90, 400, 1000, 1700, 1801, 2300, 6000, 40_000] if rng.random() < 0.5 else [10, 60])
            of = f"{scope}{k}"
            more = {"reply_to": rng.randrange(k)} if k and rng.random() < 0.15 else {}
            if k > 5 and rng.random() < 0.1:
                more |= {"continues_incident_id": hashlib.sha256(f"incident:{scope}{rng.randrange(k)}".encode()).hexdigest()[:32], "continuation_confidence": 0.9}
            kind = {"event_type": "impact"} if rng.random() < 0.4 else {}
            rows.append({"scope": scope, **event(k, t, location=at(49 + rng.random(), 36 + rng.random()), channel=rng.choice("xy"), **kind, **more), "event_id": of})
    df = spark.createDataFrame(rows, correlate.EVENT).repartition(5)
    got = {}
    for r in correlate.correlate(df, settings).orderBy("scope", "seq").collect():
        got.setdefault(r.scope, []).append((r.seq, r.event_id, r.action, r.reason, r.incident.id, r.incident.status, len(r.incident.trajectory), r.best))
    want = whole_fold(rows, settings)
    assert got == want
    reasons = {(r[3]) for rows_ in want.values() for r in rows_}
    assert {"reply_link", "llm_link", "stale"} <= reasons
    cut = correlate.segmented(df, settings)
    assert cut.select("scope", "segment").distinct().count() > 20 and cut.count() == len(rows)


def test_cuts_are_silent(spark):
    """Between two segments of a scope there is at least the reach of silence, and each scope has one last segment."""
    cut = correlate.segmented(queries.correlator_events(spark, SF)).select("scope", "segment", "final", "timestamp").collect()
    for scope in {r.scope for r in cut}:
        rows = sorted((r.timestamp, r.segment, r.final) for r in cut if r.scope == scope)
        for (t, s, _), (u, z, _) in zip(rows, rows[1:], strict=False):
            assert s == z or (z == s + 1 and u - t > correlate.reach(Settings()))
        assert all(f == (s == rows[-1][1]) for _, s, f in rows)
