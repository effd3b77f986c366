"""Domain operators on small made-up tables."""

import json
import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tocsin.functions import geo, text
from tocsin.operators import correlate, lexicon, parse, resolve, risk, serve
from tocsin.plans.queries import QUERIES, correlator_events, districts
from tocsin.plans.settings import Settings
from tocsin.sources import readers
from tocsin.streaming import jobs, timers

PLACES = [
    (1, "Верхнє", 50.10, 36.20, "village", "Харківська область", ["верхнее", "верхнего"]),
    (2, "Довга Долина", 50.00, 36.40, "village", "Довжанська громада", ["долгая долина", "долгую долину"]),
    (3, "Ставки", 49.95, 36.25, "district", "Харків", ["ставки", "ставков", "ставкам"]),
    (4, "Ставки Нові", 49.50, 36.90, "village", None, ["новые ставки"]),
    (5, "Лозове", 49.80, 36.10, "city", None, ["лозовое", "лозовому"]),
]


@pytest.fixture(scope="module")
def gazetteer(spark):
    return spark.createDataFrame(PLACES, "id bigint, canonical string, lat double, lng double, type string, parent string, aliases array<string>")


def resolved(spark, gazetteer, names, f=resolve.resolve):
    out = f(spark.createDataFrame([(n,) for n in names], "raw string"), gazetteer).collect()
    return {r.raw: r.place for r in out}


def test_resolve(spark, gazetteer):
    got = resolved(spark, gazetteer, ["ВЕРХНЄ ⚠", "верхнего", "долгую", "верхние", "ставки", "Лозовое!", "нигде", "лоозвое"])
    assert (got["ВЕРХНЄ ⚠"].canonical_name, got["ВЕРХНЄ ⚠"].match_type, got["ВЕРХНЄ ⚠"].confidence) == ("Верхнє", "exact", 0.95)
    assert got["верхнего"].match_type == "alias" and got["долгую"].canonical_name == "Довга Долина" and got["долгую"].confidence == 0.8
    assert got["ставки"].canonical_name == "Ставки" and got["Лозовое!"].confidence == 0.8
    assert got["верхние"].match_type == "fuzzy" and got["верхние"].confidence == 0.7 and got["лоозвое"].match_type == "fuzzy" and got["нигде"] is None
    assert [r.name for r in resolve.unmatched(spark.createDataFrame([("x", None), ("y", "p")], "raw string, place string")).collect()] == ["x"]


def test_resolve_parts(spark, gazetteer):
    got = resolved(spark, gazetteer, ["верхние/лоозвое", "верхние, ннигдее", "верхнее"], resolve.resolve_best_effort)
    both = got["верхние/лоозвое"]
    assert both.type == "composite" and both.canonical_name == "Верхнє / Лозове" and math.isclose(both.lat, 49.95) and math.isclose(both.confidence, 0.56)
    assert math.isclose(got["верхние, ннигдее"].confidence, 0.7 * 0.85) and got["верхнее"].confidence == 0.95


@given(st.text("абвab", max_size=7), st.text("абвab", max_size=7))
def test_osa(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert text.osa(a, b) == d[-1][-1] == text.osa(b, a) == text.osa_bits(a, b) == text.osa_all([a, "x"], [b, "xy"])[0]


def test_osa_of_long_words():
    """In the bits of numbers, words of any length have the same distance, in batches too."""
    rng = random.Random(2)
    pairs = []
    for n in [0, 1, 2, 20, 62, 63, 64, 65, 66, 130, 300] * 12:
        a = [rng.choice("abщ\U0001f600") for _ in range(n)]
        b = a[:]
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = rng.choice([[], ["a"], b[k : k + 2][::-1]])
        pairs += [("".join(a), "".join(b)), ("".join(b), "".join(a))]
    pairs += [("a\0", "a"), ("\0", ""), ("", "\0b")]
    assert text.osa_all(*map(list, zip(*pairs, strict=True))).tolist() == [text.osa(*p) for p in pairs] == [text.osa_bits(*p) for p in pairs]


def test_near_spellings_of_short_names(spark):
    """Every pair of a name and an alias with at most two edits is found, short ones too."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(90)})
    left = spark.createDataFrame([(w, w) for w in words[::2]], "raw string, norm string")
    index = spark.createDataFrame([(w, w) for w in words[1::2]], "alias string, canonical string")
    got = {(r.norm, r.alias, r.d) for r in resolve.near_spellings(left, index).collect()}
    assert got == {(x, y, d) for x in words[::2] for y in words[1::2] if (d := text.osa(x, y)) <= 2}


def test_parse(spark, gazetteer):
    rows = [
        (1, "Шахед курсом на Лозовое", "shahed", "tracking", None, "Лозове"), (2, "2 БпЛА через верхнее на ставки", "bpla", "tracking", None, "Ставки"),
        (3, "Взрывы в районе ставков", "unknown", "impact", "Ставки", None), (4, "Залетают на верхнее, лозовое", "bpla", "tracking", "Верхнє", "Лозове"),
        (5, "верхнего", "unknown", "tracking", "Верхнє", None), (6, "что-то непонятное совсем без места тут", None, None, None, None), (7, "ПВО сбили Шахед", "shahed", "tracking", None, None),
        (8, "еще +1 Молния дальше на верхнее", "molniya", "tracking", None, "Верхнє"), (9, "между верхнее и лозовое", "unknown", "tracking", "Верхнє — Лозове", None), (10, "КР на верхнее", "missile", "tracking", None, "Верхнє"), (0, "Шахед", None, None, None, None),
    ]
    m = spark.createDataFrame([(i, "c", t, 100 + i) for i, t, *_ in rows], "id bigint, channel_name string, text string, timestamp bigint")
    got = {r.id: r for r in parse.parse(m, gazetteer).collect()}
    assert 0 not in got
    for i, _, weapon, kind, location, heading in rows[:-1]:
        r = got[i]
        assert r.event_type == kind and (kind is None or r.weapon_type == weapon), r
        assert (r.location and r.location.canonical_name) == location and (r.heading and r.heading.canonical_name) == heading, r
    assert got[2].weapon_count == 2 and got[2].via.canonical_name == "Верхнє" and got[7].filtered_out and not got[1].filtered_out
    assert got[8].count_delta == 1 and got[8].is_followup and math.isclose(got[1].confidence, 0.6) and math.isclose(got[9].location.lat, 49.95)
    tracked, other = parse.routed(parse.parse(m, gazetteer), ("shahed", "bpla", "unknown", "molniya"))
    assert 7 not in {r.id for r in tracked.collect()} and {r.id for r in other.collect()} == {10}


def event(k, t, **more):
    base = {"event_id": f"e{k}", "message_id": k, "reply_to": None, "channel": "c", "timestamp": t, "event_type": "tracking", "weapon_type": "shahed", "weapon_count": 1, "confidence": 0.8, "location": None, "via": None, "heading": None, "is_correction": False, "is_followup": False, "count_delta": 0, "phrase_intents": [], "continues_incident_id": None, "continuation_confidence": 0.0}
    return base | more


def at(lat, lng, name="p"):
    return {"lat": lat, "lng": lng, "name": name}


def test_correlator_track():
    out = list(correlate.Correlator().run([
        event(1, 0, location=at(50.10, 36.20)), event(2, 120, location=at(50.08, 36.21)), event(3, 200, heading=at(50.0, 36.25), is_followup=True),
        event(4, 260, location=at(50.05, 36.22), event_type="impact"), event(5, 300), event(6, 5000, location=at(50.05, 36.22)),
    ]))
    assert [d["action"] for d in out] == ["new", "update", "update", "update", "new"]  # the impact stays, but is too old to go on
    last = out[3]["incident"]
    assert last["status"] == "impact" and len(last["trajectory"]) == 3 and last["eta_seconds"] is not None
    assert len(out[2]["incident"]["trajectory"]) == 2 and out[2]["incident"]["heading"]["lat"] == 50.0


def test_correlator_rules():
    c = correlate.Correlator()
    first = c.apply(event(1, 0, location=at(50.1, 36.2)))["incident"]
    split = c.apply(event(2, 60, location=at(50.1, 36.2), count_delta=1))
    assert split["action"] == "new" and split["reason"].startswith("count_delta") and split["threshold"] == math.inf
    more = c.apply(event(3, 90, heading=at(50.0, 36.2), count_delta=1, is_followup=True))
    assert more["action"] == "update" and more["incident"]["weapon_count"] == 2 and len(more["incident"]["trajectory"]) == 1
    reply = c.apply(event(4, 100, weapon_type="fpv", location=at(48.0, 30.0), reply_to=1))
    assert reply["reason"] == "reply_link" and reply["best"] == 1.2 and reply["incident"]["id"] == first["id"]
    origin = correlate.Correlator().apply(event(5, 200, weapon_type="kab", heading=at(50.2, 36.3), channel="z"))["incident"]
    assert 27 < correlate.haversine(origin["trajectory"][0], at(50.2, 36.3)) < 29
    gone = c.expire(100 + 1801)
    assert {g["id"] for g in gone} >= {first["id"]} and all(g["status"] == "expired" for g in gone)
    assert correlate.Correlator.load(c.dump(), Settings()).dump() == c.dump()


@pytest.mark.parametrize("cuts", [1, 3])
def test_stream_equals_batch(spark, tmp_path, cuts):
    e = correlator_events(spark, "/root/testdata/sf0.001").where("scope IN ('1', '2')").cache()
    batch = {(r.scope, r.seq): (r.event_id, r.action, r.incident.id) for r in correlate.correlate(e).collect()}
    e.repartitionByRange(cuts, "timestamp").write.parquet(f"{tmp_path}/in")
    times = sorted((min(r.timestamp for r in spark.read.parquet(f).collect()), f) for f in map(str, (tmp_path / "in").glob("*.parquet")))
    for k, (_, f) in enumerate(times):
        spark.read.parquet(f).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ordered/k={k}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ordered/*")
    got = {(r.scope, r.seq): (r.event_id, r.action, r.incident.id) for r in jobs.drained(timers.correlated(stream), str(tmp_path / "run")).collect()}
    assert batch.items() <= got.items() and len(batch) > 20
    assert all(got[k][1] == "expire" for k in got.keys() - batch.keys())  # ends that no later event shows


def test_geometry(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(48, 51), rng.uniform(35, 38), rng.uniform(0, 359), rng.uniform(1, 50)) for _ in range(50)]
    df = spark.createDataFrame(rows, "lat double, lng double, b double, km double").withColumn("d", geo.destination(F.col("lat"), F.col("lng"), F.col("b"), F.col("km")))
    for r in df.select("*", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("d.lat"), F.col("d.lng")).alias("back"), geo.bearing(F.col("lat"), F.col("lng"), F.col("d.lat"), F.col("d.lng")).alias("turn")).collect():
        assert math.isclose(r.back, r.km, rel_tol=1e-6) and abs((r.turn - r.b + 180) % 360 - 180) < 1e-4
        p = correlate.destination(at(r.lat, r.lng), r.b, r.km)
        assert math.isclose(p["lat"], r.d.lat, abs_tol=1e-9) and math.isclose(p["lng"], r.d.lng, abs_tol=1e-9)
    ring = F.array(*(F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in ((36, 50), (37, 50), (37, 51), (36, 51), (36, 50))))
    one = spark.range(1).select(geo.in_ring(36.5, 50.5, ring).alias("i"), geo.in_ring(35.5, 50.5, ring).alias("o"), geo.ring_distance_km(50.5, 37.5, ring).alias("d"), geo.centroid(ring).alias("c"), geo.segment_enters(50.5, 35.0, 50.5, 38.0, ring).alias("s"), geo.midpoint(0, 0, 2, 4)["lng"].alias("m")).first()
    assert one.i and not one.o and abs(one.d - 0.5 * 111.32 * math.cos(math.radians(50.5))) < 1e-6 and one.c.lat == 50.5 and one.s and one.m == 2


def test_risk(spark):
    ring = [{"lng": x, "lat": y} for x, y in ((36.0, 50.0), (36.1, 50.0), (36.1, 50.1), (36.0, 50.1))]
    d = spark.createDataFrame([("a", 0, ring)], "id string, ordinal int, ring array<struct<lng: double, lat: double>>")

    def rank(lat, lng, b=None, v=None, eta=None, h=(None, None)):
        i = spark.createDataFrame([("active", lat, lng, b, v, eta, *h)], "status string, lat double, lng double, bearing_deg double, speed_kmh double, eta_seconds bigint, heading_lat double, heading_lng double")
        return risk.threats(i, d).first()["rank"]

    assert rank(50.05, 36.05) == 2 and rank(50.05, 36.13) == 1 and rank(50.05, 36.5) == 0
    assert rank(50.05, 36.18, 270.0, 180.0) == 2 and rank(50.05, 36.21, 270.0, 180.0) == 1 and rank(50.05, 36.19, 270.0, 100.0, 100, (50.05, 36.05)) == 1
    ticks = spark.createDataFrame([("a", t * 1000, r) for t, r in ((0, 2), (60, 0), (200, 0), (360, 0), (400, 1), (500, 0))], "id string, at_ms bigint, rank int")
    assert [r.level for r in risk.cooled(ticks).orderBy("at_ms").collect()] == ["red", "green", "green", None, "orange", "green"]
    marks = spark.createDataFrame([("a", 0, True), ("a", 500, False), ("b", 9, False)], "id string, at_ms bigint, is_impact boolean")
    assert {tuple(r) for r in risk.merge_overrides(marks).collect()} == {("a", 2, 600_500), ("b", 1, 600_009)}


def test_threats_by_group(spark):
    """Every rule decides some rank, on all error events of each user, and groups without a threat keep their districts."""
    ring = [{"lng": x, "lat": y} for x, y in ((36.0, 50.0), (36.1, 50.0), (36.1, 50.1), (36.0, 50.1))]
    d = spark.createDataFrame([("a", 0, ring)], "id string, ordinal int, ring array<struct<lng: double, lat: double>>")
    rows = [(1, "active", 50.05, 36.05), (1, "active", 50.05, 36.13), (2, "active", 50.05, 36.13), (3, "active", 10.0, 10.0), (4, "expired", 50.05, 36.05), (None, "active", 50.05, 36.13)]
    i = spark.createDataFrame(rows, "g int, status string, lat double, lng double").withColumns({c: F.lit(None).cast("double") for c in ("bearing_deg", "speed_kmh", "eta_seconds", "heading_lat", "heading_lng")})
    assert {(r.g, r.id, r["rank"]) for r in risk.threats(i, d, by=("g",)).collect()} == {(1, "a", 2), (2, "a", 1), (3, "a", 0), (4, "a", 0), (None, "a", 1)}

    sf = "/root/testdata/sf0.001"
    seen, threats = {}, risk.threats
    with pytest.MonkeyPatch.context() as m:
        m.setattr(risk, "threats", lambda incidents, *a, **k: seen.setdefault("rows", incidents) and threats(incidents, *a, **k))
        got = {(r.user_id, r.id): r["rank"] for r in QUERIES["district_threat_users"](spark, sf).collect()}
    moving, d = seen["rows"], districts(spark)
    errors = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error'")
    assert moving.count() == errors.count() and len(got) == 9 * errors.select("user_id").distinct().count() and set(got.values()) == {0, 1, 2}
    for lost in ("bearing_deg", "eta_seconds"):
        less = {(r.user_id, r.id): r["rank"] for r in threats(moving.withColumn(lost, F.lit(None).cast("double")), d, by=("user_id",)).collect()}
        assert less.keys() == got.keys() and all(less[x] <= got[x] for x in got) and less != got


def test_level_counts(spark):
    levels = spark.createDataFrame([("a", "red"), ("b", "orange"), ("c", "red"), ("d", "green"), ("e", None)], "id string, level string")
    assert tuple(risk.level_counts(levels).first()) == (2, 1) and tuple(risk.level_counts(levels.where("false")).first()) == (0, 0)


def test_serving(spark):
    t = [{"lat": 50.0, "lng": 36.0, "timestamp": 0, "name": "a"}, {"lat": 50.1, "lng": 36.0, "timestamp": 60, "name": "b"}]
    i = spark.createDataFrame([("x", "shahed", 0.5, "active", t, None), ("y", "nothing", 0.9, "active", t[:1], None)], f"id string, weapon_type string, confidence double, status string, trajectory array<{correlate.POINT}>, projection_anchor {correlate.POINT}")
    x, y = serve.position_at(serve.live(i), 120).orderBy("id").collect()
    assert (x.label, x.speed_kmh, x.flags, round(x.bearing_deg), x.eta_seconds) == ("Шахед-136", 180.0, ["low_confidence"], 0, 240) and x.now_at.lat > 50.1
    assert (y.label, y.color, y.bearing_deg, y.flags, y.now_at.lat) == ("nothing", "#888", None, [], 50.0)
    j = spark.createDataFrame([('{"lat": 1, "lng": 2, "timestamp": 3}',), ("{broken",), (None,)], "j string").select(serve.anchor(F.col("j")).alias("a")).collect()
    assert [r.a is not None for r in j] == [True, False, False]


def test_sources(spark, tmp_path):
    geojson = {"features": [{"properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[36, 50], [37, 50], [37, 51], [36, 50]]]}}, {"properties": {"name": "B"}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2]]]}}]}
    (tmp_path / "d.geojson").write_text(json.dumps(geojson))
    got = readers.rings(spark, str(tmp_path / "d.geojson"), {"A": "a"}).collect()
    assert len(got) == 1 and got[0].id == "a" and len(got[0].ring) == 4
    members = spark.createDataFrame([(1, 0, 10), (1, 1, 11)], "relation bigint, pos int, way bigint")
    ways = spark.createDataFrame([(10, 0, 1), (10, 1, 2), (11, 0, 1), (11, 1, 3), (11, 2, 2)], "way bigint, pos int, node bigint")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0)], "node bigint, lng double, lat double")
    assert [(p.lng, p.lat) for p in readers.ways_to_rings(members, ways, nodes).first().points] == [(0, 0), (1, 0), (0, 1), (0, 0)]
    c = spark.createDataFrame([(1, "new", "a", "1"), (2, "snapshot", "b", "2"), (3, "new", "c", "3"), (4, "expire", "c", ""), (5, "update", "b", "5")], readers.CHANGELOG)
    assert [tuple(r) for r in readers.applied(c).collect()] == [("b", 5, "5")]
    (tmp_path / "poll").mkdir()
    (tmp_path / "poll/x.json").write_text("".join(json.dumps({"channel_name": "c", "telegram_id": k, "text": "t", "timestamp": k}) + "\n" for k in range(5)))
    spark.dataSource.register(readers.PolledMessages)
    s = spark.readStream.format("polled_messages").option("path", str(tmp_path / "poll")).option("limit", 2).load()
    q = s.writeStream.format("memory").queryName("polled").start()
    for _ in range(100):
        q.processAllAvailable()
        if spark.table("polled").count() == 5:
            break
    q.stop()
    assert sorted(r.telegram_id for r in spark.table("polled").collect()) == [0, 1, 2, 3, 4]


def test_model_answers(spark):
    good = {"event_type": "tracking", "weapon_type": "bpla", "confidence": 0.9, "continues_incident_id": "live", "continuation_confidence": 0.7}
    a = spark.createDataFrame([(1, "```json\n" + json.dumps(good) + "\n```"), (2, "nonsense"), (3, json.dumps(good | {"continues_incident_id": "gone"})), (4, json.dumps(good | {"event_type": "x"})), (5, None)], "id bigint, answer string")
    got = {r.id: r for r in parse.model_events(a, spark.createDataFrame([("live",)], "id string")).collect()}
    assert got[1].reason is None and got[1].continues_incident_id == "live" and math.isclose(got[1].confidence, 0.81) and got[2].reason == "invalid_json"
    assert got[3].continues_incident_id is None and got[3].continuation_confidence == 0 and got[4].reason == "invalid_schema" and got[5].reason == "empty"


def test_lexicon(spark):
    lx = spark.createDataFrame([("A", ["x", "Y "], 0.95), ("B", ["y"], 0.5), ("C", ["z"], 0.9)], "canonical string, aliases array<string>, confidence double")
    assert [tuple(r) for r in lexicon.collisions(lx).collect()] == [("y", 2, "error")] and [r.canonical for r in lexicon.low_confidence(lx, 0.7).collect()] == ["B"]
    listed = spark.createDataFrame([("y",)], "term string")
    assert lexicon.collisions(lx, listed).first().severity == "warning" and lexicon.low_confidence(lx, 0.7, ("B",)).count() == 0
    names = spark.createDataFrame([("Яма", 1), ("яма ", 2), ("Їжа", 3)], "v string, k int")
    assert [r.v for r in lexicon.sorted_unique(names, "v", "k").collect()] == ["Їжа", "Яма"]


def test_plans(spark, gazetteer, capsys):
    inc = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_orderkey").alias("last_updated_at"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("id"))
    serve.stale(inc, 10_000).explain("formatted")
    assert "PushedFilters: [IsNotNull(status)" in capsys.readouterr().out.replace("IsNotNull(o_orderstatus)", "IsNotNull(status)")


def test_parse_reads_once(spark, gazetteer, capsys):
    """Texts are read by one scan, before names are resolved: the result's plan has the stored captures only, and no nested loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1).alias("id"), F.lit("c").alias("channel_name"), "text", F.lit(0).alias("timestamp"))
    parse.parse(docs, gazetteer).explain("formatted")
    plan = capsys.readouterr().out
    assert "documents.parquet" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    rows = spark.createDataFrame([(1, "c", "Шахед курсом на Лозовое", 1), (1, "c", "КАБ на верхнее", 1), (2, "c", None, 1)], "id bigint, channel_name string, text string, timestamp bigint")
    assert sorted(r.weapon_type for r in parse.parse(rows, gazetteer).collect()) == ["kab", "shahed"]


def pairs_within(a, b):
    return {(x, y) for x in a for y in b if text.osa(x, y) <= 2}


def test_near_and_containing(spark):
    """Both candidate joins against all pairs, also for names that are shorter than the pieces."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("аб") for _ in range(n))
    names, aliases = sorted({word(rng.randrange(1, 12)) for _ in range(60)}), sorted({word(rng.randrange(1, 12)) for _ in range(60)})
    left = spark.createDataFrame([(n, n) for n in names], "raw string, norm string")
    index = spark.createDataFrame([(k, 0, a, a) for k, a in enumerate(aliases)], "id bigint, pos int, alias string, canonical string")
    near = {(r.raw, r.alias): r.d for r in resolve.near_spellings(left, index).collect()}
    assert set(near) == pairs_within(names, aliases) and all(text.osa(*k) == d for k, d in near.items())
    held = [(r.raw, r.alias) for r in resolve.containing(left, index).collect()]
    assert sorted(held) == sorted((x, y) for x in names for y in aliases if min(len(x), len(y)) >= 3 and (x in y or y in x))


def test_names(spark, gazetteer):
    assert [r.canonical for r in resolve.known_names(gazetteer).collect()] == [p[1] for p in PLACES]
    corpus = {r.canonical: r for r in resolve.runtime_corpus(gazetteer).collect()}
    assert corpus["Ставки"].normalized_aliases == ["ставкам", "ставки", "ставков"] and corpus["Верхнє"].normalized_canonical == "верхне"
    twice = gazetteer.unionByName(gazetteer.withColumn("id", F.col("id") + 100).withColumn("lat", F.lit(0.0)))
    assert resolved(spark, twice, ["верхнего"])["верхнего"].lat == 50.1  # of two entries of a name, the first
    one = spark.createDataFrame([(" 12.5 ", "долиною", "полку"), ("x", "лесом", "верх")], "n string, a string, b string")
    assert [tuple(r) for r in one.select(text.to_number(F.col("n")), text.strip_case_ending(F.col("a")), text.strip_case_ending(F.col("b"))).collect()] == [(12.5, "долина", "полка"), (None, "лес", "верх")]
    more = lexicon.merged_aliases(gazetteer.where("id = 1"), spark.createDataFrame([("Верхнє", ["верх", "верхнего"]), ("Інше", ["x"])], "canonical string, aliases array<string>"))
    assert more.first().aliases == ["верхнее", "верхнего", "верх"]


def test_override_runs(spark):
    """Red ends with its run: an orange mark after its end doesn't bring it back."""
    at = lambda *rows: spark.createDataFrame([(i, t * 1000, x) for i, t, x in rows], "id string, at_ms bigint, is_impact boolean")
    merged = lambda *rows: {r.id: (r["rank"], r.expires_at) for r in risk.merge_overrides(at(*rows)).collect()}
    assert merged(("a", 0, True), ("a", 700, False)) == {"a": (1, 1_300_000)}
    assert merged(("a", 0, True), ("a", 599, False)) == {"a": (2, 1_199_000)} and merged(("a", 0, True), ("a", 600, False)) == {"a": (1, 1_200_000)}
    runs = sorted((r["rank"], r.from_ms, r.expires_at) for r in risk.override_runs(at(("a", 0, False), ("a", 100, True), ("a", 300, False), ("a", 2000, False))).collect())
    assert runs == [(1, 0, 100_000), (1, 2_000_000, 2_600_000), (2, 100_000, 900_000)]
    known = spark.createDataFrame([(1, ["a", None, "a"]), (2, []), (3, None)], "event_id int, ids array<string>")
    got = sorted((r.event_id, r.id) for r in risk.override_targets(known.withColumn("ids", F.coalesce("ids", F.array().cast("array<string>"))), F.array(F.lit("a"), F.lit("b"))).collect())
    assert got == [(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b")]


def test_levels_state():
    of = jobs.Levels()
    assert of.apply(0, "mark", 2) is None and of.apply(1_000, "tick", 0) == (2, "red") and of.apply(599_999, "tick", 1) == (2, "red")
    assert of.apply(600_000, "tick", 0) == (0, "green") and of.apply(899_999, "tick", 0) == (0, "green") and of.apply(900_000, "tick", 0) == (0, None)
    of.apply(900_001, "tick", 2)
    again = jobs.Levels(*of.state())
    again.apply(900_002, "reset", 0)
    assert again.apply(900_003, "tick", 0) == (0, None) and of.apply(900_003, "tick", 0) == (0, "green")


def test_correlator_forgets():
    """Messages of expired incidents go, and candidates are those of the active window, the newest first."""
    c = correlate.Correlator()
    for k in range(20):
        list(c.run([event(k, 2000 * k, location=at(50.0 + k, 36.0))]))
    assert len(c.incidents) == 1 and len(c.replies) == 1
    c = correlate.Correlator()
    for k in range(6):
        c.apply(event(k, 300 * k, location=at(40.0 + 5 * k, 36.0), channel=f"c{k}", weapon_type=("shahed", "fpv", "molniya", "lancet", "kab", "rszo")[k]))
    assert [i["last_updated_at"] for i in c._since(300)] == [1500, 1200, 900, 600, 300] and len(c.incidents) == 6
    again = correlate.Correlator.load(c.dump(), Settings())
    assert [i["id"] for i in again._since(0)] == [i["id"] for i in c._since(0)]
    ttl = correlate.Correlator(Settings(impact_ttl=100))
    ttl.apply(event(1, 0, location=at(50.0, 36.0), event_type="impact"))
    assert not correlate.Correlator().expire(10**9) and [i["status"] for i in ttl.expire(101)] == ["expired"] and not ttl.replies


ANSWER = {"event_type": "tracking", "weapon_type": "bpla", "weapon_count": 1, "confidence": 0.9, "continuation_confidence": 0.0}


def test_placed_events(spark, gazetteer):
    """Pairs, fallbacks to incidents, and headings that the text names."""
    said = [
        (1, "БпЛА на верхнее/лозовое", {}), (2, "БпЛА верхнее/лозовое", {"location": "ставки"}), (3, "БпЛА", {"location": "ставки", "heading": "лозовое"}), (4, "БпЛА летит", {}), (5, "далее на лозовое", {}),
        (6, "БпЛА", {"continues_incident_id": "old", "continuation_confidence": 0.35}), (7, "верхнее/ннигдее", {}), (8, "БпЛА", {}), (9, "взрыв", {"event_type": "impact"}),
    ]
    rows = [(i, "z" if i == 8 else "c", t, 1000, json.dumps(ANSWER | more)) for i, t, more in said]
    point = {"lat": 50.3, "lng": 36.6, "name": ""}
    active = spark.createDataFrame(
        [("new", ["c"], 900, [point], None), ("older", ["c", "z"], 10, [point | {"lat": 51.0}], None), ("old", ["q"], -5000, [point | {"name": "Десь"}], point | {"name": "Там"})],
        "id string, source_channels array<string>, last_updated_at bigint, trajectory array<struct<lat: double, lng: double, name: string>>, heading struct<lat: double, lng: double, name: string>",
    )
    messages = spark.createDataFrame(rows, "id bigint, channel_name string, text string, timestamp bigint, answer string")
    answers = parse.model_events(messages, active)
    got = {r.id: r for r in parse.placed_events(answers, gazetteer, active, settings=Settings(context_window=600)).collect()}
    assert len(got) == len(said) and all(r.reason is None for i, r in got.items() if i != 8) and got[8].reason == "tracking_without_geo"
    assert got[1].location.canonical_name == "Верхнє / Лозове (approach)" and got[1].heading.canonical_name == "Верхнє / Лозове" and math.isclose(got[1].heading.lat, 49.95)
    gap = correlate.haversine({"lat": got[1].location.lat, "lng": got[1].location.lng}, {"lat": got[1].heading.lat, "lng": got[1].heading.lng})
    assert math.isclose(gap, 14, rel_tol=1e-6) and math.isclose(got[1].location.confidence, 0.8 * 0.85 * 0.92)  # "на верхнее" is found in part
    assert got[2].location.canonical_name == "Верхнє / Лозове" == got[2].heading.canonical_name and got[2].location.parent == "Харківська область"
    assert (got[3].location.canonical_name, got[3].heading.canonical_name) == ("Ставки", "Лозове")
    assert (got[4].location.canonical_name, got[4].location.lat, got[4].heading) == ("Incident last point", 50.3, None)
    assert got[5].location is None and got[5].heading.canonical_name == "Лозове"
    assert (got[6].location.canonical_name, got[6].heading.canonical_name, got[6].location.confidence) == ("Десь", "Там", 0.45)
    assert got[7].location.canonical_name == "Верхнє" and got[9].location is None and got[9].heading is None


def test_pluggable_model(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string")

    def call(texts):
        return [json.dumps(ANSWER) if t == "a" else None for t in texts]

    def broken(texts):
        raise ConnectionError

    assert {r.id: r.answer is not None for r in parse.answered(m, call).collect()} == {1: True, 2: False}
    assert [r.answer for r in parse.answered(m, broken).collect()] == [None, None]
    assert [tuple(r) for r in parse.answered(m, broken).transform(lambda d: parse.model_events(d, spark.createDataFrame([], "id string"))).select("id", "reason").orderBy("id").collect()] == [(1, "empty"), (2, "empty")]


def test_hints_and_settings(spark, monkeypatch):
    df = spark.createDataFrame([(["correction", "impact", "continuation"], True, False, 1)], "p array<string>, c boolean, f boolean, d int")
    assert df.select(parse.hints(F.col("p"), F.col("c"), F.col("f"), F.col("d"))).first()[0] == ["correction", "continuation", "additional_unit"]
    monkeypatch.setenv("TOCSIN_STALE_AFTER", "60")
    monkeypatch.setenv("TOCSIN_STRICT_ALL_CLEAR", "yes")
    s = Settings.from_env()
    assert s.stale_after == 60 and s.strict_all_clear and s.edge_km == 5.0
    g = spark.range(1).select(geo.interpolate(1.0, 3.0, 0.25).alias("x"), geo.arrow_length(F.lit(-1.0)).alias("a"), geo.arrow_length(F.lit(1100.0)).alias("b"), geo.arrow_length(F.lit(9e9)).alias("c")).first()
    assert tuple(g) == (1.5, 28, 50, 72)


def test_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sorted(map(tuple, serve.new_rows(a.unionByName(a), a.where("k = 1"), ["k"]).collect())) == [(2, "y")]
    both = serve.evolved(a.select("k"), a)
    assert both.columns == ["k", "v"] and both.where("v IS NULL").count() == 2
    readers.append(a, f"{tmp_path}/t")
    readers.append(a, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    readers.overwrite(a.where("false"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 0
    assert {tuple(r) for r in serve.reset(spark.createDataFrame([("a", "active"), ("b", "expired")], "id string, status string")).collect()} == {("expire", "a")}
    levels = spark.createDataFrame([("a", "red"), ("b", None)], "id string, level string")
    assert serve.level_map(levels).first().levels == {"a": "red", "b": None}
    i = spark.createDataFrame([("active", 1.0, 2.0, 3, 4, [1]), ("impact", 1.0, 2.0, 3, 4, [1]), ("active", None, 2.0, 3, 4, []), ("active", 1.0, 2.0, None, 4, [1])], "status string, bearing_deg double, speed_kmh double, eta_seconds int, last_updated_at int, trajectory array<int>")
    assert [tuple(r) for r in i.select(serve.can_project(), serve.shows_arrow()).collect()] == [(True, True), (False, False), (False, False), (False, False)]


def test_publish(spark, tmp_path):
    e = correlator_events(spark, "/root/testdata/sf0.001").where("scope = '1'")
    e.write.parquet(f"{tmp_path}/in")
    seen = []
    q = jobs.publish(timers.correlated(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")), lambda batch, n: seen.extend((n, r.op, r.id, r.payload) for r in batch.collect()), f"{tmp_path}/c")
    q.processAllAvailable()
    q.stop()
    assert {op for _, op, _, _ in seen} <= {"new", "update", "expire"} and len(seen) > 10 and all(json.loads(p)["id"] == i for _, _, i, p in seen)


def test_lexicon_file(spark, tmp_path):
    raw = {
        "location_dictionary": [{"canonical": "A", "aliases": ["a", ""]}, {"canonical": "B", "confidence": 2}, {"canonical": "C", "aliases": ["c"], "confidence": 0.5, "notes": "n"}],
        "weapon_dictionary": [{"canonical": "kab"}, {"canonical": "none"}], "top_ambiguous_terms": [{"term": "t", "priority": "HIGH"}, {"term": "u", "priority": "x"}],
        "priority_hotspots": [{"canonical": "y", "priority_rank": 2}, {"canonical": "x", "priority_rank": 1}, {"canonical": "z", "priority_rank": 0.5}],
    }
    (tmp_path / "l.json").write_text(json.dumps(raw, indent=1))
    lists = readers.lexicon(spark, f"{tmp_path}/l.json")
    assert {(r.list, r.ordinal, r.problem) for r in lexicon.problems(lists).collect()} == {
        ("location_dictionary", 0, "an alias is empty"), ("location_dictionary", 1, "confidence is not from 0 to 1"), ("weapon_dictionary", 1, "canonical is no weapon"),
        ("top_ambiguous_terms", 1, "priority is none"), ("priority_hotspots", 2, "priority_rank is no positive integer"),
    }
    good = lexicon.usable(lists)
    assert [r.canonical for r in lexicon.ranked_hotspots(good["priority_hotspots"]).collect()] == ["x", "y"] and good["phrase_patterns"].count() == 0
    assert [(r.canonical, r.confidence, r.notes) for r in good["location_dictionary"].collect()] == [("C", 0.5, "n")] and good["weapon_dictionary"].first().confidence == 1
    (tmp_path / "g.json").write_text("".join(json.dumps({"canonical": c, "lat": 50.0, "lng": 36.0, "type": "village", "aliases": ["q"]}) + "\n" for c in "AC"))
    places = readers.gazetteer(spark, f"{tmp_path}/g.json", good["location_dictionary"])
    assert [(r.id, r.canonical, r.aliases) for r in places.orderBy("id").collect()] == [(1, "A", ["q"]), (2, "C", ["q", "c"])]


PHRASES = """через взрыв взрывы 💥 упали отбой чисто відбій Уточнение Предварительно далее дальше далі уже возле вже біля еще ещё ще +1 +12 3 БпЛА 2 Ударных Шахед ракет 4 дрона 5 залетают 6 берут Іскандер искандер С-300 с300 КАБ КР кр. крылатая ракета ракеты баллистика РСЗО ланцет FPV молния
довернули на развернулся на взял курс на повернул на разогнулся на над кружит в районе локационно через вдоль окружной на летит курсом летит ближе к снова опять на повторные пуски КАБ на заходят на повторные ещё 2 шаболды следом ещё 3 новая шаболда на Upd: это отбой, это предварительно сбили приземлили
задавили не наблюдается больше не фиксируется вылетела из города без угрозы для акустически по шаболдам по области петухи заходят на пуски по активность пусковых запуски РСЗО по угроза РСЗО для тревога по баллистике с между и в районе в район курсом сейчас на направление на свернула сменили курс подлетают к летят к
двигается к берёт курс к к на верхнее / лозовое верхнее/нижнее верхнее, лозовое - ставки ⚠ Молния ударный""".split()


def test_guards(spark, monkeypatch):
    """What is looked for before a pattern is tried changes nothing that patterns find."""
    rng = random.Random(11)
    whole = [
        "через лес на реку", "между лесом и рекой", "взрывы в районе леса", "в районе леса - реки", "курсом сейчас на лес", "направление на лес", "летит дальше на лес", "подлетают к лесу", "к лесу", "залетают на лес, реку", "лес/река", "на лес",
        "довернули на лес", "над лесом", "летит ближе к лесу", "снова взял курс на лес", "ещё 2 молния", "Upd: лес", "упали в районе", "больше не фиксируется", "акустически лес", "по шаболдам лес", "запуски РСЗО по лес", "3 Ударных БпЛА", "уже возле леса", "+1",
    ]
    some = [*PHRASES, *whole * 4]
    said = ["", "ВЗРЫВ ", " к лесу", "На север", *some, *(" ".join(rng.choice(some) for _ in range(rng.randrange(1, 7))) for _ in range(2000))]
    df = spark.createDataFrame([(k, rng.choice([t, t.upper(), t.lower(), t.replace(" ", "  \n")])) for k, t in enumerate(said)], "id bigint, text string")
    df = df.withColumn("clean", text.plain_spaces(F.col("text"))).withColumn("_low", parse.lowered(F.col("clean")))
    of = lambda: parse.with_flags(df, F.col("clean"), F.col("_low")).withColumns({f"_{k}": c for k, c in parse.captures(parse._SLOTS).items()}).drop("_low").orderBy("id").collect()
    guarded = of()
    monkeypatch.setattr(parse, "NEEDS", dict.fromkeys(parse.NEEDS, ("",)))
    plain = of()
    assert guarded == plain and all(any(r[f"_{k}"] for r in plain) for k in parse._SLOTS)
    assert {i for r in plain for i in r.phrase_intents} == {k for k, _ in parse.PHRASE_INTENTS} and len({r.weapon_type for r in plain}) > 9
