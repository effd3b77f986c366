"""Queries over the driver's tables, each applying operators of this package, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.functions import geo, text
from tocsin.operators import correlate, lexicon, parse, resolve, risk, serve
from tocsin.plans.settings import OTHER_NOTE, SPEED_KMH, THREAT_NOTES, TRACKED
from tocsin.sources import channels, readers
from tocsin.sources.shared import shared_folder
from tocsin.streaming import jobs, live, timers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The time that queries take as the present, in seconds.
NOW = 1706000000

# What the domain's roles are in the driver's tables: an event's place follows from its id,
# its channel is its type, an error is an impact, an incident is a type and a number.
EV = """ev AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
  49.0::DOUBLE + ((event_id * 7919) % 2000)::DOUBLE / 1000.0::DOUBLE AS lat, 36.0::DOUBLE + ((event_id * 104729) % 2000)::DOUBLE / 1000.0::DOUBLE AS lng FROM events)"""
INC = """inc AS (SELECT event_type || '-' || k AS id, event_type, max(event_id) AS last_event, count(*) AS n, min(sec) AS first_seen_at, max(sec) AS last_updated_at,
  CASE max(event_id) % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'impact' ELSE 'expired' END AS status FROM ev GROUP BY event_type, k)"""
RINGS = [(f"d{i}{j}", 3 * i + j, 49.0 + 0.7 * i, 36.0 + 0.7 * j) for i in range(3) for j in range(3)]
SIDE = 0.65
HAV = "6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - ({h})))"


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"power(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians(({d}) - ({b})) / 2), 2)"
    return HAV.format(h=h)


def brg(a: str, b: str, c: str, d: str) -> str:
    t = f"radians(({d}) - ({b}))"
    return f"(degrees(atan2(sin({t}) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({t}))) + 360.0) % 360.0"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    place = lambda base, m: F.lit(base) + (F.col("event_id") * m % 2000).cast("double") / F.lit(1000.0)
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("bigint")
    return e.select("event_id", "user_id", "event_type", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("bigint").alias("sec"), k.alias("k"), place(49.0, 7919).alias("lat"), place(36.0, 104729).alias("lng"))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    per = events(spark, sf).groupBy("event_type", "k").agg(F.max("event_id").alias("last_event"), F.count("*").alias("n"), F.min("sec").alias("first_seen_at"), F.max("sec").alias("last_updated_at"))
    status = F.when(F.col("last_event") % 3 == 0, "active").when(F.col("last_event") % 3 == 1, "impact").otherwise("expired")
    return per.select(F.concat_ws("-", "event_type", "k").alias("id"), "event_type", "last_event", "n", "first_seen_at", "last_updated_at", status.alias("status"))


def districts(spark: SparkSession) -> DataFrame:
    rows = [(i, o, [{"lng": x, "lat": y} for y, x in ((a, b), (a, b + SIDE), (a + SIDE, b + SIDE), (a + SIDE, b))]) for i, o, a, b in RINGS]
    return spark.createDataFrame(rows, "id string, ordinal int, ring array<struct<lng: double, lat: double>>")


BOXES = "boxes(id, ordinal, a, b, c, d) AS (VALUES " + ", ".join(f"('{i}', {o}, {a}::DOUBLE, {b}::DOUBLE, {a + SIDE}::DOUBLE, {b + SIDE}::DOUBLE)" for i, o, a, b in RINGS) + ")"


@query("impact_heatmap", f"WITH {EV} SELECT round(lat, 1) AS cell_lat, round(lng, 1) AS cell_lng, count(*) AS n, min(lat) AS lat, min(lng) AS lng FROM ev WHERE event_type = 'error' AND sec > {NOW} - 240 * 3600 AND value < 90 GROUP BY 1, 2")
def impact_heatmap(spark, sf):
    e = events(spark, sf).select(F.when(F.col("event_type") == "error", "impact").otherwise("tracking").alias("event_type"), "lat", "lng", F.col("sec").alias("created_at"), (F.col("value") >= 90).alias("filtered_out"))
    return serve.heatmap(e, NOW, 240, 1)


@query("count_by_category", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_category(spark, sf):
    return serve.count_by(table(spark, sf, "events"), "event_type")


_INCIDENT = "id, event_type, last_event, n, first_seen_at, last_updated_at, status"


@query("recent_by_cutoff", f"WITH {EV}, {INC} SELECT {_INCIDENT} FROM inc WHERE last_updated_at > {NOW} - 24 * 3600")
def recent_by_cutoff(spark, sf):
    return serve.newest(serve.recent(incidents(spark, sf), NOW, 24))


@query("active_status_filter", f"WITH {EV}, {INC} SELECT {_INCIDENT} FROM inc WHERE status IN ('active', 'impact')")
def active_status_filter(spark, sf):
    return serve.active(incidents(spark, sf))


@query("stale_filter", f"WITH {EV}, {INC} SELECT {_INCIDENT} FROM inc WHERE status = 'active' AND last_updated_at < {NOW} - 1800")
def stale_filter(spark, sf):
    return serve.stale(incidents(spark, sf), NOW)


@query("newest_top_k", f"WITH {EV}, {INC} SELECT id, last_updated_at FROM inc ORDER BY last_updated_at DESC, id LIMIT 20")
def newest_top_k(spark, sf):
    return serve.newest(incidents(spark, sf), 20).select("id", "last_updated_at")


@query("dedup_first_seen", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def dedup_first_seen(spark, sf):
    return serve.first_seen(table(spark, sf, "documents").select("text", "doc_id"), ["text"], ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


@query("insert_or_ignore", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) QUALIFY row_number() OVER (PARTITION BY o_orderkey) = 1")
def insert_or_ignore(spark, sf):
    held = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").dropDuplicates(["o_orderkey"]).join(held, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("channel_context_topk", f"WITH {EV}, c AS (SELECT event_id, sec, list(struct_pack(s := sec, i := event_id)) OVER (PARTITION BY event_type ORDER BY sec, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS l FROM ev) SELECT event_id, coalesce(len(list_filter(l, lambda m: m.s >= sec - 1200)), 0) AS n, coalesce(array_to_string(list_transform(list_filter(l, lambda m: m.s >= sec - 1200), lambda m: CAST(m.i AS VARCHAR)), ','), '') AS context FROM c")
def channel_context_topk(spark, sf):
    m = events(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").alias("channel"), "sec")
    return serve.channel_context(m).select(F.col("id").alias("event_id"), F.size("context").cast("bigint").alias("n"), F.array_join("context", ",").alias("context"))


@query("reply_parent_latest", f"WITH {EV}, r AS (SELECT event_id AS reply_id, event_type AS c, event_id - 1 - event_id % 7 AS p FROM ev), e AS (SELECT event_id, k, sec FROM ev WHERE value < 50) SELECT reply_id, arg_max(k, sec) AS incident_id FROM r JOIN e ON r.p = e.event_id GROUP BY 1")
def reply_parent_latest(spark, sf):
    e = events(spark, sf)
    replies = e.select(F.col("event_id").alias("reply_id"), F.lit("all").alias("channel"), (F.col("event_id") - 1 - F.col("event_id") % 7).alias("reply_to"))
    known = e.select(F.lit("all").alias("channel"), F.col("event_id").alias("message_id"), F.col("k").alias("incident_id"), F.col("sec").alias("created_at"), (F.col("value") >= 50).alias("filtered_out"))
    return serve.reply_incident(replies, known)


@query("summary_concat", f"WITH {EV} SELECT event_id, concat_ws(' ', event_type, CASE WHEN user_id % 3 > 0 THEN 'u' || user_id END, CASE WHEN k % 2 = 0 THEN 'loc:' || k END, CASE WHEN k % 5 = 0 THEN '→' || k END, 'inc:' || event_type) AS summary FROM ev")
def summary_concat(spark, sf):
    e = events(spark, sf)
    c = lambda x: F.col(x).cast("string")
    s = serve.summary(F.col("event_type"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("u"), c("user_id"))), F.when(F.col("k") % 2 == 0, c("k")), F.when(F.col("k") % 5 == 0, c("k")), F.col("event_type"))
    return e.select("event_id", s.alias("summary"))


KEYWORDS = ("The anth", "password", "STSH", "ПВО", "worthless")


@query("safety_keyword_filter", "SELECT doc_id, (" + " OR ".join(f"contains(lower(coalesce(text, '')), '{k.lower()}')" for k in KEYWORDS) + ") AS filtered_out FROM documents")
def safety_keyword_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.contains_any(F.col("text"), KEYWORDS).alias("filtered_out"))


@query("publish_routes", "SELECT route, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'tracked' WHEN event_type <> 'login' THEN 'district' END AS route FROM events WHERE value < 80) WHERE route IS NOT NULL GROUP BY 1")
def publish_routes(spark, sf):
    e = events(spark, sf).select(F.col("event_type").alias("weapon_type"), F.when(F.col("event_type") == "login", "all_clear").otherwise("tracking").alias("event_type"), (F.col("value") >= 80).alias("filtered_out"))
    tracked, other = parse.routed(e, ("click", "view"))
    return serve.count_by(tracked.select(F.lit("tracked").alias("route")).unionByName(other.select(F.lit("district").alias("route"))), "route")


@query("scope_case_ladder", "SELECT c_custkey, CASE WHEN r_name = 'Харків' OR n_name IN ('NATION_1', 'NATION_2') THEN 'city' WHEN n_nationkey % 2 = 0 THEN 'region' ELSE 'external' END AS scope FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def scope_case_ladder(spark, sf):
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # one row per nation: 25 at any scale
    c = table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("n_nationkey") % 2 == 0, "village").otherwise("street")
    return c.select("c_custkey", correlate.scope_case(kind, F.when(F.col("r_name") == "Харків", F.col("r_name")).otherwise(F.col("n_name")), ("NATION_1", "NATION_2")).alias("scope"))


_MARKS = "('BUILDING', 180.0), ('MACHINERY', 150.0), ('FURNITURE', 900.0)"


@query("weapon_dim_lookup", f"SELECT c_custkey, coalesce(v, 200.0)::DOUBLE AS speed FROM customer LEFT JOIN (VALUES {_MARKS}) AS d(s, v) ON c_mktsegment = s")
def weapon_dim_lookup(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", serve.lookup(F.col("c_mktsegment"), {"BUILDING": 180.0, "MACHINERY": 150.0, "FURNITURE": 900.0}, 200.0).alias("speed"))


@query("normalize_names", "SELECT p_partkey, translate(regexp_replace(lower(trim('  Ґ' || p_name || 'Ії Є ⚠💥 ')), '[⚠💥🔴\\s]+$', ''), 'іїєґ', 'ииег') AS norm FROM part")
def normalize_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.normalize(F.concat(F.lit("  Ґ"), "p_name", F.lit("Ії Є ⚠💥 "))).alias("norm"))


@query("tokenize_lexical_score", """WITH p AS (SELECT a.p_partkey, a.p_name AS q, b.p_name AS al, list_filter(regexp_split_to_array(a.p_name, '[^a-z0-9'']+'), lambda x: x <> '') AS qt, list_filter(regexp_split_to_array(b.p_name, '[^a-z0-9'']+'), lambda x: x <> '') AS tt FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1)
SELECT p_partkey, round(len(list_filter(qt, lambda x: list_contains(tt, x)))::DOUBLE / len(qt) + CASE WHEN starts_with(q, al) OR starts_with(al, q) THEN 0.2 ELSE 0 END + CASE WHEN contains(q, al) OR contains(al, q) THEN 0.1 ELSE 0 END + CASE WHEN len(qt) > 1 AND len(tt) > 1 AND qt[1] = tt[1] AND qt[-1] = tt[-1] THEN 0.3 ELSE 0 END, 6) AS score FROM p""")
def tokenize_lexical_score(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    pairs = p.join(p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("alias")), "p_partkey")
    return pairs.select("p_partkey", F.round(text.lexical_score(F.col("p_name"), F.col("alias")), 6).alias("score"))


def _gazetteer(spark, sf):
    """Names of parts as places: as many as there are distinct names, a fixed vocabulary."""
    g = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return g.select("id", F.col("p_name").alias("canonical"), (F.lit(49.0) + F.col("id") % 100 / 100.0).alias("lat"), (F.lit(36.0) + F.col("id") % 10 / 10.0).alias("lng"), F.lit("village").alias("type"), F.lit(None).cast("string").alias("parent"), F.array(F.concat(F.lit("the "), "p_name")).alias("aliases"))


@query("alias_exact_join", "SELECT p_partkey, (SELECT min(p_partkey) FROM part b WHERE b.p_name = a.p_name) AS place FROM part a")
def alias_exact_join(spark, sf):
    asked = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("The "), "p_name", F.lit(" ⚠"))).alias("raw")).withColumn("norm", text.normalize(F.col("raw")))
    index = resolve.alias_index(_gazetteer(spark, sf)).select("norm", F.col("id").alias("place"))
    return asked.join(index, "norm").select("p_partkey", "place")


@query("alias_substring_join", "WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS q FROM part) SELECT q, p_name AS canonical FROM w JOIN n ON length(q) >= 3 AND contains(p_name, q)")
def alias_substring_join(spark, sf):
    asked = table(spark, sf, "part").select(F.split("p_name", " ")[0].alias("q")).distinct()
    index = resolve.alias_index(_gazetteer(spark, sf)).where("pos = 0").select("canonical", F.col("norm").alias("alias"))
    return resolve.containing(asked.withColumn("norm", F.col("q")), index).select("q", "canonical")


@query("fuzzy_match_osa", """WITH n AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1), t AS (SELECT DISTINCT substr(p_name, 1, 1) || substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 4) AS raw FROM part),
f AS (SELECT raw, arg_min(p_name, struct_pack(d := damerau_levenshtein(raw, p_name), i := id)) AS name, min(damerau_levenshtein(raw, p_name)) AS d FROM t JOIN n ON damerau_levenshtein(raw, p_name) <= 2 GROUP BY 1)
SELECT t.raw, name AS canonical_name, CASE WHEN d = 0 THEN 'exact' WHEN d > 0 THEN 'fuzzy' END AS match_type, CASE d WHEN 0 THEN 0.95 WHEN 1 THEN 0.7 WHEN 2 THEN 0.55 END::DOUBLE AS confidence FROM t LEFT JOIN f ON f.raw = t.raw""")
def fuzzy_match_osa(spark, sf):
    name = F.col("p_name")
    typo = F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1), F.substring(name, 2, 1), F.substring(name, 4, 100))
    names = table(spark, sf, "part").select(typo.alias("raw")).distinct()
    return resolve.resolve(names, _gazetteer(spark, sf)).select("raw", "place.canonical_name", "place.match_type", "place.confidence")


@query("fuzzy_match_levenshtein", "WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT DISTINCT substr(p_name, 1, 1) || substr(p_name, 3) AS raw FROM part) SELECT raw, p_name AS canonical, levenshtein(raw, p_name) AS d FROM t JOIN n ON abs(length(raw) - length(p_name)) <= 3 AND levenshtein(raw, p_name) <= 2")
def fuzzy_match_levenshtein(spark, sf):
    p = table(spark, sf, "part").select("p_name").distinct()
    t = p.select(F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 100)).alias("raw")).distinct()
    near = resolve.near_spellings(t.withColumn("norm", F.col("raw")), p.select(F.col("p_name").alias("canonical"), F.col("p_name").alias("alias")))
    return near.withColumn("d", F.levenshtein("raw", "canonical", 2)).where("d >= 0").select("raw", "canonical", F.col("d").cast("bigint").alias("d"))


ALIASES = {"lead": ("the and", "le la"), "insult": ("worthless", "pathetic", "idiot"), "short": ("on", "de"), "junk": ("$$$", "%%%")}


def _alias_sql() -> str:
    flat, order = [], 0
    for k, names in ALIASES.items():
        for a in names:
            flat.append((len(a), -order, k, a))
            order += 1
    cond = lambda a: f"regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}]){a}(?:$|[^\\p{{L}}\\p{{N}}])')" if len(a) <= 3 and a.isalpha() else (f"regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}])' || regexp_escape('{a}') || '(?:$|[^\\p{{L}}\\p{{N}}])')" if len(a) <= 3 else f"contains(t, '{a}')")
    return "SELECT doc_id, CASE " + " ".join(f"WHEN {cond(a)} THEN '{k}'" for _, _, k, a in sorted(flat, key=lambda x: (-x[0], -x[1]))) + " END AS found FROM (SELECT doc_id, lower(text) AS t FROM documents)"


@query("longest_alias_match", _alias_sql())
def longest_alias_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", parse.longest_alias(F.col("text"), ALIASES).alias("found"))


INTENTS = (("ends", "(?:and|und)\\s+(?:the|der)"), ("mail", "[a-z0-9.]+@[a-z0-9.]+"), ("call", "\\+1 \\([0-9]{3}\\)"))


@query("intent_hits", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN '{k}' END" for k, p in INTENTS) + ") AS intents FROM documents")
def intent_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(parse.intents(F.col("text"), INTENTS), ",").alias("intents"))


@query("split_places_centroid", "WITH s AS (SELECT p_partkey, unnest(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)])) AS part FROM part), c AS (SELECT part, avg(length(part) + ascii(part))::DOUBLE AS x FROM s GROUP BY 1) SELECT p_partkey, round(avg(x), 6) AS x, count(*) AS n FROM s JOIN c USING (part) GROUP BY 1")
def split_places_centroid(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.explode(text.split_places(F.concat_ws("/", F.split("p_name", " ")[0], F.split("p_name", " ")[1]))).alias("part"))
    return p.withColumn("x", F.length("part") + F.ascii("part")).groupBy("p_partkey").agg(F.round(F.avg("x"), 6).alias("x"), F.count("*").alias("n"))


def _segments(spark, sf):
    """Successive events of a user: a user's own history, ordered."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    return events(spark, sf).withColumns({"lat0": F.lag("lat").over(w), "lng0": F.lag("lng").over(w)}).where("lat0 IS NOT NULL")


_SEG = "seg AS (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id) QUALIFY lat0 IS NOT NULL)"


@query("haversine_pairs", f"WITH {EV}, {_SEG} SELECT event_id, round({hav('lat0', 'lng0', 'lat', 'lng')}, 6) AS km FROM seg")
def haversine_pairs(spark, sf):
    return _segments(spark, sf).select("event_id", F.round(geo.haversine_km(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng")), 6).alias("km"))


@query("bearing_segments", f"WITH {EV}, {_SEG} SELECT event_id, round({brg('lat0', 'lng0', 'lat', 'lng')}, 5) AS deg FROM seg")
def bearing_segments(spark, sf):
    return _segments(spark, sf).select("event_id", F.round(geo.bearing(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng")), 5).alias("deg"))


def _dest(lat, lng, b, km):
    s, a, t = f"(({km}) / 6371.0)", f"radians({lat})", f"radians({b})"
    end = f"asin(sin({a}) * cos({s}) + cos({a}) * sin({s}) * cos({t}))"
    return f"degrees({end})", f"(degrees(radians({lng}) + atan2(sin({t}) * sin({s}) * cos({a}), cos({s}) - sin({a}) * sin({end}))) + 540.0) % 360.0 - 180.0"


_D = _dest("lat", "lng", "(k * 3.6)::DOUBLE", "(value)::DOUBLE")


@query("destination_points", f"WITH {EV} SELECT event_id, round({_D[0]}, 6) AS to_lat, round({_D[1]}, 6) AS to_lng FROM ev")
def destination_points(spark, sf):
    d = geo.destination(F.col("lat"), F.col("lng"), F.col("k") * F.lit(3.6), F.col("value"))
    return events(spark, sf).select("event_id", d.alias("d")).select("event_id", F.round("d.lat", 6).alias("to_lat"), F.round("d.lng", 6).alias("to_lng"))


@query("point_in_district", f"WITH {EV}, {BOXES} SELECT event_id, min_by(id, ordinal) AS district_id FROM ev LEFT JOIN boxes ON lat > a AND lat < c AND lng > b AND lng < d GROUP BY 1")
def point_in_district(spark, sf):
    e = events(spark, sf).select(F.col("event_id").alias("key"), (F.col("lat") + 0.0003).alias("lat"), (F.col("lng") + 0.0003).alias("lng"))
    return risk.district_of(e, districts(spark)).select(F.col("key").alias("event_id"), "district_id")


ORACLE_SQL["point_in_district"] = ORACLE_SQL["point_in_district"].replace("FROM ev LEFT", "FROM (SELECT event_id, lat + 0.0003 AS lat, lng + 0.0003 AS lng FROM ev) LEFT")


_X, _Y = "(greatest(b - lng, 0, lng - d) * cos(radians(lat)) * 111.32)", "(greatest(a - lat, 0, lat - c) * 111.32)"
_IN = "least((lng - b) * cos(radians(lat)), (d - lng) * cos(radians(lat)), lat - a, c - lat) * 111.32"
_RING = f"CASE WHEN lat > a AND lat < c AND lng > b AND lng < d THEN {_IN} ELSE sqrt({_X} * {_X} + {_Y} * {_Y}) END"


@query("ring_distance", f"WITH {EV}, {BOXES} SELECT event_id, round(min({_RING}), 5) AS km FROM (SELECT event_id, lat + 0.0003 AS lat, lng + 0.0003 AS lng FROM ev), boxes GROUP BY 1")
def ring_distance(spark, sf):
    e = events(spark, sf).select("event_id", (F.col("lat") + 0.0003).alias("lat"), (F.col("lng") + 0.0003).alias("lng"))
    far = F.array_min(F.array(*(geo.ring_distance_km(F.col("lat"), F.col("lng"), F.array(*(F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for y, x in ((a, b), (a, b + SIDE), (a + SIDE, b + SIDE), (a + SIDE, b))))) for _, _, a, b in RINGS)))
    return e.select("event_id", F.round(far, 5).alias("km"))


_STEPS = " OR ".join(f"(lat0 + {k / 8} * (lat - lat0) + 0.0003 > 49.7 AND lat0 + {k / 8} * (lat - lat0) + 0.0003 < 50.35 AND lng0 + {k / 8} * (lng - lng0) + 0.0003 > 36.7 AND lng0 + {k / 8} * (lng - lng0) + 0.0003 < 37.35)" for k in range(1, 8))


@query("segment_cross", f"WITH {EV}, {_SEG} SELECT event_id, ({_STEPS}) AS enters FROM seg")
def segment_cross(spark, sf):
    ring = F.array(*(F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for y, x in ((49.7, 36.7), (49.7, 37.35), (50.35, 37.35), (50.35, 36.7))))
    up = lambda c: F.col(c) + 0.0003
    return _segments(spark, sf).select("event_id", geo.segment_enters(up("lat0"), up("lng0"), up("lat"), up("lng"), ring).alias("enters"))


@query("district_threat_max", f"WITH {EV}, {BOXES}, p AS (SELECT CAST(floor(sec / 3600) AS BIGINT) AS hour, lat + 0.0003 AS lat, lng + 0.0003 AS lng FROM ev WHERE event_type = 'error'), m AS (SELECT hour, id, max(CASE WHEN lat > a AND lat < c AND lng > b AND lng < d THEN 2 WHEN {_RING} <= 5 THEN 1 ELSE 0 END) AS rank FROM boxes, p GROUP BY 1, 2) SELECT hour, id, rank FROM m")
def district_threat_max(spark, sf):
    """Every error event as a still incident, hour by hour."""
    e = events(spark, sf).where("event_type = 'error'").select(F.floor(F.col("sec") / 3600).alias("hour"), (F.col("lat") + 0.0003).alias("lat"), (F.col("lng") + 0.0003).alias("lng"), F.lit("active").alias("status"))
    nothing = {c: F.lit(None).cast("double") for c in ("bearing_deg", "speed_kmh", "eta_seconds", "heading_lat", "heading_lng")}
    return risk.threats(e.withColumns(nothing), districts(spark), by=("hour",))


_MOVING = f"""mv AS (SELECT user_id, lat + 0.0003 AS lat, lng + 0.0003 AS lng, (k * 3.6)::DOUBLE AS dir, CASE WHEN value > 0 THEN value * 5 END AS v FROM ev WHERE event_type = 'error'),
  to2 AS (SELECT *, {_dest("lat", "lng", "dir", "v * 2.0 / 60")[0]} AS lat2, {_dest("lat", "lng", "dir", "v * 2.0 / 60")[1]} AS lng2, {_dest("lat", "lng", "dir", "v * 3.0 / 60")[0]} AS lat3, {_dest("lat", "lng", "dir", "v * 3.0 / 60")[1]} AS lng3,
    43200 / v AS eta, {_dest("lat", "lng", "dir + 40", "12.0")[0]} AS hlat, {_dest("lat", "lng", "dir + 40", "12.0")[1]} AS hlng FROM mv)"""
_BOUND = " OR ".join(f"(lat + {t / 8} * (hlat - lat) > a AND lat + {t / 8} * (hlat - lat) < c AND lng + {t / 8} * (hlng - lng) > b AND lng + {t / 8} * (hlng - lng) < d)" for t in range(1, 9))


@query("district_threat_users", f"WITH {EV}, {BOXES}, {_MOVING} SELECT user_id, id, max(CASE WHEN lat > a AND lat < c AND lng > b AND lng < d THEN 2 WHEN lat2 > a AND lat2 < c AND lng2 > b AND lng2 < d THEN 2 WHEN {_RING} <= 5 THEN 1 WHEN lat3 > a AND lat3 < c AND lng3 > b AND lng3 < d THEN 1 WHEN eta <= 180 AND ({_BOUND}) THEN 1 ELSE 0 END) AS rank FROM to2, boxes GROUP BY 1, 2")
def district_threat_users(spark, sf):
    """Every error event as an impact that moves: by its k and value, towards a place 12 km ahead and 40 degrees aside."""
    e = events(spark, sf).where("event_type = 'error'").select("user_id", (F.col("lat") + 0.0003).alias("lat"), (F.col("lng") + 0.0003).alias("lng"), F.lit("impact").alias("status"), (F.col("k") * F.lit(3.6)).alias("bearing_deg"), F.when(F.col("value") > 0, F.col("value") * 5).alias("speed_kmh"))
    heading = geo.destination(F.col("lat"), F.col("lng"), F.col("bearing_deg") + 40, F.lit(12.0))
    moving = e.withColumns({"eta_seconds": F.lit(43200.0) / F.col("speed_kmh"), "heading_lat": heading["lat"], "heading_lng": heading["lng"]})
    return risk.threats(moving, districts(spark), by=("user_id",))


_PAIR = f"""pr AS (SELECT a.event_id, b.event_id AS incident_id, b.sec AS last_updated_at, a.sec - b.sec AS age, a.event_type = b.event_type AS same_channel, a.k % 4 = b.k % 4 AS same_weapon, {hav('b.lat', 'b.lng', 'a.lat', 'a.lng')} AS km, a.user_id = b.user_id AS same_count
  FROM ev a JOIN ev b ON a.user_id % 10 = b.user_id % 10 AND b.sec BETWEEN a.sec - 1200 AND a.sec - 1),
sc AS (SELECT *, round(CASE WHEN age < 180 THEN 0.35 WHEN age < 420 THEN 0.25 ELSE 0.1 END + CASE WHEN same_channel THEN 0.2 ELSE 0 END + CASE WHEN same_weapon THEN 0.35 ELSE 0 END + CASE WHEN km < 5 THEN 0.3 WHEN km < 15 THEN 0.15 WHEN km > 30 THEN -0.2 ELSE 0 END + CASE WHEN same_count THEN 0.05 ELSE 0 END, 6)::DOUBLE AS score FROM pr)"""


@query("score_candidates_best_second", f"WITH {EV}, {_PAIR} SELECT event_id, incident_id, score, rank, second FROM (SELECT event_id, incident_id, score, row_number() OVER w AS rank, greatest(coalesce(lead(score) OVER w, 0), 0)::DOUBLE AS second FROM sc WINDOW w AS (PARTITION BY event_id ORDER BY score DESC, last_updated_at DESC, incident_id)) WHERE rank <= 5")
def score_candidates_best_second(spark, sf):
    e = events(spark, sf).withColumn("scope", F.col("user_id") % 10)
    slot = F.floor(F.col("sec") / 1200)
    a = e.select("scope", "event_id", F.col("sec").alias("s"), "event_type", "k", F.col("lat").alias("la"), F.col("lng").alias("lo"), "user_id", F.explode(F.array(slot, slot - 1)).alias("slot"))
    b = e.select("scope", F.col("event_id").alias("incident_id"), F.col("sec").alias("last_updated_at"), F.col("event_type").alias("t"), F.col("k").alias("k2"), "lat", "lng", F.col("user_id").alias("u"), slot.alias("slot"))
    age = F.col("s") - F.col("last_updated_at")
    pairs = a.join(b, ["scope", "slot"]).where(age.between(1, 1200)).select("event_id", "incident_id", "last_updated_at", age.alias("age"), (F.col("event_type") == F.col("t")).alias("same_channel"), (F.col("k") % 4 == F.col("k2") % 4).alias("same_weapon"), geo.haversine_km(F.col("lat"), F.col("lng"), F.col("la"), F.col("lo")).alias("km"), (F.col("user_id") == F.col("u")).alias("same_count"))
    return correlate.score_candidates(pairs).where("rank <= 5").select("event_id", "incident_id", "score", F.col("rank").cast("bigint").alias("rank"), "second")


@query("sessionize_inactivity", f"WITH {EV}, s AS (SELECT *, CASE WHEN coalesce(sec - lag(sec) OVER w, 1801) > 1800 THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)), t AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s) SELECT user_id, session::BIGINT AS session, min(sec) AS first_seen_at, max(sec) AS last_updated_at, count(*) AS n FROM t GROUP BY 1, 2")
def sessionize_inactivity(spark, sf):
    return serve.sessions(events(spark, sf), 1800, ["user_id"])


@query("confidence_fold", f"WITH {EV} SELECT user_id, round(list_reduce(list((value / 100)::DOUBLE ORDER BY sec, event_id), lambda s, x: (s + x) / 2), 6) AS confidence FROM ev GROUP BY 1")
def confidence_fold(spark, sf):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sec", "event_id", "value"))), lambda s: s["value"] / 100)
    return events(spark, sf).groupBy("user_id").agg(ordered.alias("v")).select("user_id", F.round(correlate.confidence_fold(F.col("v")), 6).alias("confidence"))


@query("count_fold", f"WITH {EV} SELECT user_id, list_reduce(list_concat([0::BIGINT], list(k * 1000 + (k % 3) ORDER BY sec, event_id)), lambda s, x: greatest(s, s + (x % 1000), x // 1000)) AS n FROM ev GROUP BY 1")
def count_fold(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("sec", "event_id", "k")))
    per = events(spark, sf).groupBy("user_id").agg(rows.alias("r"))
    return per.select("user_id", correlate.count_fold(F.transform("r", lambda s: s["k"]), F.transform("r", lambda s: s["k"] % 3)).alias("n"))


@query("channel_set", f"WITH {EV}, f AS (SELECT user_id, event_type, min(struct_pack(s := sec, i := event_id)) AS m FROM ev GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY m) AS channels FROM f GROUP BY 1")
def channel_set(spark, sf):
    first = events(spark, sf).groupBy("user_id", "event_type").agg(F.min(F.struct("sec", "event_id")).alias("m"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "event_type"))), lambda s: s["event_type"]), ",").alias("channels"))


def correlator_events(spark, sf):
    """Events in the correlator's form, in one scope per user group of ten."""
    place = F.struct("lat", "lng", F.concat(F.lit("p"), F.col("k").cast("string")).alias("name"))
    none = F.lit(None).cast("struct<lat: double, lng: double, name: string>")
    w = F.element_at(F.array(*map(F.lit, TRACKED)), (F.col("k") % len(TRACKED) + 1).cast("int"))
    return events(spark, sf).select(
        (F.col("user_id") % 10).cast("string").alias("scope"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), F.col("event_id").alias("message_id"),
        F.when(F.col("event_id") % 11 == 0, F.col("event_id") - 1 - F.col("event_id") % 7).alias("reply_to"), F.col("event_type").alias("channel"), F.col("sec").alias("timestamp"),
        F.when(F.col("event_type") == "error", "impact").otherwise("tracking").alias("event_type"), w.alias("weapon_type"), (F.col("k") % 3 + 1).cast("int").alias("weapon_count"), F.least(F.col("value") / 100, F.lit(0.95)).alias("confidence"),
        F.when(F.col("k") % 5 < 4, place).otherwise(none).alias("location"), none.alias("via"), F.when(F.col("k") % 5 == 4, place).otherwise(none).alias("heading"),
        (F.col("k") % 13 == 0).alias("is_correction"), (F.col("k") % 4 == 0).alias("is_followup"), F.when(F.col("k") % 17 == 0, 1).otherwise(0).alias("count_delta"),
        F.when(F.col("k") % 6 == 0, F.array(F.lit("continuation"))).otherwise(F.array().cast("array<string>")).alias("phrase_intents"), F.lit(None).cast("string").alias("continues_incident_id"), F.lit(0.0).alias("continuation_confidence"),
    )


def _flat(decisions: DataFrame) -> DataFrame:
    i = F.col("incident")
    return decisions.select("scope", "seq", "event_id", "action", "reason", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"), i["id"].alias("incident_id"), i["status"].alias("status"), i["weapon_count"].alias("weapon_count"), F.round(i["confidence"], 6).alias("confidence"), F.size(i["trajectory"]).alias("points"))


@query("correlate_fold")
def correlate_fold(spark, sf):
    return _flat(correlate.correlate(correlator_events(spark, sf)))


@query("incident_snapshot")
def incident_snapshot(spark, sf):
    return correlate.snapshot(correlate.correlate(correlator_events(spark, sf))).select("scope", "id", "weapon_type", "weapon_count", "status", "first_seen_at", "last_updated_at", F.array_join("source_channels", ",").alias("channels"), F.round("confidence", 6).alias("confidence"))


# Four events of each scope, one for each row of events, whose decisions follow from its number by the rules' weights: one opens an incident, one
# may go on with it, one replies to it or is linked to it, and one comes when all has been silent for too long.
_RULED = """x AS (SELECT event_id AS e, CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 300 WHEN 2 THEN 800 ELSE 1300 END AS age, event_id // 4 % 2 = 0 AS same, CASE event_id // 8 % 4 WHEN 0 THEN 'shahed' WHEN 1 THEN 'bpla' WHEN 2 THEN 'unknown' ELSE 'kab' END AS w,
    CASE event_id // 32 % 4 WHEN 0 THEN 2 WHEN 1 THEN 11 WHEN 2 THEN 22 ELSE 55 END AS km, event_id // 128 % 2 = 1 AS headed, event_id // 256 % 2 = 1 AS follows, event_id // 512 % 4 AS i, event_id // 2048 % 2 = 1 AS corrects, event_id // 4096 % 2 = 1 AS more, event_id // 3 % 2 + 1 AS n FROM events),
  s AS (SELECT *, (CASE WHEN age < 180 THEN 0.35 WHEN age < 420 THEN 0.25 ELSE 0.1 END)::DOUBLE + if(same, 0.2, 0)::DOUBLE + if(w = 'shahed', 0.35, 0)::DOUBLE + if(w = 'bpla', 0.15, 0)::DOUBLE + if(w = 'unknown', 0.1, 0)::DOUBLE + if(km < 5, 0.3, 0)::DOUBLE + if(km >= 5 AND km < 15, 0.15, 0)::DOUBLE
      + if(km > 30, -0.2, 0)::DOUBLE + if(follows, 0.2, 0)::DOUBLE + if(i = 1 OR follows, 0.15, 0)::DOUBLE + if(more AND same AND age < 720, 0.18, 0)::DOUBLE + if(i = 2 AND headed AND age < 720, 0.1, 0)::DOUBLE + if(i = 3 OR corrects, 0.08, 0)::DOUBLE + if(w = 'unknown' AND same AND age < 420, 0.25, 0)::DOUBLE
      + if(same AND age <= 180, 0.2, 0)::DOUBLE + if(more AND same AND age < 600, 0.35, 0)::DOUBLE + if(n = 1, 0.05, 0)::DOUBLE + if(corrects, 0.1, 0)::DOUBLE AS score FROM x),
  b AS (SELECT *, CASE WHEN age > 1200 THEN 0 ELSE greatest(score, 0) END AS best, more AND NOT headed AS split, age <= 1200 AND NOT (more AND NOT headed) AND score >= if(more, 0.3, 0.5)::DOUBLE AS joins FROM s)"""


@query("correlate_templates", f"""WITH {_RULED} SELECT e AS scope, 'a' AS event, 'new' AS action, 'new_incident' AS reason, 0::DOUBLE AS best, 'a' AS incident FROM b
UNION ALL SELECT e, 'b', if(joins, 'update', 'new'), CASE WHEN joins THEN 'implicit_score' WHEN split THEN 'count_delta_explicit_location_new_incident' ELSE 'new_incident' END, round(best, 6), if(joins, 'a', 'b') FROM b
UNION ALL SELECT e, 'c', 'update', if(e % 2 = 0, 'reply_link', 'llm_link'), if(e % 2 = 0, 1.2, 1)::DOUBLE, 'a' FROM b
UNION ALL SELECT e, NULL, 'expire', 'stale', NULL, t.o FROM b, (VALUES ('a'), ('b')) t(o) WHERE t.o = 'a' OR NOT joins
UNION ALL SELECT e, 'd', 'new', 'new_incident', 0, 'd' FROM b""")
def correlate_templates(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("e"))
    n = lambda size, of: F.floor(F.col("e") / size) % of
    age = F.element_at(F.array(*map(F.lit, (60, 300, 800, 1300))), (n(1, 4) + 1).cast("int"))
    weapons = F.element_at(F.array(*map(F.lit, ("shahed", "bpla", "unknown", "kab"))), (n(8, 4) + 1).cast("int"))
    north = F.element_at(F.array(*map(F.lit, (0.02, 0.1, 0.2, 0.5))), (n(32, 4) + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, ("", "continuation", "heading_change", "correction"))), (n(512, 4) + 1).cast("int"))
    none, nowhere = F.lit(None), F.lit(None).cast("struct<lat: double, lng: double, name: string>")
    at = lambda lat: F.struct(lat.alias("lat"), F.lit(36.0).alias("lng"), F.lit("p").alias("name"))
    start = F.lit(1_700_000_000).cast("bigint")
    name = lambda x: F.concat(F.col("e").cast("string"), F.lit(f"-{x}"))
    incident = lambda x: F.substring(F.sha2(F.concat(F.lit("incident:"), name(x)), 256), 1, 32)

    def one(x, number, time, channel=F.lit("x"), weapon=F.lit("shahed"), location=nowhere, heading=nowhere, count=F.lit(1), corrects=F.lit(False), follows=F.lit(False), more=F.lit(0), intents=F.lit(""), reply=none, link=none):
        return F.struct(
            name(x).alias("event_id"), F.lit(number).cast("bigint").alias("message_id"), reply.cast("bigint").alias("reply_to"), channel.alias("channel"), time.cast("bigint").alias("timestamp"), F.lit("tracking").alias("event_type"), weapon.alias("weapon_type"), count.cast("int").alias("weapon_count"),
            F.lit(0.8).alias("confidence"), location.alias("location"), nowhere.alias("via"), heading.alias("heading"), corrects.alias("is_correction"), follows.alias("is_followup"), more.cast("int").alias("count_delta"), F.filter(F.array(intents), lambda i: i != "").alias("phrase_intents"), link.cast("string").alias("continues_incident_id"), F.lit(0.9).alias("continuation_confidence"),
        )

    headed, even = n(128, 2) == 1, F.col("e") % 2 == 0
    there = at(F.lit(50.0) + north)
    four = F.array(
        one("a", 1, start, location=at(F.lit(50.0))),
        one("b", 2, start + age, F.when(n(4, 2) == 0, "x").otherwise("y"), weapons, F.when(~headed, there), F.when(headed, there), n(3, 2) + 1, n(2048, 2) == 1, n(256, 2) == 1, n(4096, 2), said),
        one("c", 3, start + age + 100, location=at(F.lit(50.0)), reply=F.when(even, 1), link=F.when(~even, incident("a"))),
        one("d", 4, start + age + 9000, location=at(F.lit(50.0))),
    )
    decided = correlate.correlate(e.select(F.col("e").cast("string").alias("scope"), F.explode(four).alias("v")).select("scope", "v.*"))
    opened = decided.where("action = 'new'").select("scope", F.col("incident.id").alias("id"), F.substring_index("event_id", "-", -1).alias("incident"))
    out = decided.select("scope", F.col("incident.id").alias("id"), F.substring_index("event_id", "-", -1).alias("event"), "action", "reason", F.round("best", 6).alias("best"))
    return out.hint("merge").join(opened, ["scope", "id"]).select(F.col("scope").cast("bigint").alias("scope"), "event", "action", "reason", "best", "incident")


_TICKS = "t AS (SELECT event_type AS id, sec * 1000 AS at_ms, max(CASE WHEN value > 60 THEN 2 WHEN value > 40 THEN 1 ELSE 0 END) AS rank FROM ev GROUP BY 1, 2)"


@query("district_cooldown", f"WITH {EV}, {_TICKS}, l AS (SELECT *, CASE WHEN rank = 0 AND lag(rank) OVER w > 0 THEN at_ms END AS e FROM t WINDOW w AS (PARTITION BY id ORDER BY at_ms)), m AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY id ORDER BY at_ms ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT id, at_ms, rank, CASE WHEN rank = 2 THEN 'red' WHEN rank = 1 THEN 'orange' WHEN s IS NOT NULL AND at_ms - s < 300000 THEN 'green' END AS level FROM m")
def district_cooldown(spark, sf):
    e = events(spark, sf)
    ticks = e.groupBy(F.col("event_type").alias("id"), (F.col("sec") * 1000).alias("at_ms")).agg(F.max(F.when(F.col("value") > 60, 2).when(F.col("value") > 40, 1).otherwise(0)).alias("rank"))
    return risk.cooled(ticks)


_NAMES = {f"n{j}": f"d{j // 3}{j % 3}" for j in range(5)} | {f"p{j}": f"d2{j}" for j in range(2)}
_ALERTS = """al AS (SELECT event_id, event_type = 'error' AS is_impact, sec * 1000 AS at_ms, CASE WHEN k % 11 > 0 THEN k END AS kk, lat + 0.0003 AS lat, lng + 0.0003 AS lng FROM ev WHERE event_type IN ('error', 'purchase')),
  tg AS (SELECT event_id, is_impact, at_ms, CASE WHEN kk IS NULL THEN NULL WHEN kk % 30 < 5 THEN 'd' || ((kk % 30) // 3) || ((kk % 30) % 3) WHEN kk % 7 < 2 THEN 'd2' || (kk % 7) ELSE id END AS own FROM al LEFT JOIN boxes ON lat > a AND lat < c AND lng > b AND lng < d),
  mk AS (SELECT event_id, coalesce(own, id) AS id, at_ms, is_impact FROM tg LEFT JOIN boxes ON own IS NULL)"""
_RUNS = """g AS (SELECT id, at_ms, max(CASE WHEN is_impact THEN 2 ELSE 1 END) AS m FROM mk GROUP BY 1, 2), h AS (SELECT *, CASE WHEN coalesce(at_ms - lag(at_ms) OVER w, 600000) >= 600000 THEN 1 ELSE 0 END AS s FROM g WINDOW w AS (PARTITION BY id ORDER BY at_ms)),
  q AS (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY at_ms) AS run FROM h), u AS (SELECT id, run, min(at_ms) AS f, max(at_ms) + 600000 AS e, min(at_ms) FILTER (m = 2) AS red FROM q GROUP BY 1, 2),
  rn AS (SELECT id, 1 AS rank, f AS from_ms, coalesce(red, e) AS expires_at FROM u WHERE red IS NULL OR red > f UNION ALL SELECT id, 2, red, e FROM u WHERE red IS NOT NULL)"""


def _marks(spark, sf):
    """Errors and purchases as alerts, some without a place, some with a named one or parent, others by their point."""
    e = events(spark, sf).where("event_type IN ('error', 'purchase')")
    place = F.struct(F.concat(F.lit("n"), (F.col("k") % 30).cast("string")).alias("canonical_name"), F.concat(F.lit("p"), (F.col("k") % 7).cast("string")).alias("parent"), (F.col("lat") + 0.0003).alias("lat"), (F.col("lng") + 0.0003).alias("lng"))
    none = F.lit(None).cast("struct<canonical_name: string, parent: string, lat: double, lng: double>")
    kind = F.when(F.col("event_type") == "error", "impact").otherwise("tracking")
    alerts = e.select("event_id", kind.alias("event_type"), F.col("sec").alias("timestamp"), F.when(F.col("k") % 11 > 0, place).alias("location"), none.alias("via"), none.alias("heading"))
    return risk.alert_marks(alerts, districts(spark), _NAMES)


@query("alert_targets", f"WITH {EV}, {BOXES}, {_ALERTS} SELECT event_id, id, is_impact FROM mk")
def alert_targets(spark, sf):
    return _marks(spark, sf).select("event_id", "id", "is_impact")


@query("override_runs", f"WITH {EV}, {BOXES}, {_ALERTS}, {_RUNS} SELECT id, rank, from_ms, expires_at FROM rn")
def override_runs(spark, sf):
    return risk.override_runs(_marks(spark, sf))


@query("override_ttl_merge", f"WITH {EV}, {BOXES}, {_ALERTS}, {_RUNS}, o AS (SELECT id, max(from_ms) AS f FROM rn WHERE from_ms <= {NOW}000 GROUP BY 1) SELECT boxes.id, greatest(ordinal % 3, CASE WHEN expires_at > {NOW}000 THEN rank ELSE 0 END)::BIGINT AS rank FROM boxes LEFT JOIN o ON o.id = boxes.id LEFT JOIN rn ON rn.id = o.id AND rn.from_ms = o.f".replace("mk GROUP", f"mk WHERE at_ms <= {NOW}000 GROUP"))
def override_ttl_merge(spark, sf):
    raw = districts(spark).select("id", (F.col("ordinal") % 3).alias("rank"))
    marks = _marks(spark, sf).where(F.col("at_ms") <= NOW * 1000)
    return risk.with_overrides(raw, risk.merge_overrides(marks), NOW * 1000).select("id", F.col("rank").cast("bigint").alias("rank"))


_TICKS9 = "tk AS (SELECT 'd' || (user_id % 9) // 3 || (user_id % 9) % 3 AS id, sec * 1000 AS at_ms, max(CASE WHEN value > 60 THEN 2 WHEN value > 45 THEN 1 ELSE 0 END) AS rank FROM ev GROUP BY 1, 2)"
_LEVELS = """ov AS (SELECT tk.id, tk.at_ms, greatest(tk.rank, coalesce(max(rn.rank), 0)) AS rank FROM tk LEFT JOIN rn ON rn.id = tk.id AND rn.from_ms <= tk.at_ms AND rn.expires_at > tk.at_ms GROUP BY tk.id, tk.at_ms, tk.rank),
  l AS (SELECT *, CASE WHEN rank = 0 AND lag(rank) OVER w > 0 THEN at_ms END AS e FROM ov WINDOW w AS (PARTITION BY id ORDER BY at_ms)), m AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY id ORDER BY at_ms ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT id, at_ms, rank, CASE WHEN rank = 2 THEN 'red' WHEN rank = 1 THEN 'orange' WHEN s IS NOT NULL AND at_ms - s < 300000 THEN 'green' END AS level FROM m"""


def _district_ticks(spark, sf):
    d = F.col("user_id") % 9
    rank = F.when(F.col("value") > 60, 2).when(F.col("value") > 45, 1).otherwise(0)
    return events(spark, sf).groupBy(F.concat(F.lit("d"), F.floor(d / 3).cast("string"), (d % 3).cast("string")).alias("id"), (F.col("sec") * 1000).alias("at_ms")).agg(F.max(rank).alias("rank"))


@query("override_levels", f"WITH {EV}, {BOXES}, {_ALERTS}, {_RUNS}, {_TICKS9}, {_LEVELS}")
def override_levels(spark, sf):
    """Levels over all ticks, with the overrides that hold at each, and the cool-down after them."""
    return risk.cooled(risk.overridden(_district_ticks(spark, sf), risk.override_runs(_marks(spark, sf))))


@query("stream_levels", ORACLE_SQL["override_levels"])
def stream_levels(spark, sf):
    """The same with state per district, as a stream."""
    rows = _district_ticks(spark, sf).withColumn("kind", F.lit("tick")).unionByName(_marks(spark, sf).select("id", "at_ms", F.when(F.col("is_impact"), 2).otherwise(1).alias("rank"), F.lit("mark").alias("kind")))
    return _in_parts(rows, "at_ms", "stream-levels", jobs.district_levels)


_CHANGES = f"""v AS (SELECT event_id AS seq, event_type || '-' || (k % 3) AS iid, event_id % 3 = 0 AS gone, lat + 0.0003 AS lat, lng + 0.0003 AS lng, lead(event_id) OVER (PARTITION BY event_type, k % 3 ORDER BY event_id) AS nxt FROM ev),
  cb AS (SELECT id, seq, nxt, CASE WHEN lat > a AND lat < c AND lng > b AND lng < d THEN 2 WHEN {_RING} <= 5 THEN 1 ELSE 0 END AS r FROM v, boxes WHERE NOT gone),
  st AS (SELECT id, seq, sum(red) AS red, sum(orange) AS orange FROM (SELECT id, seq, (r = 2)::INT AS red, (r = 1)::INT AS orange FROM cb WHERE r > 0 UNION ALL SELECT id, nxt, -(r = 2)::INT, -(r = 1)::INT FROM cb WHERE r > 0 AND nxt IS NOT NULL) GROUP BY 1, 2),
  rk AS (SELECT id, seq, CASE WHEN sum(red) OVER w > 0 THEN 2 WHEN sum(orange) OVER w > 0 THEN 1 ELSE 0 END AS rank FROM st WINDOW w AS (PARTITION BY id ORDER BY seq))
SELECT id, seq, rank FROM rk QUALIFY rank <> coalesce(lag(rank) OVER (PARTITION BY id ORDER BY seq), 0)"""


@query("risk_from_changelog", f"WITH {EV}, {BOXES}, {_CHANGES}")
def risk_from_changelog(spark, sf):
    """Each district's rank as all changes of incidents come in."""
    e = events(spark, sf)
    payload = F.to_json(F.struct(F.lit("active").alias("status"), (F.col("lat") + 0.0003).alias("lat"), (F.col("lng") + 0.0003).alias("lng")))
    changes = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "expire").otherwise("update").alias("op"), F.concat_ws("-", "event_type", (F.col("k") % 3).cast("string")).alias("id"), payload.alias("payload"))
    return risk.risk_changes(changes, districts(spark))


@query("level_counts", f"WITH {EV}, l AS (SELECT user_id, max(value) AS v FROM ev GROUP BY 1) SELECT count(*) FILTER (v > 300) AS red, count(*) FILTER (v > 200 AND v <= 300) AS orange FROM l")
def level_counts(spark, sf):
    v = F.col("v")
    per = events(spark, sf).groupBy("user_id").agg(F.max("value").alias("v"))
    return risk.level_counts(per.select(F.col("user_id").alias("id"), F.when(v > 300, "red").when(v > 200, "orange").alias("level")))


@query("district_name_lookup", "SELECT p_partkey, CASE WHEN p_name = 'red bolt' THEN 'x' WHEN contains(p_name, 'red') THEN 'a' WHEN contains(p_name, 'bolt') THEN 'b' END AS id FROM part")
def district_name_lookup(spark, sf):
    return table(spark, sf, "part").select("p_partkey", risk.district_in_text(F.col("p_name"), {"a": "red", "b": "bolt"}, {"red bolt": "x"}).alias("id"))


@query("displayed_levels", f"WITH {EV}, l AS (SELECT event_type AS id, CASE WHEN max(value) > 1e9 THEN 'red' WHEN min(value) < 0.5 THEN 'orange' END AS level FROM ev GROUP BY 1) SELECT id, CASE WHEN NOT coalesce(bool_or(level IN ('red', 'orange')) OVER (), false) THEN 'green' ELSE coalesce(level, 'low') END AS shown FROM l")
def displayed_levels(spark, sf):
    e = events(spark, sf).groupBy(F.col("event_type").alias("id")).agg(F.when(F.max("value") > 1e9, "red").when(F.min("value") < 0.5, "orange").alias("level"))
    return risk.displayed(e, e.select("id", F.lit("low").alias("risk_level")))


@query("changelog_to_snapshot", f"WITH {EV}, c AS (SELECT event_id AS seq, event_type || '-' || k AS id, CASE WHEN event_id % 5 = 0 THEN 'expire' ELSE 'update' END AS op FROM ev), l AS (SELECT id, max(seq) AS seq, arg_max(op, seq) AS op FROM c GROUP BY 1) SELECT id, seq FROM l WHERE op <> 'expire'")
def changelog_to_snapshot(spark, sf):
    return readers.applied(_changes(spark, sf)).select("id", "seq")


def _changes(spark, sf):
    e = events(spark, sf)
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "expire").otherwise("update").alias("op"), F.concat_ws("-", "event_type", "k").alias("id"), F.to_json(F.struct("lat", "lng")).alias("payload"))


@query("set_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def set_difference(spark, sf):
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("canonical"))
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return lexicon.missing(expected, urgent.select(F.col("o_custkey").alias("canonical"))).select(F.col("canonical").alias("c_custkey"))


@query("allowlist_overlap", "SELECT o_custkey, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS allowed FROM orders GROUP BY 1")
def allowlist_overlap(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return per.select("o_custkey", F.arrays_overlap("p", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("allowed"))


def _lexicon(spark, sf):
    p = table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("canonical")).agg(F.collect_set("p_name").alias("aliases"), (F.min("p_size") / 10.0).alias("confidence"))


@query("alias_collisions", "WITH l AS (SELECT p_brand AS c, min(p_size) OVER (PARTITION BY p_brand) / 10.0 AS s, p_name AS a FROM part) SELECT a AS alias, count(DISTINCT c) AS owners, CASE WHEN max(s) < 0.9 THEN 'warning' ELSE 'error' END AS severity FROM l GROUP BY 1 HAVING count(DISTINCT c) > 1")
def alias_collisions(spark, sf):
    return lexicon.collisions(_lexicon(spark, sf))


@query("confidence_gate", "SELECT p_brand AS canonical, min(p_size) / 10.0::DOUBLE AS confidence FROM part GROUP BY 1 HAVING min(p_size) / 10.0::DOUBLE < 0.7")
def confidence_gate(spark, sf):
    return lexicon.low_confidence(_lexicon(spark, sf)).select("canonical", F.col("confidence").cast("double").alias("confidence"))


@query("coverage_summary", "WITH r AS (SELECT p_name AS alias, min(p_brand) AS found FROM part WHERE p_size > 40 GROUP BY 1), e AS (SELECT DISTINCT p_brand AS canonical, p_name AS alias FROM part) SELECT canonical, count(*) FILTER (found = canonical) AS \"right\", count(*) FILTER (found <> canonical) AS wrong, count(*) FILTER (found IS NULL) AS unresolved FROM e LEFT JOIN r USING (alias) GROUP BY 1")
def coverage_summary(spark, sf):
    p = table(spark, sf, "part")
    found = p.where("p_size > 40").groupBy(F.col("p_name").alias("alias")).agg(F.min("p_brand").alias("found"))
    return lexicon.coverage(p.select(F.col("p_brand").alias("canonical"), F.col("p_name").alias("alias")).distinct(), found)


@query("json_roundtrip", f"WITH {EV} SELECT event_id, lat, lng, sec::DOUBLE AS timestamp FROM ev WHERE event_id % 4 <> 0")
def json_roundtrip(spark, sf):
    e = events(spark, sf)
    j = F.when(F.col("event_id") % 4 == 0, F.lit('{"lat": 1, "lng": ')).otherwise(F.to_json(F.struct("lat", "lng", F.col("sec").alias("timestamp"))))
    return e.select("event_id", serve.anchor(j).alias("a")).where("a IS NOT NULL").select("event_id", "a.lat", "a.lng", "a.timestamp")


@query("array_ops", "SELECT vec_id, round(embedding[-1]::DOUBLE, 5) AS last, round(embedding[-2]::DOUBLE, 5) AS previous, len(embedding) AS n, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def array_ops(spark, sf):
    e = F.col("embedding")
    at = lambda k: F.round(F.try_element_at(e, F.lit(k)).cast("double"), 5)
    return table(spark, sf, "embeddings").select("vec_id", at(-1).alias("last"), at(-2).alias("previous"), F.size(e).cast("bigint").alias("n"), F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("positive"))


@query("time_buckets_format", f"WITH {EV} SELECT event_id, lpad(((sec % 5400) // 60)::VARCHAR, 2, '0') || ':' || lpad((sec % 60)::VARCHAR, 2, '0') AS eta, CASE WHEN sec % 9000 < 60 THEN (sec % 9000) || ' s ago' WHEN sec % 9000 < 3600 THEN ((sec % 9000) // 60) || ' min ago' ELSE ((sec % 9000) // 3600) || ' h ago' END AS ago, CASE WHEN k % 10 = 1 AND k % 100 NOT BETWEEN 11 AND 14 THEN 'a' WHEN k % 10 BETWEEN 2 AND 4 AND k % 100 NOT BETWEEN 11 AND 14 THEN 'b' ELSE 'c' END AS form FROM ev")
def time_buckets_format(spark, sf):
    return events(spark, sf).select("event_id", text.eta(F.col("sec") % 5400).alias("eta"), text.ago(F.col("sec") % 9000).alias("ago"), text.plural(F.col("k"), "a", "b", "c").alias("form"))


@query("dead_reckoning", f"WITH {EV}, s AS (SELECT *, CASE k % 3 WHEN 0 THEN {SPEED_KMH['shahed']} WHEN 1 THEN {SPEED_KMH['bpla']} ELSE 0 END::DOUBLE AS v FROM ev), p AS (SELECT *, v * (k * 10) / 3600 AS km FROM s) SELECT event_id, round(CASE WHEN km <= 0 THEN lat ELSE {_dest('lat', 'lng', 'value::DOUBLE', 'km')[0]} END, 6) AS to_lat FROM p")
def dead_reckoning(spark, sf):
    v = F.when(F.col("k") % 3 == 0, float(SPEED_KMH["shahed"])).when(F.col("k") % 3 == 1, float(SPEED_KMH["bpla"])).otherwise(0.0)
    return events(spark, sf).select("event_id", F.round(geo.project(F.col("lat"), F.col("lng"), F.col("value"), v, F.col("k") * 10)["lat"], 6).alias("to_lat"))


@query("poll_high_water_mark", f"WITH {EV}, n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM ev WHERE event_id > 100) SELECT event_type, event_id FROM n WHERE r <= 20")
def poll_high_water_mark(spark, sf):
    rows = events(spark, sf).select(F.col("event_type").alias("channel_id"), F.col("event_id").alias("telegram_id"))
    marks = rows.select("channel_id").distinct().withColumn("last_id", F.lit(100))
    return readers.beyond(rows, marks, 20).select(F.col("channel_id").alias("event_type"), F.col("telegram_id").alias("event_id"))


def _in_parts(df: DataFrame, order: str, tag: str, job: Callable[[DataFrame], DataFrame], last: DataFrame | None = None, parts: int = 4) -> DataFrame:
    """A table as a file stream that comes in parts, in the order of a column, ``last`` after them.

    After each part the stream is run to its end, and for the next it goes on from its checkpoint; so state is read back.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, tag)
    low, high = df.agg(F.min(order), F.max(order)).first()  # one row
    number = F.floor((F.col(order) - low) * parts / (high - low + 1))
    for k, part in enumerate([*(df.where(number == k) for k in range(parts)), *([] if last is None else [last])]):
        part.write.parquet(f"{folder}/in/{k}")
        out = jobs.drained(job(spark.readStream.schema(df.schema).parquet(f"{folder}/in/*")), folder)
    return out


@query("stream_dedup", "SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY ALL")
def stream_dedup(spark, sf):
    """How often each key comes out of the stream: once, though its rows come in several parts."""
    e = table(spark, sf, "events").select("event_type", "user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("at", F.unix_seconds("ts"))
    out = _in_parts(e, "at", "stream-dedup", lambda s: jobs.deduplicated(s, ["event_type", "user_id"], "ts", "60 days"))
    return out.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("stream_correlate")
def stream_correlate(spark, sf):
    """Decisions over four parts, with state read back, and the ends of incidents that no event follows."""
    e = correlator_events(spark, sf)
    return _flat(_in_parts(e, "timestamp", "stream-correlate", timers.correlated, _clock(e)))


def _clock(e: DataFrame) -> DataFrame:
    """A message without any place, long after all events: only time passes."""
    end = e.agg(F.max("timestamp").alias("timestamp")).withColumn("timestamp", F.col("timestamp") + 86400)
    given = {"scope": F.lit("clock"), "event_id": F.lit("clock"), "channel": F.lit("clock"), "timestamp": F.col("timestamp"), "event_type": F.lit("tracking"), "weapon_type": F.lit("unknown"), "weapon_count": F.lit(1), "confidence": F.lit(0.0), "is_correction": F.lit(False), "is_followup": F.lit(False), "count_delta": F.lit(0)}
    return end.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in e.schema.fields))


_STALE = f"SELECT 'expiry' AS what, event_type || '-' || k AS id, (sec + 1801) * 1000 AS at_ms, NULL::INT AS rank, NULL::VARCHAR AS level FROM (SELECT *, lead(sec) OVER (PARTITION BY event_type, k ORDER BY sec) AS nxt FROM ev) WHERE nxt IS NULL OR nxt - sec > 1800"
_BY_CLOCK = """pt AS (SELECT id, at_ms FROM tk UNION SELECT id, from_ms FROM rn UNION SELECT id, expires_at FROM rn),
  pr AS (SELECT pt.id, pt.at_ms, last_value(tk.rank IGNORE NULLS) OVER (PARTITION BY pt.id ORDER BY pt.at_ms ROWS UNBOUNDED PRECEDING) AS raw FROM pt LEFT JOIN tk ON tk.id = pt.id AND tk.at_ms = pt.at_ms),
  po AS (SELECT pr.id, pr.at_ms, greatest(coalesce(raw, 0), coalesce(max(rn.rank), 0)) AS rank FROM pr LEFT JOIN rn ON rn.id = pr.id AND rn.from_ms <= pr.at_ms AND rn.expires_at > pr.at_ms GROUP BY pr.id, pr.at_ms, raw),
  pe AS (SELECT *, CASE WHEN rank = 0 AND lag(rank) OVER w > 0 THEN at_ms END AS e, min(CASE WHEN rank > 0 THEN at_ms END) OVER (PARTITION BY id ORDER BY at_ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS again FROM po WINDOW w AS (PARTITION BY id ORDER BY at_ms)),
  pl AS (SELECT id, at_ms, rank, last_value(e IGNORE NULLS) OVER (PARTITION BY id ORDER BY at_ms ROWS UNBOUNDED PRECEDING) AS s FROM pe),
  pa AS (SELECT id, at_ms, rank, CASE WHEN rank = 2 THEN 'red' WHEN rank = 1 THEN 'orange' WHEN s IS NOT NULL AND at_ms - s < 300000 THEN 'green' END AS level FROM pl
    UNION SELECT id, e + 300000, 0, NULL FROM pe WHERE e IS NOT NULL AND (again IS NULL OR again > e + 300000)),
  pc AS (SELECT *, lag(rank, 1, 0) OVER w AS r, lag(level) OVER w AS l FROM pa WINDOW w AS (PARTITION BY id ORDER BY at_ms))
SELECT 'level' AS what, id, at_ms, rank::INT AS rank, level FROM pc WHERE rank <> r OR level IS DISTINCT FROM l"""


@query("stream_expiry", f"WITH {EV}, {BOXES}, {_ALERTS}, {_RUNS}, {_TICKS9}, {_BY_CLOCK} UNION ALL {_STALE}")
def stream_expiry(spark, sf):
    """Every end of an incident's news, and every change of a district's level, at its time, by timers where no row comes."""
    updates = events(spark, sf).select(F.concat_ws("-", "event_type", "k").alias("id"), F.col("sec").alias("at"))
    end = updates.agg((F.max("at") + 86400).alias("at"))
    gone = _in_parts(updates, "at", "stream-expiry", timers.expiries, end.select(F.lit("clock").alias("id"), "at"))
    rows = _district_ticks(spark, sf).withColumn("kind", F.lit("tick")).unionByName(_marks(spark, sf).select("id", "at_ms", F.when(F.col("is_impact"), 2).otherwise(1).alias("rank"), F.lit("mark").alias("kind")))
    clock = end.select(F.lit("clock").alias("id"), (F.col("at") * 1000).alias("at_ms"), F.lit(0).alias("rank"), F.lit("tick").alias("kind"))
    changed = _in_parts(rows, "at_ms", "stream-changes", timers.level_changes, clock)
    return changed.select(F.lit("level").alias("what"), "id", "at_ms", "rank", "level").unionByName(gone.select(F.lit("expiry").alias("what"), "id", "at_ms", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("level")))


# A part is a relation of one ring, or of a ring and a hole: of n ways each between two corners, with a node between; every other way runs backwards, and members are out of order.
_WAYS = """r AS (SELECT p_partkey AS rel, h AS hole, (3 + p_partkey % 9 + h)::BIGINT AS n FROM part, (VALUES (0), (1)) t(h) WHERE h = 0 OR p_partkey % 2 = 0),
  c AS (SELECT rel, hole, n, unnest(generate_series(0, 2 * n)) AS j FROM r), g AS (SELECT rel, hole, n, j, rel + 0.5 * (j % (2 * n)) + 100 * hole AS lng, (j % (2 * n)) * (j % 7 + 1) * 0.25 AS lat FROM c WHERE j < 2 * n)"""


def _ways(spark, sf):
    """Members, ways and nodes derived from parts."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("rel"))
    r = p.withColumn("hole", F.explode(F.when(F.col("rel") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("n", (3 + F.col("rel") % 9 + F.col("hole")).cast("bigint"))
    way = r.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    name = lambda x: (F.col("rel") * 1000 + F.col("hole") * 100 + x).cast("bigint")
    pos = F.col("hole") * 50 + F.when(F.col("i") == 0, F.lit(0)).otherwise(F.col("n") - F.col("i"))
    members = way.select(F.col("rel").alias("relation"), pos.alias("pos"), name(F.col("i")).alias("way"))
    back = (F.col("i") > 0) & ((F.col("i") + F.col("rel")) % 2 == 1)
    steps = way.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("j", (2 * F.col("i") + F.col("s")) % (2 * F.col("n")))
    ways = steps.select(name(F.col("i")).alias("way"), F.when(back, 2 - F.col("s")).otherwise(F.col("s")).alias("pos"), name(F.col("j")).alias("node"))
    j = F.col("j")
    node = r.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), 2 * F.col("n") - 1)))
    return members, ways, node.select(name(j).alias("node"), (F.col("rel") + 0.5 * j + 100 * F.col("hole")).cast("double").alias("lng"), (j * (j % 7 + 1) * 0.25).cast("double").alias("lat"))


@query("ways_rings", f"WITH {_WAYS} SELECT c.rel AS relation, (50 * c.hole)::BIGINT AS ring, c.n AS ways, string_agg(CAST(CAST(g.lng * 4 AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(g.lat * 4 AS BIGINT) AS VARCHAR), ',' ORDER BY c.j) AS points FROM c JOIN g ON g.rel = c.rel AND g.hole = c.hole AND g.j = c.j % (2 * c.n) GROUP BY 1, 2, 3")
def ways_rings(spark, sf):
    """Rings, and holes, out of ways that run in either direction."""
    four = lambda x: (x * 4).cast("bigint").cast("string")
    said = F.array_join(F.transform("points", lambda p: F.concat(four(p["lng"]), F.lit(" "), four(p["lat"]))), ",")
    return readers.ways_to_rings(*_ways(spark, sf)).select("relation", "ring", F.col("ways").cast("bigint").alias("ways"), said.alias("points"))


@query("ring_centroids", f"WITH {_WAYS} SELECT rel AS relation, (50 * hole)::BIGINT AS ring, round(avg(lng), 6)::DOUBLE AS lng, round(avg(lat), 6)::DOUBLE AS lat FROM g GROUP BY 1, 2")
def ring_centroids(spark, sf):
    c = geo.centroid(F.col("points"))
    return readers.ways_to_rings(*_ways(spark, sf)).select("relation", "ring", F.round(c["lng"], 6).alias("lng"), F.round(c["lat"], 6).alias("lat"))


@query("late_rows", f"WITH {EV}, p AS (SELECT *, event_id % 4 AS part FROM ev), m AS (SELECT part, max(sec) AS newest FROM p GROUP BY 1), w AS (SELECT a.part, max(b.newest) - 864000 AS mark FROM m a LEFT JOIN m b ON b.part < a.part GROUP BY 1) SELECT event_id, sec, CASE WHEN sec < mark THEN mark - sec END AS lateness FROM p JOIN w USING (part)")
def late_rows(spark, sf):
    """Events that come in four parts, each from all times: those ten days and more behind the newest are put aside with their lateness."""
    rows, folder = events(spark, sf).select("event_id", "sec"), shared_folder(spark, "late-rows")
    for k in range(4):
        rows.where(F.col("event_id") % 4 == k).write.parquet(f"{folder}/in/{k}")
        in_time, late = live.split_late(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"), "sec", 864_000, folder)
    return in_time.withColumn("lateness", F.lit(None).cast("bigint")).unionByName(late)


@query("poll_channels", f"WITH {EV} SELECT event_type AS channel_name, event_id AS telegram_id, 'value ' || k AS text, sec AS timestamp FROM ev")
def poll_channels(spark, sf):
    """Messages of channels, two blocks of each in a batch, by a query that is stopped, and goes on when there is more."""
    spark.dataSource.register(channels.ChannelMessages)
    folder = shared_folder(spark, "poll-channels")
    e = events(spark, sf).select(F.col("event_type").alias("channel_name"), F.col("event_id").alias("telegram_id"), F.concat(F.lit("value "), F.col("k").cast("string")).alias("text"), F.col("sec").alias("timestamp"))
    low, high = e.agg(F.min("telegram_id"), F.max("telegram_id")).first()  # one row
    size = (high - low) // 12 + 1
    middle = (low // size + 7) * size
    for part in (e.where(F.col("telegram_id") < middle), e.where(F.col("telegram_id") >= middle)):
        channels.write_blocks(part, f"{folder}/in", size)
        stream = spark.readStream.format("channel_messages").option("path", f"{folder}/in").option("progress", f"{folder}/progress").option("limit", 2).load()
        q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("publish_changes", ORACLE_SQL["changelog_to_snapshot"].replace("SELECT id, seq FROM l", "SELECT id, seq, 1::BIGINT AS copies FROM l"))
def publish_changes(spark, sf):
    """What a published changelog leaves, with one batch published again after it was undone, and a snapshot in between."""
    changes = _changes(spark, sf).select(F.col("seq"), "op", "id", "payload")
    folder = shared_folder(spark, "publish-changes")
    low, high = changes.agg(F.min("seq"), F.max("seq")).first()  # one row
    number = F.floor((F.col("seq") - low) * 3 / (high - low + 1))
    for k in range(3):
        changes.where(number == k).write.parquet(f"{folder}/in/{k}")
        for again in (False, True):  # as if the query had been killed after it published, before it was known
            if again:
                channels.forget_commit(f"{folder}/checkpoint")
            q = channels.publishing(spark.readStream.schema(changes.schema).parquet(f"{folder}/in/*"), f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start()
            try:
                q.awaitTermination(300)
            finally:
                q.stop()
        if k == 1:
            channels.compacted(spark, f"{folder}/out")
    out = channels.published(spark, f"{folder}/out")
    copies = out.groupBy("seq").agg(F.count("*").alias("copies"))
    return readers.applied(out).select("id", "seq").join(copies, "seq").select("id", "seq", "copies")


@query("parse_messages")
def parse_messages(spark, sf):
    """Whole texts of documents as messages, with names of parts as places."""
    m = table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("id"), F.col("source").alias("channel_name"), "text", F.col("doc_id").alias("timestamp"))
    out = parse.parse(m, _gazetteer(spark, sf))
    return out.select("id", "event_type", "weapon_type", "weapon_count", "filtered_out", "is_followup", "count_delta", F.round("confidence", 6).alias("confidence"), F.col("location.canonical_name").alias("location"), F.col("heading.canonical_name").alias("heading"))


_SAID = """e AS (SELECT event_id, event_id % 5 AS t, p.p_name AS p, q.p_name AS q FROM events JOIN part p ON p.p_partkey = (SELECT min(p_partkey) FROM part) + event_id % 97 JOIN part q ON q.p_partkey = (SELECT min(p_partkey) FROM part) + event_id % 89)"""


def _said(spark, sf, pairs=False):
    """Messages of known form about every event, whose places are names of parts."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    least = part.agg(F.min("p_partkey").alias("least"))  # one row
    e = table(spark, sf, "events").select("event_id").join(F.broadcast(least)).select("event_id", (F.col("least") + F.col("event_id") % 97).alias("a"), (F.col("least") + F.col("event_id") % 89).alias("b"))
    e = e.join(part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("p")), "a").join(part.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("q")), "b")
    t, say = F.col("event_id") % 5, lambda *x: F.concat(*(F.col(c) if c in ("p", "q") else F.lit(c) for c in x))
    said = F.when(t == 0, say("Шахед курсом на ", "p")).when(t == 1, say("2 БпЛА через ", "q", " на ", "p")).when(t == 2, say("Взрывы в районе ", "p")).when(t == 3, say("Залетают на ", "p", ", ", "q")).otherwise(F.lit("что-то непонятное совсем без места тут"))
    return e.select((F.col("event_id") + 1).alias("id"), F.lit("c").alias("channel_name"), said.alias("text"), F.col("event_id").alias("timestamp"), *(["p", "q"] if pairs else []))


@query("parse_templates", f"""WITH {_SAID}
SELECT event_id + 1 AS id, CASE t WHEN 2 THEN 'impact' WHEN 4 THEN NULL ELSE 'tracking' END AS event_type, CASE t WHEN 0 THEN 'shahed' WHEN 1 THEN 'bpla' WHEN 3 THEN 'bpla' ELSE 'unknown' END AS weapon_type, CASE t WHEN 1 THEN 2 ELSE 1 END AS weapon_count,
  CASE t WHEN 2 THEN p WHEN 3 THEN p END AS location, CASE t WHEN 0 THEN p WHEN 1 THEN p WHEN 3 THEN q END AS heading, CASE t WHEN 1 THEN q END AS via, CASE t WHEN 0 THEN 0.6 WHEN 1 THEN 0.6 WHEN 2 THEN 0.4 WHEN 3 THEN 0.8 ELSE 0 END::DOUBLE AS confidence FROM e""")
def parse_templates(spark, sf):
    """Messages of known form, parsed."""
    out = parse.parse(_said(spark, sf), _gazetteer(spark, sf))
    place = lambda c: F.col(f"{c}.canonical_name").alias(c)
    return out.select("id", "event_type", "weapon_type", "weapon_count", place("location"), place("heading"), place("via"), F.round("confidence", 6).alias("confidence"))


_NEW = "CASE WHEN h AND {0} LIKE '%e%' THEN {0} || ' (moved)' ELSE {0} END"


@query("stream_messages", f"""WITH {_SAID}, h AS (SELECT *, (event_id - min(event_id) OVER ()) * 4 // (max(event_id) OVER () - min(event_id) OVER () + 1) >= 2 AS h FROM e), n AS (SELECT event_id, t, h, {_NEW.format('p')} AS p, {_NEW.format('q')} AS q FROM h)
SELECT event_id + 1 AS id, CASE WHEN h THEN 2 ELSE 1 END::BIGINT AS gazetteer_version, CASE t WHEN 2 THEN 'impact' WHEN 4 THEN NULL ELSE 'tracking' END AS event_type, CASE t WHEN 0 THEN 'shahed' WHEN 1 THEN 'bpla' WHEN 3 THEN 'bpla' ELSE 'unknown' END AS weapon_type,
  CASE t WHEN 2 THEN p WHEN 3 THEN p END AS location, CASE t WHEN 0 THEN p WHEN 1 THEN p WHEN 3 THEN q END AS heading, CASE t WHEN 1 THEN q END AS via FROM n""")
def stream_messages(spark, sf):
    """Messages parsed as a stream of four parts; between the second and the third a new gazetteer renames some places."""
    said, places, folder = _said(spark, sf), _gazetteer(spark, sf), shared_folder(spark, "stream-messages")
    moved = places.withColumns({"aliases": F.array_append("aliases", F.col("canonical")), "canonical": F.when(F.contains("canonical", F.lit("e")), F.concat("canonical", F.lit(" (moved)"))).otherwise(F.col("canonical"))})
    low, high = said.agg(F.min("timestamp"), F.max("timestamp")).first()  # one row
    for k in range(4):
        if k in (0, 2):
            live.publish_gazetteer(moved if k else places, f"{folder}/gazetteer")
        said.where(F.floor((F.col("timestamp") - low) * 4 / (high - low + 1)) == k).write.parquet(f"{folder}/in/{k}")
        events = live.parse_stream(spark.readStream.schema(said.schema).parquet(f"{folder}/in/*"), f"{folder}/gazetteer", folder)
    place = lambda c: F.col(f"{c}.canonical_name").alias(c)
    return events.select("id", "gazetteer_version", "event_type", "weapon_type", place("location"), place("heading"), place("via"))


_FALL = f"""ac AS (SELECT id, event_type, last_updated_at FROM inc WHERE status <> 'expired'), nw AS (SELECT event_type, arg_min(id, struct_pack(a := -last_updated_at, i := id)) AS id, max(last_updated_at) AS t FROM ac GROUP BY 1)
SELECT event_id, CASE WHEN ev.k % 3 > 0 THEN coalesce(CASE WHEN value / 100 >= 0.35 THEN ac.id END, CASE WHEN sec - t <= 1200 THEN nw.id END) END AS fallback FROM ev LEFT JOIN ac ON ac.id = ev.event_type || '-' || (ev.k % 7) LEFT JOIN nw ON nw.event_type = ev.event_type"""


@query("incident_fallback", f"WITH {EV}, {INC}, {_FALL}")
def incident_fallback(spark, sf):
    """Events without a place take an incident's: the one that they continue, or the newest of their channel; a third have a place."""
    none = F.lit(None).cast("struct<lat: double, lng: double>")
    own = F.when(F.col("k") % 3 == 0, F.struct("lat", "lng"))
    e = events(spark, sf).select(
        "event_id", F.col("event_type").alias("channel_name"), F.lit("tracking").alias("event_type"), F.col("sec").alias("timestamp"), own.alias("location"), none.alias("heading"), none.alias("via"),
        F.concat_ws("-", "event_type", (F.col("k") % 7).cast("string")).alias("continues_incident_id"), (F.col("value") / 100).alias("continuation_confidence"),
    )
    point = F.struct(F.lit(50.0).alias("lat"), F.lit(36.0).alias("lng"), F.lit("").alias("name"))
    i = incidents(spark, sf).where("status <> 'expired'").select("id", F.array("event_type").alias("source_channels"), "last_updated_at", F.array(point).alias("trajectory"), F.when(F.lit(False), point).alias("heading"))
    return parse.incident_fallback(e, i).select("event_id", F.col("fallback.id").alias("fallback"))


_ANSWERS = f"""WITH {EV}, {INC}, a AS (SELECT event_id, event_id % 11 AS t, event_type || '-' || (k % 7) AS link, CASE WHEN value / 500 > 1 THEN 1.0 ELSE value / 500 END AS c FROM ev),
  r AS (SELECT *, CASE WHEN t IN (2, 3) THEN 'empty' WHEN t = 4 THEN 'invalid_json' WHEN t IN (5, 6, 7, 10) THEN 'invalid_schema' END AS reason FROM a)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN 'impact' END AS event_type, CASE WHEN reason IS NULL THEN CASE WHEN t = 8 THEN 1 ELSE 3 END END AS weapon_count, CASE WHEN reason IS NULL THEN round(CASE WHEN t = 9 THEN 0.5 ELSE c END * 0.9, 6) END AS confidence,
  CASE WHEN reason IS NULL THEN inc.id END AS link, CASE WHEN reason IS NULL THEN CASE WHEN inc.id IS NULL THEN 0 ELSE 0.75 END END::DOUBLE AS link_confidence FROM r LEFT JOIN inc ON inc.id = r.link AND inc.status <> 'expired'"""


@query("model_answers", _ANSWERS)
def model_answers(spark, sf):
    """A model's answers about all events: right ones, fenced ones, empty ones, broken JSON, other types, values out of range, missing values."""
    t, e = F.col("event_id") % 11, events(spark, sf)
    link, c = F.concat_ws("-", "event_type", (F.col("k") % 7).cast("string")), F.least(F.col("value") / 500, F.lit(1.0))
    given = lambda count=F.lit(3), kind=F.lit("impact"), c=c: F.to_json(F.struct(kind.alias("event_type"), F.lit("bpla").alias("weapon_type"), count.alias("weapon_count"), c.alias("confidence"), link.alias("continues_incident_id"), F.lit(0.75).alias("continuation_confidence")))
    none = F.lit(None)
    answer = (
        F.when(t == 0, given()).when(t == 1, F.concat(F.lit("```json\n"), given(), F.lit("\n```"))).when(t == 2, none.cast("string")).when(t == 3, "  ").when(t == 4, F.concat(given(), F.lit(", and so on")))
        .when(t == 5, given(F.lit("many"))).when(t == 6, given(kind=F.lit("x"))).when(t == 7, given(c=F.lit(1.5))).when(t == 8, given(none.cast("int"))).when(t == 9, given(c=none.cast("double"))).otherwise(F.lit("[1, 2]"))
    )
    active = serve.active(incidents(spark, sf)).select("id")
    out, good = parse.model_events(e.select("event_id", answer.alias("answer")), active), F.col("reason").isNull()
    of = lambda c, name: F.when(good, c).alias(name)
    return out.select("event_id", "reason", of(F.col("event_type"), "event_type"), of(F.col("weapon_count"), "weapon_count"), of(F.round("confidence", 6), "confidence"), of(F.col("continues_incident_id"), "link"), of(F.col("continuation_confidence"), "link_confidence"))


@query("placed_answers", f"WITH {_SAID} SELECT event_id, CASE t WHEN 0 THEN p WHEN 2 THEN 'spot' WHEN 4 THEN p || ' / ' || q || ' (approach)' END AS location, CASE t WHEN 1 THEN p WHEN 4 THEN p || ' / ' || q END AS heading, CASE t WHEN 1 THEN q END AS via, CASE t WHEN 3 THEN 'tracking_without_geo' END AS reason FROM e WHERE p <> q")
def placed_answers(spark, sf):
    """A model's events with places by name, from an incident, of a pair in the text, and without any."""
    m = _said(spark, sf, pairs=True).where("p <> q")
    t, none = (F.col("id") - 1) % 5, F.lit(None).cast("string")
    texts = F.when(t == 4, F.concat(F.lit("БпЛА на "), "p", F.lit("/"), "q")).otherwise(F.lit("нет"))
    given = F.to_json(F.struct(
        F.lit("tracking").alias("event_type"), F.lit("bpla").alias("weapon_type"), F.when(t == 0, F.col("p")).alias("location"), F.when(t == 1, F.col("p")).alias("heading"), F.when(t == 1, F.col("q")).alias("via"),
        F.when(t == 2, "i1").otherwise(none).alias("continues_incident_id"), F.lit(0.9).alias("continuation_confidence"),
    ))
    point = F.struct(F.lit(50.0).alias("lat"), F.lit(36.0).alias("lng"), F.lit("spot").alias("name"))
    active = spark.range(1).select(F.lit("i1").alias("id"), F.array(F.lit("elsewhere")).alias("source_channels"), F.lit(0).cast("bigint").alias("last_updated_at"), F.array(point).alias("trajectory"), F.when(F.lit(False), point).alias("heading"))
    answers = parse.model_events(m.select("id", "channel_name", "timestamp", texts.alias("text"), given.alias("answer")), active.select("id"))
    place = lambda c: F.col(f"{c}.canonical_name").alias(c)
    return parse.placed_events(answers, _gazetteer(spark, sf), active).select((F.col("id") - 1).alias("event_id"), place("location"), place("heading"), place("via"), "reason")


#: A phrase of each intent, in the order of the fixed patterns.
_PHRASES = (
    ("heading_change", "довернул на Место"), ("current_location", "кружит над Местом"), ("via_location", "летит курсом Место"), ("continuation", "повторные пуски на Место"), ("additional_unit", "следом ещё 2 шаболды"), ("correction", "upd: одна цель"),
    ("impact", "приземлили"), ("clear_status", "больше не фиксируется"), ("acoustic_observation", "акустически слышно"), ("situational_summary", "по шаболдам тихо"), ("launch_alert", "активность пусковых Место"),
)


@query("phrase_intents", "WITH n(k, name) AS (VALUES " + ", ".join(f"({k}, '{name}')" for k, (name, _) in enumerate(_PHRASES)) + ") SELECT event_id, coalesce(string_agg(name, ',' ORDER BY k), '') AS intents FROM events LEFT JOIN n ON k IN (event_id % 13, event_id // 13 % 13) GROUP BY event_id")
def phrase_intents(spark, sf):
    """Texts of two phrases, of one, or of none, by the fixed patterns of all intents."""
    said = lambda k: F.coalesce(*(F.when(k == j, phrase) for j, (_, phrase) in enumerate(_PHRASES)), F.lit("тут"))
    e = table(spark, sf, "events").select("event_id")
    both = F.concat(said(F.col("event_id") % 13), F.lit("\n"), said(F.floor(F.col("event_id") / 13) % 13))
    return e.select("event_id", F.array_join(parse.intents(both), ",").alias("intents"))


_MID = ("((lat0 + lat) / 2)", "((lng0 + lng) / 2)")
_AP = _dest(*_MID, brg(*_MID, "50.42", "36.75"), f"least(14.0, greatest(6.0, {hav('lat0', 'lng0', 'lat', 'lng')} * 1.1))")


@query("slash_pairs", f"WITH {EV}, {_SEG} SELECT event_id, round({_MID[0]}, 6) AS mid_lat, round({_MID[1]}, 6) AS mid_lng, round({_AP[0]}, 5) AS at_lat, round({_AP[1]}, 5) AS at_lng, round(greatest(0.35, least(0.5, k / 100) * 0.85), 6)::DOUBLE AS mid_confidence, round(greatest(0.42, greatest(0.35, least(0.5, k / 100) * 0.85) * 0.92), 6)::DOUBLE AS at_confidence, 'a' || k || ' / b (approach)' AS name FROM seg")
def slash_pairs(spark, sf):
    """Middle and approach of successive places of a user."""
    place = lambda name, lat, lng, c: F.struct(name.alias("canonical_name"), F.col(lat).alias("lat"), F.col(lng).alias("lng"), F.lit(None).cast("string").alias("parent"), c.alias("confidence"))
    left, right = place(F.concat(F.lit("a"), F.col("k").cast("string")), "lat0", "lng0", F.col("k") / 100), place(F.lit("b"), "lat", "lng", F.lit(0.5))
    s = _segments(spark, sf).select("event_id", parse.pair_place(F.lit("x"), left, right).alias("m"), parse.approach_place(F.lit("x"), left, right).alias("a"))
    of = lambda c, n, digits=6: F.round(c, digits).alias(n)
    return s.select("event_id", of("m.lat", "mid_lat"), of("m.lng", "mid_lng"), of("a.lat", "at_lat", 5), of("a.lng", "at_lng", 5), of("m.confidence", "mid_confidence"), of("a.confidence", "at_confidence"), F.col("a.canonical_name").alias("name"))


@query("partial_update", f"WITH {EV}, u AS (SELECT k, arg_max(user_id, event_id) FILTER (user_id % 4 > 0) AS a, arg_max(event_type, event_id) FILTER (value > 480) AS b FROM ev GROUP BY 1) SELECT p_partkey, coalesce(a, p_size)::BIGINT AS n, coalesce(b, p_brand) AS label FROM part LEFT JOIN u ON k = p_partkey")
def partial_update(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("n"), F.col("p_brand").alias("label"))
    updates = events(spark, sf).select(F.col("k").alias("id"), F.when(F.col("user_id") % 4 > 0, F.col("user_id")).alias("n"), F.when(F.col("value") > 480, F.col("event_type")).alias("label"), F.col("event_id").alias("at"))
    return serve.patched(rows, updates, "id", "at").withColumnRenamed("id", "p_partkey")


@query("point_update", f"WITH {EV} SELECT event_id, CASE WHEN k < 50 THEN 'i' || (k % 9) WHEN user_id % 2 = 0 THEN 'old' END AS incident_id, CASE WHEN k < 20 THEN 2 WHEN k < 50 THEN 1 ELSE 0 END AS processed FROM ev")
def point_update(spark, sf):
    e = events(spark, sf)
    held = e.select("event_id", F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "old").alias("incident_id"), F.lit(0).alias("processed"))
    done = e.where("k < 50").select(F.col("event_id").alias("id"), F.when(F.col("k") < 20, 2).otherwise(1).alias("processed"))
    given = e.where("k < 50").select("event_id", F.concat(F.lit("i"), (F.col("k") % 9).cast("string")).alias("incident_id"))
    return serve.marked(serve.assigned(held, given), done).select("event_id", "incident_id", "processed")


@query("counter_upsert", "SELECT name, sum(n)::BIGINT AS occurrence_count FROM (SELECT p_name AS name, p_size AS n FROM part UNION ALL SELECT substr(p_name, 1, 5), 1 FROM part) GROUP BY 1")
def counter_upsert(spark, sf):
    p = table(spark, sf, "part")
    held = p.groupBy(F.col("p_name").alias("name")).agg(F.sum("p_size").alias("occurrence_count"))
    new = jobs.counted(p.select(F.substring("p_name", 1, 5).alias("name")))
    return serve.merged_counts(held, new)


@query("context_left_join", f"WITH {EV}, m AS (SELECT event_id, sec FROM ev WHERE event_type = 'view' AND sec >= {NOW} - 86400 * 20 AND event_id <> 77 ORDER BY sec DESC, event_id DESC LIMIT 6) SELECT m.event_id, CASE WHEN e.event_id IS NOT NULL THEN 'tracking u' || user_id || ' inc:' || k END AS summary FROM m LEFT JOIN ev e ON e.event_id = m.event_id AND NOT value >= 30")
def context_left_join(spark, sf):
    e = events(spark, sf)
    messages = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("channel"), "sec")
    none = F.lit(None).cast("string")
    of = e.select(F.col("event_id").alias("message_id"), F.lit("tracking").alias("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("weapon"), none.alias("location"), none.alias("heading"), F.col("k").cast("string").alias("incident_id"), (F.col("value") >= 30).alias("filtered_out"))
    return serve.context_rows(messages, of, "view", NOW - 86400 * 20, exclude=77).select(F.col("id").alias("event_id"), "summary")


@query("unprocessed_oldest", f"WITH {EV} SELECT event_id, sec FROM ev WHERE k % 3 = 0 ORDER BY sec, event_id LIMIT 50")
def unprocessed_oldest(spark, sf):
    m = events(spark, sf).select(F.col("event_id").alias("id"), F.col("sec").alias("timestamp"), (F.col("k") % 3).alias("processed"))
    return serve.unprocessed(m).select(F.col("id").alias("event_id"), F.col("timestamp").alias("sec"))


@query("push_poll_union", f"WITH {EV} SELECT event_type AS channel_id, event_id AS telegram_id, min(t) AS received_at FROM (SELECT event_type, event_id, sec + 2 AS t FROM ev WHERE k < 60 UNION ALL SELECT event_type, event_id, sec + k % 5 FROM ev WHERE k > 40) GROUP BY 1, 2")
def push_poll_union(spark, sf):
    e = events(spark, sf)
    of = lambda t: [F.col("event_type").alias("channel_id"), F.col("event_id").alias("telegram_id"), t.alias("received_at"), F.col("k").alias("text")]
    pushed, polled = e.where("k < 60").select(*of(F.col("sec") + 2)), e.where("k > 40").select(*of(F.col("sec") + F.col("k") % 5))
    return readers.united(pushed, polled).select("channel_id", "telegram_id", "received_at")


@query("mismatch_groups", "WITH g AS (SELECT p_brand AS canonical, count(*) AS size FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10), a AS (SELECT p_brand, p_name || p_partkey AS alias, row_number() OVER (PARTITION BY p_brand ORDER BY p_name || p_partkey) AS k FROM part) SELECT (row_number() OVER (ORDER BY size DESC, canonical))::INT AS rank, canonical, size, (SELECT string_agg(alias, ',' ORDER BY alias) FROM a WHERE p_brand = canonical AND k <= 5) AS aliases FROM g")
def mismatch_groups(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("canonical"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("alias"))
    return lexicon.mismatch_groups(p, 10, 5).withColumn("aliases", F.array_join("aliases", ","))


@query("lexicon_problems", """WITH p AS (SELECT p_partkey AS ordinal, p_brand, p_size, p_name FROM part)
SELECT 'location_dictionary' AS list, ordinal, 'confidence is not from 0 to 1' AS problem FROM p WHERE p_size > 40 UNION ALL SELECT 'location_dictionary', ordinal, 'canonical is empty' FROM p WHERE ordinal % 7 = 0 UNION ALL SELECT 'location_dictionary', ordinal, 'an alias is empty' FROM p WHERE ordinal % 11 = 0
UNION ALL SELECT 'weapon_dictionary', ordinal, 'canonical is no weapon' FROM p WHERE ordinal % 5 > 0 UNION ALL SELECT 'top_ambiguous_terms', ordinal, 'priority is none' FROM p WHERE ordinal % 4 > 2 UNION ALL SELECT 'priority_hotspots', ordinal, 'priority_rank is no positive integer' FROM p WHERE p_size % 2 = 1""")
def lexicon_problems(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    ordinal, one, words = k.alias("ordinal"), F.lit(1.0).alias("confidence"), F.array(F.lit("x"))
    return lexicon.problems({
        "location_dictionary": p.select(ordinal, F.when(k % 7 > 0, F.col("p_brand")).otherwise("").alias("canonical"), F.when(k % 11 == 0, F.array(F.lit("a"), F.lit(""))).otherwise(words).alias("aliases"), (F.col("p_size") / 40).alias("confidence")),
        "weapon_dictionary": p.select(ordinal, F.when(k % 5 == 0, "kab").otherwise("other").alias("canonical"), words.alias("aliases"), one),
        "phrase_patterns": p.select(ordinal, F.lit("i").alias("intent"), F.lit("r").alias("regex")),
        "top_ambiguous_terms": p.select(ordinal, F.lit("t").alias("term"), words.alias("possible_mappings"), F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW"), F.lit("?")), (k % 4 + 1).cast("int")).alias("priority")),
        "priority_hotspots": p.select(ordinal, F.lit("c").alias("canonical"), (F.col("p_size") / 2).alias("priority_rank")),
    })


@query("stored_rows", f"WITH {EV} SELECT event_id, 'p' || k AS location_name, lat AS location_lat, lng AS location_lng, NULL::VARCHAR AS heading_name, 'v' AS via_name FROM ev")
def stored_rows(spark, sf):
    of = lambda name, lat, lng: F.struct(name.alias("raw_name"), lat.alias("lat"), lng.alias("lng"))
    e = events(spark, sf).select("event_id", of(F.concat(F.lit("p"), F.col("k").cast("string")), F.col("lat"), F.col("lng")).alias("location"), F.lit(None).cast("struct<raw_name: string, lat: double, lng: double>").alias("heading"), of(F.lit("v"), F.lit(0.0), F.lit(0.0)).alias("via"))
    return serve.flattened(e, ("event_id",)).select("event_id", "location_name", "location_lat", "location_lng", "heading_name", "via_name")


@query("recent_expanded", f"WITH {EV}, {INC} SELECT id, event_type AS channels, last_event::DOUBLE AS last_lat, CASE WHEN n % 2 = 0 THEN 1.5 END::DOUBLE AS anchor_lat FROM inc WHERE last_updated_at > {NOW} - 24 * 3600")
def recent_expanded(spark, sf):
    """Incidents stored with JSON columns, some broken, of the last day, as clients see them."""
    point = lambda lat: F.struct(lat.cast("double").alias("lat"), F.lit(36.0).alias("lng"), F.col("last_updated_at").alias("timestamp"), F.lit("x").alias("name"))
    i = incidents(spark, sf).withColumns({"weapon_type": F.lit("shahed"), "confidence": F.lit(0.9), "source_channels": F.array("event_type"), "trajectory": F.array(point(F.lit(1)), point(F.col("last_event"))), "projection_anchor": point(F.lit(1.5))})
    rows = serve.to_json_rows(i).withColumn("projection_anchor", F.when(F.col("n") % 2 == 0, F.col("projection_anchor")).otherwise("{broken"))
    return serve.recent_live(rows, NOW).select("id", F.array_join("source_channels", ",").alias("channels"), F.col("lat").alias("last_lat"), F.col("projection_anchor.lat").alias("anchor_lat"))


@query("snapshot_levels", f"WITH {EV}, {INC} SELECT 9::BIGINT AS seq, 'snapshot' AS op, id FROM inc WHERE status <> 'expired' UNION ALL SELECT DISTINCT 9::BIGINT, 'risk', event_type FROM ev")
def snapshot_levels(spark, sf):
    levels = events(spark, sf).select(F.col("event_type").alias("id")).distinct().withColumn("level", F.lit("red"))
    return readers.snapshot(serve.active(incidents(spark, sf)), levels, 9).select("seq", "op", "id")


@query("compact_incidents", f"WITH {EV}, {INC} SELECT id, event_type AS weapon_type, last_event::DOUBLE AS lat, last_updated_at FROM inc")
def compact_incidents(spark, sf):
    point = F.struct(F.col("last_event").cast("double").alias("lat"), F.lit(36.0).alias("lng"), F.lit("x").alias("name"))
    i = incidents(spark, sf).select("id", F.col("event_type").alias("weapon_type"), F.array(point).alias("trajectory"), point.alias("heading"), "last_updated_at")
    return parse.compact(i).select("id", "weapon_type", F.col("last.lat").alias("lat"), "last_updated_at")


@query("accepted_messages", "SELECT doc_id FROM documents WHERE source IN (SELECT min(source) FROM documents) AND text <> ''")
def accepted_messages(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("source", "channel_name")
    first = d.agg(F.min("channel_name")).first()[0]  # one value
    return readers.accepted(d, [first]).select("doc_id")


_NOTES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in THREAT_NOTES.items())


@query("target_panel", f"WITH {EV}, {INC} SELECT id, CASE status WHEN 'active' THEN 'Активна' WHEN 'impact' THEN 'Влучання' ELSE 'Завершено' END AS status_label, CASE WHEN n % 3 = 0 THEN 'last' || n WHEN n % 3 = 1 THEN 'ahead' ELSE '—' END AS place_name, CASE CASE n % 4 WHEN 0 THEN 'shahed' WHEN 1 THEN 'kab' WHEN 2 THEN 'fpv' ELSE 'x' END {_NOTES} ELSE '{OTHER_NOTE}' END AS threat_note FROM inc")
def target_panel(spark, sf):
    point = lambda name: F.struct(F.lit(50.0).alias("lat"), F.lit(36.0).alias("lng"), name.alias("name"))
    i, n = incidents(spark, sf), F.col("n")
    weapons = F.when(n % 4 == 0, "shahed").when(n % 4 == 1, "kab").when(n % 4 == 2, "fpv").otherwise("x")
    shown = i.withColumns({"weapon_type": weapons, "trajectory": F.array(point(F.when(n % 3 == 0, F.concat(F.lit("last"), n.cast("string"))).otherwise(""))), "heading": F.when(n % 3 < 2, point(F.lit("ahead")))})
    return serve.panel(shown).select("id", "status_label", "place_name", "threat_note")
