"""Danger levels of districts from incidents and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions import geo
from tocsin.operators.scan import last_before, running_sums
from tocsin.plans.settings import DISTRICT_NAMES, Settings

LEVELS = {2: "red", 1: "orange"}
#: Milliseconds, and changes, of a district's history that are one task's work.
SLOT_MS, SLOT_CHANGES = 3_600_000, 1 << 16


def level_name(rank: Column) -> Column:
    return F.when(rank == 2, "red").when(rank == 1, "orange")


def contribution(ring: Column, s: Settings = Settings()) -> Column:
    """2 (red), 1 (orange) or 0 of an incident (lat, lng, bearing_deg, speed_kmh, eta_seconds, heading_lat, heading_lng) for a ring."""
    lat, lng, direction, speed, eta = (F.col(c) for c in ("lat", "lng", "bearing_deg", "speed_kmh", "eta_seconds"))
    moves = direction.isNotNull() & (speed > 0)

    def inside_after(minutes: float) -> Column:
        p = geo.destination(lat, lng, direction, speed * minutes / 60)
        return moves & geo.in_ring(p["lng"], p["lat"], ring)

    here, soon, later = geo.in_ring(lng, lat, ring), inside_after(s.red_minutes), inside_after(s.orange_minutes)
    h = (F.col("heading_lat"), F.col("heading_lng"))
    bound = moves & (eta > 0) & (eta <= s.orange_eta) & h[0].isNotNull() & (geo.in_ring(h[1], h[0], ring) | geo.segment_enters(lat, lng, *h, ring))
    red = F.coalesce(here | soon, here)
    orange = (geo.ring_distance_km(lat, lng, ring) <= s.edge_km) | F.coalesce(later & ~soon, F.lit(False)) | F.coalesce(bound, F.lit(False))
    return F.when(red, 2).when(orange, 1).otherwise(0)


def reach_km(s: Settings = Settings()) -> Column:
    """No incident counts for a district farther away than this."""
    return F.lit(s.edge_km) + F.coalesce(F.col("speed_kmh"), F.lit(0.0)) * max(s.orange_minutes / 60, s.orange_eta / 3600) + 1


def threats(incidents: DataFrame, districts: DataFrame, s: Settings = Settings(), by: tuple[str, ...] = ()) -> DataFrame:
    """(id, rank) of every district: the highest contribution of any incident, 0 without any.

    With columns ``by`` of the incidents: (*by, id, rank) of every district in every group of theirs.

    Districts are a small dimension (their number doesn't grow with incidents); their
    boxes rule out most pairs before the geometry is computed.
    """
    hit = _hits(incidents, districts, s)
    if by:
        none = incidents.select(*by).distinct().join(F.broadcast(districts.select("id").distinct())).withColumn("rank", F.lit(0))
        return hit.select(*by, "id", "rank").unionByName(none).groupBy(*by, "id").agg(F.max("rank").alias("rank"))
    worst = hit.groupBy("id").agg(F.max("rank").alias("rank"))
    return districts.select("id").distinct().join(worst, "id", "left").select("id", F.coalesce("rank", F.lit(0)).alias("rank"))


def _hits(incidents: DataFrame, districts: DataFrame, s: Settings) -> DataFrame:
    """Incidents with the ``id`` of each district that they may matter for, and their ``rank`` for it."""
    boxed = districts.select("id", "ring", geo.box(F.col("ring")).alias("box"))
    live = incidents.where("status <> 'expired' AND lat IS NOT NULL AND lng IS NOT NULL").withColumn("reach", reach_km(s) / geo.DEGREE_KM)
    wide = F.col("reach") / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    near = F.col("lat").between(F.col("box.lat0") - F.col("reach"), F.col("box.lat1") + F.col("reach")) & F.col("lng").between(F.col("box.lng0") - wide, F.col("box.lng1") + wide)
    return live.join(F.broadcast(boxed), near).withColumn("rank", contribution(F.col("ring"), s))


def district_of(points: DataFrame, districts: DataFrame) -> DataFrame:
    """Each point's (key, lat, lng) district: the first by ordinal that holds it, else null."""
    boxed = districts.select(F.col("id").alias("district_id"), "ordinal", "ring", geo.box(F.col("ring")).alias("box"))
    near = F.col("lat").between(F.col("box.lat0"), F.col("box.lat1")) & F.col("lng").between(F.col("box.lng0"), F.col("box.lng1"))
    hit = points.join(F.broadcast(boxed), near).where(geo.in_ring(F.col("lng"), F.col("lat"), F.col("ring")))
    first = hit.groupBy("key").agg(F.min_by("district_id", "ordinal").alias("district_id"))
    return points.join(first, "key", "left")


def with_overrides(raw: DataFrame, overrides: DataFrame, now_ms: int) -> DataFrame:
    """(id, rank) with the overrides (id, rank, expires_at) that haven't ended at ``now_ms``."""
    live = overrides.where(F.col("expires_at") > now_ms).groupBy("id").agg(F.max("rank").alias("o"))
    return raw.join(live, "id", "left").select("id", F.greatest("rank", F.coalesce("o", F.lit(0))).alias("rank"))


def district_by_name(name: Column, parent: Column, names: dict[str, str] = DISTRICT_NAMES) -> Column:
    """The district that a place's name stands for, else its parent's; null: none."""
    of = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(of[name], of[parent])


def district_in_text(name: Column, labels: dict[str, str], names: dict[str, str] = DISTRICT_NAMES) -> Column:
    """The district of a map's name: by the whole name, else the first whose label (id: label) is in it."""
    found = F
    for district, label in labels.items():
        found = found.when(F.contains(name, F.lit(label)), district)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[name], found.otherwise(F.lit(None).cast("string")))


def place_districts(places: DataFrame, districts: DataFrame, names: dict[str, str] = DISTRICT_NAMES) -> DataFrame:
    """Places (key, name, parent, lat, lng) with ``district_id``: by name, else by the parent's name, else by the point."""
    named = places.withColumn("district_id", district_by_name(F.col("name"), F.col("parent"), names))
    rest = named.where("district_id IS NULL").drop("district_id")
    return named.where("district_id IS NOT NULL").unionByName(district_of(rest, districts))


def alert_marks(alerts: DataFrame, districts: DataFrame, names: dict[str, str] = DISTRICT_NAMES) -> DataFrame:
    """Marks (event_id, id, at_ms, is_impact) of alerts (event_id, event_type, timestamp, location, via, heading).

    Each of an alert's places marks its district; an alert without any marks all districts.
    """
    each = alerts.select("event_id", F.explode(F.array("location", "via", "heading")).alias("p")).where("p IS NOT NULL")
    places = each.select(F.monotonically_increasing_id().alias("key"), "event_id", F.col("p.canonical_name").alias("name"), F.col("p.parent").alias("parent"), F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))
    found = place_districts(places, districts, names).where("district_id IS NOT NULL").groupBy("event_id").agg(F.collect_set("district_id").alias("ids"))
    all_ids = districts.agg(F.array_sort(F.collect_set("id")).alias("all_ids"))  # one row, of a fixed dimension
    of = alerts.select("event_id", (F.col("timestamp") * 1000).alias("at_ms"), (F.col("event_type") == "impact").alias("is_impact")).join(found, "event_id", "left").join(F.broadcast(all_ids))
    return override_targets(of, F.col("all_ids")).select("event_id", "id", "at_ms", "is_impact")


def override_targets(alerts: DataFrame, all_ids: Column) -> DataFrame:
    """The districts that an alert (event_id, district ids of its places) marks: those, or all if there are none."""
    known = F.array_distinct(F.array_compact(F.col("ids")))
    return alerts.withColumn("id", F.explode(F.when(F.size(known) > 0, known).otherwise(all_ids)))


def override_runs(marks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Overrides (id, rank, from_ms, expires_at) that marks (id, at_ms, is_impact) make: one row per run of marks.

    A mark that comes before the last one's end goes on with its run, which ends a lifetime
    after its last mark; later marks begin anew. Red in a run stays to its end.
    """
    marked = marks.groupBy("id", "at_ms").agg(F.max(F.when(F.col("is_impact"), 2).otherwise(1)).alias("mark"))
    begins = F.coalesce(F.col("at_ms") - F.col("before") >= s.override_ms, F.lit(True))
    runs = running_sums(last_before(marked, "id", "at_ms", F.col("at_ms"), "before", SLOT_MS).withColumn("run", begins.cast("int")), "id", "at_ms", ("run",), SLOT_MS)
    # orange before the first red of a run isn't red yet, so a run with both is two rows
    red_at = F.min(F.when(F.col("mark") == 2, F.col("at_ms")))
    per = runs.groupBy("id", "run").agg(F.min("at_ms").alias("from_ms"), (F.max("at_ms") + s.override_ms).alias("end_ms"), red_at.alias("red_ms"))
    orange = per.where("red_ms IS NULL OR red_ms > from_ms").select("id", F.lit(1).alias("rank"), "from_ms", F.coalesce("red_ms", "end_ms").alias("expires_at"))
    return orange.unionByName(per.where("red_ms IS NOT NULL").select("id", F.lit(2).alias("rank"), F.col("red_ms").alias("from_ms"), F.col("end_ms").alias("expires_at")))


def overridden(ticks: DataFrame, runs: DataFrame) -> DataFrame:
    """Ticks (id, at_ms, rank) with the override that holds at their time: the last one begun, if it hasn't ended."""
    both = ticks.select("id", "at_ms", "rank", F.lit(None).cast("struct<rank: int, expires_at: bigint>").alias("o")).unionByName(runs.select("id", F.col("from_ms").alias("at_ms"), F.lit(None).cast("int").alias("rank"), F.struct("rank", "expires_at").alias("o")))
    held = last_before(both, "id", "at_ms", F.col("o"), "o", SLOT_MS, (F.col("rank").isNotNull(),), inclusive=True).where("rank IS NOT NULL")
    return held.select("id", "at_ms", F.greatest("rank", F.when(F.col("o.expires_at") > F.col("at_ms"), F.col("o.rank"))).alias("rank"))


def merge_overrides(marks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The override (id, rank, expires_at) that is left after all marks of a district: that of its last run."""
    return override_runs(marks, s).groupBy("id").agg(F.max_by(F.struct("rank", "expires_at"), F.struct("expires_at", "rank")).alias("o")).select("id", "o.rank", "o.expires_at")


def levels_over(versions: DataFrame, contributions: DataFrame) -> DataFrame:
    """How a district's rank goes as incidents change: ticks (id, seq, rank), one per district and change that moves it.

    ``versions`` (incident_id, seq) are all changes of incidents, their ends included; ``contributions``
    (incident_id, seq, id, rank) what the version of that change means for a district. A version
    counts until its incident's next change. Ranks are running sums over a district's own changes.
    """
    until = versions.select("incident_id", "seq", F.lead("seq").over(Window.partitionBy("incident_id").orderBy("seq")).alias("until"))
    of = contributions.where("rank > 0").join(until, ["incident_id", "seq"])
    step = lambda at, sign: of.select("id", F.col(at).alias("seq"), F.when(F.col("rank") == 2, sign).otherwise(0).alias("red"), F.when(F.col("rank") == 1, sign).otherwise(0).alias("orange"))
    steps = step("seq", 1).unionByName(step("until", -1).where("seq IS NOT NULL")).groupBy("id", "seq").agg(F.sum("red").alias("red"), F.sum("orange").alias("orange"))
    sums = running_sums(steps, "id", "seq", ("red", "orange"), SLOT_CHANGES)
    ranked = sums.select("id", "seq", F.when(F.col("red") > 0, 2).when(F.col("orange") > 0, 1).otherwise(0).alias("rank"))
    return last_before(ranked, "id", "seq", F.col("rank"), "before", SLOT_CHANGES).where(F.col("rank") != F.coalesce("before", F.lit(0))).drop("before")


def risk_changes(changes: DataFrame, districts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Ticks (id, seq, rank) out of a changelog (seq, op, id, payload) of incidents: risk as a consumer of every change."""
    kind = "status string, lat double, lng double, bearing_deg double, speed_kmh double, eta_seconds double, heading_lat double, heading_lng double"
    of = changes.where("op IN ('new', 'update', 'expire')").select(F.col("id").alias("incident_id"), "seq", "op", "payload")
    live = of.where("op <> 'expire'").select("incident_id", "seq", F.inline(F.array(F.from_json("payload", kind))))  # parsed once, not for each use of a field
    return levels_over(of.select("incident_id", "seq"), _hits(live, districts, s))


def cooled(ticks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Levels over ticks (id, at_ms, rank): red, orange, green for a while after a threat ends, else null.

    A district's history is scanned by slots: the last tick with a threat, and the first one after it, which is when the
    threat ended.
    """
    ranked = last_before(ticks, "id", "at_ms", F.col("rank"), "prev", SLOT_MS)
    marked = ranked.withColumn("ended", F.when((F.col("rank") == 0) & (F.col("prev") > 0), F.col("at_ms")))
    since = last_before(marked, "id", "at_ms", F.col("ended"), "since", SLOT_MS, inclusive=True)
    green = (F.col("rank") == 0) & F.col("since").isNotNull() & (F.col("at_ms") - F.col("since") < s.cooldown_ms)
    return since.select("id", "at_ms", "rank", F.coalesce(level_name(F.col("rank")), F.when(green, "green")).alias("level"))


def displayed(levels: DataFrame, static: DataFrame) -> DataFrame:
    """What a map shows of (id, level): green everywhere while there is no threat, else the level or the static risk."""
    threat = levels.agg(F.coalesce(F.bool_or(F.col("level").isin("red", "orange")), F.lit(False)).alias("threat"))  # one row
    of = levels.join(F.broadcast(threat)).join(static.select("id", "risk_level"), "id", "left")
    return of.select("id", F.when(~F.col("threat"), "green").otherwise(F.coalesce("level", "risk_level")).alias("shown"))


def level_counts(levels: DataFrame) -> DataFrame:
    """(red, orange): how many districts of (id, level) have each, 0 without any."""
    return levels.agg(F.count_if(F.col("level") == "red").alias("red"), F.count_if(F.col("level") == "orange").alias("orange"))
