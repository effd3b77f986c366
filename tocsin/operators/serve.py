"""Queries over messages, events and incidents; ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions import geo
from tocsin.plans.settings import COLORS, LABELS, OTHER_NOTE, SPEED_KMH, STATUS_LABELS, THREAT_NOTES, Settings


def active(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("status").isin("active", "impact"))


def recent(incidents: DataFrame, now: int, hours: int = 24) -> DataFrame:
    return incidents.where(F.col("last_updated_at") > now - hours * 3600)


def stale(incidents: DataFrame, now: int, age: int = 1800) -> DataFrame:
    """Active incidents without news for longer than ``age``; impacts never are."""
    return incidents.where((F.col("status") == "active") & (F.col("last_updated_at") < now - age))


def newest(incidents: DataFrame, n: int | None = None) -> DataFrame:
    """By last update, then id; the first ``n`` if given."""
    out = incidents.orderBy(F.desc("last_updated_at"), "id")
    return out if n is None else out.limit(n)


def heatmap(events: DataFrame, now: int, hours: int, digits: int = 3) -> DataFrame:
    """Impacts per rounded cell; a cell's coordinates are the smallest of its events."""
    hit = events.where((F.col("event_type") == "impact") & F.col("lat").isNotNull() & (F.col("created_at") > now - hours * 3600) & ~F.col("filtered_out"))
    cells = hit.groupBy(F.round("lat", digits).alias("cell_lat"), F.round("lng", digits).alias("cell_lng"))
    return cells.agg(F.count("*").alias("n"), F.min("lat").alias("lat"), F.min("lng").alias("lng"))


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def first_seen(messages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first message of each key; aggregated before the shuffle, so copies of a hot key meet as one row per task."""
    rest = [c for c in messages.columns if c not in keys]
    first = messages.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("m"))
    return first.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def new_rows(messages: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: messages whose keys aren't stored yet, each once."""
    return messages.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def channel_context(messages: DataFrame, window: int = 1200, rows: int = 6, cap: int = 8) -> DataFrame:
    """For each message (id, channel, sec): its channel's last messages before it within the window, oldest first.

    Messages are dealt by channel and time slot of the window's length, each to its own
    slot and as history to the next one, so that no channel is one task's work.
    """
    n = max(1, min(rows, cap))
    slot = F.floor(F.col("sec") / window)
    own = messages.select("id", "channel", "sec", slot.alias("slot"), F.lit(True).alias("own"))
    both = own.unionByName(own.withColumn("slot", F.col("slot") + 1).withColumn("own", F.lit(False)))
    by = Window.partitionBy("channel", "slot").orderBy("sec", "id")
    seen = F.collect_list(F.struct("sec", "id")).over(by.rowsBetween(-n, -1))
    ids = F.transform(F.filter(seen, lambda m: m["sec"] >= F.col("sec") - window), lambda m: m["id"])
    return both.withColumn("context", ids).where("own").select("id", "channel", "sec", "context")


def reply_incident(replies: DataFrame, events: DataFrame) -> DataFrame:
    """(reply_id, incident_id): the newest incident of the replied-to message's published events."""
    known = events.where(~F.col("filtered_out") & F.col("incident_id").isNotNull()).select("channel", "message_id", "incident_id", "created_at")
    found = replies.join(known, (replies["channel"] == known["channel"]) & (replies["reply_to"] == known["message_id"]))
    return found.groupBy("reply_id").agg(F.max_by("incident_id", F.struct("created_at", "incident_id")).alias("incident_id"))


def summary(event_type: Column, weapon: Column, location: Column, heading: Column, incident: Column) -> Column:
    """The parts that aren't null, in a row."""
    tag = lambda t, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(t), c))
    return F.concat_ws(" ", event_type, weapon, tag("loc:", location), tag("→", heading), tag("inc:", incident))


def lookup(key: Column, values: dict, default) -> Column:
    """A value by key out of a small fixed table."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], default if isinstance(default, Column) else F.lit(default))


def live(incidents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Incidents as clients see them: label, colour, speed and what the last segment of the track says of motion."""
    w, t = F.col("weapon_type"), F.col("trajectory")
    last, prev = F.try_element_at(t, F.lit(-1)), F.try_element_at(t, F.lit(-2))
    base = F.coalesce(F.col("projection_anchor"), last)
    speed = lookup(w, {k: float(v) for k, v in SPEED_KMH.items()}, float(SPEED_KMH["unknown"]))
    long = geo.haversine_km(prev["lat"], prev["lng"], last["lat"], last["lng"]) >= s.same_point_km
    to = F.when(long, geo.destination(last["lat"], last["lng"], geo.bearing(prev["lat"], prev["lng"], last["lat"], last["lng"]), s.ahead_km))
    out = incidents.withColumns({"label": lookup(w, LABELS, w), "color": lookup(w, COLORS, "#888"), "speed_kmh": speed, "lat": last["lat"], "lng": last["lng"], "heading_lat": to["lat"], "heading_lng": to["lng"]})
    km = geo.haversine_km(base["lat"], base["lng"], F.col("heading_lat"), F.col("heading_lng"))
    out = out.withColumn("bearing_deg", geo.bearing(base["lat"], base["lng"], F.col("heading_lat"), F.col("heading_lng")))
    return out.withColumn("eta_seconds", F.floor(km / F.col("speed_kmh") * 3600 + 0.5)).withColumn("flags", F.when(F.col("confidence") < s.low_confidence, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>")))


def position_at(incidents: DataFrame, now: int) -> DataFrame:
    """Where live incidents are now by dead reckoning from their anchor, at their target at the latest."""
    a = F.coalesce(F.col("projection_anchor"), F.try_element_at(F.col("trajectory"), F.lit(-1)))
    seconds = F.least(F.greatest(F.lit(now) - a["timestamp"], F.lit(0)), F.coalesce("eta_seconds", F.lit(now)))
    return incidents.withColumn("now_at", F.when(F.col("status") == "active", geo.project(a["lat"], a["lng"], F.col("bearing_deg"), F.col("speed_kmh"), seconds)))


def sessions(events: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """Runs of a key's events with no gap longer than ``gap`` between them."""
    by = Window.partitionBy(*keys).orderBy("sec", "event_id")
    starts = F.when(F.coalesce(F.col("sec") - F.lag("sec").over(by), F.lit(gap + 1)) > gap, 1).otherwise(0)
    numbered = events.withColumn("starts", starts).withColumn("session", F.sum("starts").over(by))
    return numbered.groupBy(*keys, "session").agg(F.min("sec").alias("first_seen_at"), F.max("sec").alias("last_updated_at"), F.count("*").alias("n"))


def anchor(json: Column) -> Column:
    """A projection anchor out of JSON; broken or not finite: null."""
    a = F.from_json(json, "lat double, lng double, timestamp double, name string")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(good(a["lat"]) & good(a["lng"]) & good(a["timestamp"]), a)


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an older and a newer schema together; columns that a side lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def context_rows(messages: DataFrame, events: DataFrame, channel: str, since: int, rows: int = 6, cap: int = 8, exclude: int | None = None) -> DataFrame:
    """A channel's last messages (id, channel, sec, text) since a time, oldest first, each with its published event, if it has one.

    Events (message_id, event_type, weapon, location, heading, incident_id, filtered_out) that are
    filtered out don't join, so their messages stay, with nulls and without a summary.
    """
    some = messages.where((F.col("channel") == channel) & (F.col("sec") >= since) & (F.lit(True) if exclude is None else F.col("id") != exclude))
    last = some.orderBy(F.desc("sec"), F.desc("id")).limit(max(1, min(rows, cap)))
    shown = events.where(~F.col("filtered_out")).withColumnRenamed("message_id", "id").drop("filtered_out")
    of = last.join(shown, "id", "left")
    text = F.when(F.col("event_type").isNotNull(), summary(*(F.col(c) for c in ("event_type", "weapon", "location", "heading", "incident_id"))))
    return of.withColumn("summary", text).orderBy("sec", "id")


def unprocessed(messages: DataFrame, n: int = 50) -> DataFrame:
    """Messages that wait to be parsed: processed = 0, the oldest first."""
    return messages.where("processed = 0").orderBy("timestamp", "id").limit(n)


def marked(messages: DataFrame, done: DataFrame) -> DataFrame:
    """Messages with ``processed`` set by (id, processed) where given: 1 done, 2 failed; a message's last mark is its greatest."""
    per = done.groupBy("id").agg(F.max("processed").alias("_now"))
    return messages.join(per, "id", "left").withColumn("processed", F.coalesce("_now", "processed")).drop("_now").select(messages.columns)


def assigned(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events with the incident that (event_id, incident_id) gives them; others keep theirs."""
    per = decisions.groupBy("event_id").agg(F.max("incident_id").alias("_to"))
    return events.join(per, "event_id", "left").withColumn("incident_id", F.coalesce("_to", "incident_id")).drop("_to").select(events.columns)


def patched(rows: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with partial updates in ``order``: a column takes its last value that was given (not null), if any."""
    columns = [c for c in rows.columns if c != key and c in updates.columns]
    last = updates.groupBy(key).agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns))
    return rows.join(last, key, "left").select([F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def merged_counts(held: DataFrame, new: DataFrame) -> DataFrame:
    """Counters (name, occurrence_count) with more of them: added where the name is held, else inserted."""
    return held.select("name", "occurrence_count").unionByName(new.select("name", "occurrence_count")).groupBy("name").agg(F.sum("occurrence_count").alias("occurrence_count"))


def flattened(events: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """Events as stored rows: each place as its raw name, lat and lng; of the rest, the columns ``kept``."""
    flat = [F.col(f"{p}.{f}").alias(f"{p}_{n}") for p in ("location", "heading", "via") for f, n in (("raw_name", "name"), ("lat", "lat"), ("lng", "lng"))]
    return events.select(*kept, *flat)


JSON_COLUMNS = {"source_channels": "array<string>", "trajectory": "array<struct<lat: double, lng: double, timestamp: bigint, name: string>>", "projection_anchor": "struct<lat: double, lng: double, timestamp: bigint, name: string>"}


def to_json_rows(incidents: DataFrame) -> DataFrame:
    """Incidents as stored rows: arrays and structs as JSON text."""
    return incidents.withColumns({c: F.to_json(c) for c in JSON_COLUMNS if c in incidents.columns})


def from_json_rows(rows: DataFrame) -> DataFrame:
    """Stored rows as incidents; broken JSON of an array is an empty one, of the anchor none."""
    empty = {c: F.array().cast(t) for c, t in JSON_COLUMNS.items() if t.startswith("array")}
    return rows.withColumns({c: F.coalesce(F.from_json(c, t), empty[c]) if c in empty else anchor(F.col(c)) for c, t in JSON_COLUMNS.items() if c in rows.columns})


def recent_live(rows: DataFrame, now: int, hours: int = 24, s: Settings = Settings()) -> DataFrame:
    """Stored incidents of the last hours as clients see them, the newest first."""
    return newest(live(from_json_rows(recent(rows, now, hours)), s))


def reset(incidents: DataFrame) -> DataFrame:
    """Changes (op, id) that end everything that is live."""
    return active(incidents).select(F.lit("expire").alias("op"), "id")


def can_project() -> Column:
    """Whether an incident's place can be carried on: active, moving, on its way, and updated at a known time."""
    return (F.col("status") == "active") & F.col("bearing_deg").isNotNull() & (F.col("speed_kmh") > 0) & F.coalesce(F.col("eta_seconds") > 0, F.lit(False)) & F.col("last_updated_at").isNotNull()


def shows_arrow() -> Column:
    return (F.size("trajectory") > 0) & (F.col("status") != "impact") & F.col("bearing_deg").isNotNull() & F.col("eta_seconds").isNotNull()


def level_map(levels: DataFrame) -> DataFrame:
    """One row: levels by district, as a payload has them; nulls are left out by its JSON."""
    return levels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "level")))).alias("levels"))


def panel(incidents: DataFrame) -> DataFrame:
    """Live incidents, the newest first, with what a list says of each: status, its label, the last named place or the heading's, and a note."""
    status = F.when(F.col("status").isin("impact", "expired"), F.col("status")).otherwise("active")
    last = F.try_element_at(F.col("trajectory"), F.lit(-1))["name"]
    place = F.coalesce(F.when(last != "", last), F.when(F.col("heading.name") != "", F.col("heading.name")), F.lit("—"))
    return newest(incidents.withColumns({"status_class": status, "status_label": lookup(status, STATUS_LABELS, ""), "place_name": place, "threat_note": lookup(F.col("weapon_type"), THREAT_NOTES, OTHER_NOTE)}))
