"""Messages into typed events by ladders of patterns.

All captures of a message are columns of one projection; their distinct values are
resolved once; priorities are a coalesce over the resolved places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.functions import geo, text
from tocsin.operators.resolve import resolve_best_effort
from tocsin.plans.settings import HINTS, PHRASE_INTENTS, WEAPON_ALIASES, WEAPON_PATTERNS, Settings
from tocsin.sources.shared import stored

_I = "(?iu)"
# Patterns of the messages' language.
_END = "(?:[⚠💥,]|$)"
_END_LIST = "(?:[⚠💥]|$)"
_NAME = "[A-Za-zА-Яа-яІіЇїЄєЁё'’`.-]{2,}"
PATTERNS = {
    "via": (f"через\\s+(.+?)\\s+на\\s+(.+?){_END}", 2),
    "between": (f"между\\s+(.+?)\\s+и\\s+(.+?){_END}", 2),
    "blast": (f"взрыв[ыа]?\\s+в\\s+район[еу]?\\s+(.+?){_END}", 1),
    "range": ("в\\s+район[еу]?\\s+(.+?)\\s*[-–]\\s*(.+?)(?:[,⚠💥]|$)", 2),
    "area": ("в\\s+район[еу]?\\s+(.+?)(?:[,⚠💥]|$)", 1),
    "course": (f"курсо?м?\\s+(?:сейчас\\s+)?на\\s+(.+?){_END}", 1),
    "direction": (f"направлени[еия]\\s+(?:на\\s+)?(.+?){_END}", 1),
    "onward": (f"(?:лет(?:ит|ят)\\s+дальше|далее|далі|дальше|свернул(?:[аи]?)|сменил(?:[аи]?)\\s+курс)\\s+(?:на\\s+)?(.+?){_END}", 1),
    "toward": (f"(?:подлета(?:ет|ют)|лет(?:ит|ят)|двига(?:ется|ются)|бер[её]т?\\s+курс)\\s+к\\s+(.+?){_END}", 1),
    "to": (f"(?:^|\\s)к\\s+(.+?){_END}", 1),
    "enter": (f"залетают\\s+(?:на|в)\\s+(.+?){_END_LIST}", 1),
    "slash": (f"({_NAME}(?:\\s+{_NAME})?\\s*/\\s*{_NAME}(?:\\s+{_NAME})?)", 1),
    "on": (f"(?:^|\\s)на\\s+(.+?){_END}", 1),
}
FOLLOW_UP = "(?:^|\\s)(?:далее|дальше|далі|уже\\s+возле|вже\\s+біля|еще|ещё|ще)(?:$|\\s|[,.!?:;])"
ONE_MORE = "(?:^|\\s)\\+1(?![A-Za-z0-9_])"
COUNTS = ("(?:^|[\\s,🔴⚠])(\\d+)\\s+(?:Ударн\\S+\\s+)?(?:БпЛА|Шахед|ракет|дрон)", "(?:^|[\\s,])(\\d+)\\s+залетают", "(?:^|[\\s,])(\\d+)\\s+берут")
ON_PAIR = "(?:^|\\s)(?:на|курс(?:ом)?\\s+на|направлени[ея]\\s+на)\\s+[^\\n]*/"
CONTINUATION = "(?:^|\\s)(?:далее|далі|дальше|летит\\s+дальше|свернул(?:[аи]?)|змін(?:ив|или)\\s+курс)(?:$|\\s|[,.!?:;])"
HINTED = (
    f"(?:^|\\s)(?:далее|далі)\\s+на\\s+(.+?){_END}", f"курсо?м?\\s+(?:сейчас\\s+)?на\\s+(.+?){_END}", f"направлени[еия]\\s+(?:на\\s+)?(.+?){_END}",
    f"(?:лет(?:ит|ят)|двига(?:ется|ются)|бер[её]т?\\s+курс)\\s+на\\s+(.+?){_END}",
)
SYNTHETIC = "Incident last point"
# End of the fixed values.
#: What a text in lower case, with a space before it, can't lack if a pattern is found in it: one of these. A search for
#: them is far cheaper than the pattern, and most texts have none.
NEEDS = {
    "via": ("через",), "between": ("между",), "blast": ("взрыв",), "range": ("район",), "area": ("район",), "course": ("курс",), "direction": ("направлени",),
    "onward": ("дальше", "далее", "далі", "свернул", "сменил"), "toward": (" к ",), "to": (" к ",), "enter": ("залетают",), "slash": ("/",), "on": (" на ",),
    "followup": ("далее", "дальше", "далі", "уже возле", "вже біля", "еще", "ещё", "ще"), "one_more": ("+1",), "count0": ("бпла", "шахед", "ракет", "дрон"), "count1": ("залетают",), "count2": ("берут",), "explosion": ("взрыв", "💥"),
    "iskander": ("скандер",), "s300": ("300",), "kab": ("каб",), "missile": ("ракет",), "ballistic": ("баллист",), "rszo": ("рсзо",), "lancet": ("ланцет",), "fpv": ("fpv",), "molniya": ("молни",), "bpla": ("бпла", "дрон", "ударн"),
    "heading_change": ("довернул", "развернул", "взял", "повернул", "разогнулся"), "current_location": ("над", "кружит", "локационно"), "via_location": ("далее", "через", "вдоль окружной", "летит"),
    "continuation": ("снова", "опять на", "повторные пуски", "заходят на повторные"), "additional_unit": ("ещ", "новая шаболда"), "correction": ("upd", "это ", "предварительно "), "impact": ("упал", "сбили", "приземлили", "задавили"),
    "clear_status": ("не наблюдается", "фиксируется", "отбой", "чисто", "без угрозы", "вылетел"), "acoustic_observation": ("акустически",), "situational_summary": ("локационно", "по шаболдам", "по области"),
    "launch_alert": ("пуски по", "пусковых", "рсзо", "баллистике"),
}


def lowered(clean: Column) -> Column:
    """What NEEDS are looked for in."""
    return F.concat(F.lit(" "), F.lower(clean))


def has(low: Column, *words: str) -> Column:
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def guarded(low: Column | None, name: str, found: Column) -> Column:
    """``found``, a boolean, where it can be true at all."""
    return found if low is None else F.when(has(low, *NEEDS[name]), found).otherwise(F.lit(False))


def longest_alias(texts: Column, aliases: dict[str, tuple[str, ...]], short: int = 3) -> Column:
    """The key whose longest alias occurs in the text (the earlier key on ties); short aliases must stand alone."""
    return alias_in(F.lower(texts), aliases, short)


def alias_in(low: Column, aliases: dict[str, tuple[str, ...]], short: int = 3) -> Column:
    """The same, of a text in lower case."""
    found = []
    order = 0
    for key, names in aliases.items():
        for a in dict.fromkeys(n.lower() for n in names):
            if len(a) < 2:
                continue
            hit = low.contains(a)
            if len(a) <= short:
                hit = F.when(hit, low.rlike(f"{_I}(?:^|[^\\p{{L}}\\p{{N}}])\\Q{a}\\E(?:$|[^\\p{{L}}\\p{{N}}])")).otherwise(F.lit(False))
            found.append((len(a), -order, key, hit))
            order += 1
    out = F
    for _, _, key, hit in sorted(found, key=lambda x: (-x[0], -x[1])):
        out = out.when(hit, F.lit(key))
    return out.otherwise(F.lit(None).cast("string"))


def weapon(texts: Column, low: Column) -> Column:
    """Weapon type by alias, else by pattern, else unknown."""
    out = F
    for key, p in WEAPON_PATTERNS:
        out = out.when(guarded(low, key, texts.rlike(_I + p)), key)
    return F.coalesce(alias_in(low, WEAPON_ALIASES), out.otherwise("unknown"))


def intents(texts: Column, patterns: tuple[tuple[str, str], ...] = PHRASE_INTENTS, low: Column | None = None) -> Column:
    """All intents whose pattern is found, in the order of the patterns."""
    return F.array_compact(F.array(*(F.when(guarded(low, k, texts.rlike(_I + p)), F.lit(k)) for k, p in patterns)))


def hints(phrase_intents: Column, correction: Column, followup: Column, delta: Column) -> Column:
    """The intents and flags that bear on correlation, each once."""
    own = F.filter(phrase_intents, lambda x: x.isin(*HINTS))
    flags = F.array_compact(F.array(F.when(correction, F.lit("correction")), F.when(followup, F.lit("continuation")), F.when(delta > 0, F.lit("additional_unit"))))
    return F.array_union(own, flags)


def with_flags(df: DataFrame, clean: Column, low: Column) -> DataFrame:
    """Flags, event type, weapon, count and count delta of a text with plain spaces."""
    correction = low.startswith(" уточнение")
    kind = (
        F.when(guarded(low, "explosion", clean.rlike(_I + "взрыв[ыа]?\\s|💥")) | has(low, "упал"), "impact")
        .when(has(low, "отбой", "чисто", "відбій"), "all_clear").when(correction, "correction").otherwise("tracking")
    )
    number = F.coalesce(*(F.when(has(low, *NEEDS[f"count{k}"]), F.regexp_extract(clean, _I + p, 1)).try_cast("int") for k, p in enumerate(COUNTS)), F.lit(1))
    out = df.withColumns({
        "event_type": kind, "_detected": weapon(clean, low), "weapon_count": number, "is_preliminary": low.startswith(" предварительно"), "is_correction": correction,
        "is_followup": guarded(low, "followup", clean.rlike(_I + FOLLOW_UP)), "count_delta": F.when(guarded(low, "one_more", clean.rlike(_I + ONE_MORE)), 1).otherwise(0), "phrase_intents": intents(clean, low=low),
    })
    return out.withColumn("weapon_type", F.when((F.col("_detected") == "unknown") & has(low, "залетают"), "bpla").otherwise(F.col("_detected"))).drop("_detected")


def captures(slots: dict[str, tuple[str, int]]) -> dict[str, Column]:
    """Captures of ``clean`` by slot, trimmed, empty where the pattern isn't found; ``_low`` says where it may be."""
    return {k: F.when(has(F.col("_low"), *NEEDS[p]), F.trim(F.regexp_extract("clean", _I + PATTERNS[p][0], g))).otherwise("") for k, (p, g) in slots.items()}


def with_places(base: DataFrame, asked: dict[str, Column], gazetteer: DataFrame, ambiguous: dict[str, str] | None, settings: Settings, loose: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, ...) with maps ``asked`` and ``places`` by slot. Slots that aren't ``loose`` take no place that is put together from parts.

    The rows are computed once, into a table; distinct names are resolved and joined back.
    """
    slots = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, asked)), F.array(*asked.values())), lambda k, v: v.isNotNull() & (v != ""))
    base = base.withColumn("asked", slots).drop("clean", *(c for c in base.columns if c.startswith("_")))
    base = stored(base.withColumn("_row", F.monotonically_increasing_id()), "slots")
    pairs = base.select("_row", F.explode("asked").alias("slot", "raw"))
    places = resolve_best_effort(pairs.select("raw"), gazetteer, ambiguous, settings)
    usable = pairs.join(places, "raw").where(F.col("place").isNotNull() & (F.col("direct") | F.col("slot").isin(*loose)))
    by_slot = usable.groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("slot", "place"))).alias("places"))
    return base.join(by_slot, "_row", "left").drop("_row")


_SLOTS = {
    "via1": ("via", 1), "via2": ("via", 2), "between1": ("between", 1), "between2": ("between", 2), "blast": ("blast", 1), "range1": ("range", 1), "range2": ("range", 2), "area": ("area", 1),
    "course": ("course", 1), "direction": ("direction", 1), "onward": ("onward", 1), "toward": ("toward", 1), "to": ("to", 1), "enter": ("enter", 1), "slash": ("slash", 1), "on": ("on", 1),
}


def parse(messages: DataFrame, gazetteer: DataFrame, ambiguous: dict[str, str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """Events of messages (id, channel_name, text, timestamp); those without any signal have null event_type.

    Messages of id 0 or less, or without text, go; rows of one id are parsed each. ``filtered_out`` marks
    messages that must not be published; they are parsed and kept apart by the caller. The
    text itself isn't carried along. Messages are read once: what the patterns find in them
    goes into a table, from which distinct names are resolved.
    """
    base = messages.where("id > 0 AND text IS NOT NULL AND trim(text) <> ''").withColumn("clean", text.plain_spaces(F.col("text"))).withColumn("_low", lowered(F.col("clean")))
    base = with_flags(base.withColumn("filtered_out", text.contains_any(F.col("text"), settings.keywords)), F.col("clean"), F.col("_low"))
    base = base.withColumns({f"_{k}": c for k, c in captures(_SLOTS).items()}).drop("text")
    s = lambda k: F.col(f"_{k}")
    course, enter = F.split(s("course"), ",\\s*"), F.split(s("enter"), ",\\s*")
    bare = F.trim(F.regexp_replace("clean", "[⚠💥!.,;:]+", ""))
    asked = {k: s(k) for k in _SLOTS if k not in ("blast", "course", "toward", "to", "enter")} | {
        "blast": F.when(F.col("event_type") == "impact", s("blast")), "course1": F.trim(F.try_element_at(course, F.lit(1))), "toward": F.when(s("toward") != "", s("toward")).otherwise(s("to")),
        "enter1": F.trim(F.try_element_at(enter, F.lit(1))), "enter2": F.when(F.size(enter) > 1, F.trim(F.try_element_at(enter, F.lit(-1)))),
        "bare": F.when((F.length(bare) >= 3) & (F.size(F.split(bare, "\\s+")) <= 3), bare),
    }
    out = with_places(base, asked, gazetteer, ambiguous, settings, ("onward", "toward", "slash", "on", "bare"))
    p = lambda slot: F.try_element_at(F.col("places"), F.lit(slot))
    has_via = F.col("asked")["via1"].isNotNull()
    a, b = p("between1"), p("between2")
    middle = F.struct(
        F.concat_ws(" — ", F.col("asked")["between1"], F.col("asked")["between2"]).alias("raw_name"), F.concat_ws(" — ", a["canonical_name"], b["canonical_name"]).alias("canonical_name"),
        ((a["lat"] + b["lat"]) / 2).alias("lat"), ((a["lng"] + b["lng"]) / 2).alias("lng"), F.lit("composite").alias("type"), F.lit(None).cast("string").alias("parent"),
        F.lit("alias").alias("match_type"), (F.least(a["confidence"], b["confidence"]) * 0.9).alias("confidence"),
    )
    between = F.when(a.isNotNull() & b.isNotNull(), middle).otherwise(F.coalesce(a, b))
    placed = F.coalesce(between, p("blast"), p("range1"), p("area"))
    ranged = F.when(F.coalesce(between, p("blast")).isNull(), p("range2"))
    heading = F.coalesce(p("via2"), ranged, F.when(~has_via, F.coalesce(p("course1"), p("direction"), p("onward"), p("toward"))))
    entered = F.when(placed.isNull(), p("enter2"))
    out = out.withColumns({"via": p("via1"), "location": F.coalesce(placed, p("enter1"), p("slash")), "heading": F.coalesce(heading, entered)})
    nothing = F.col("location").isNull() & F.col("heading").isNull()
    out = out.withColumn("heading", F.when(nothing, p("on")).otherwise(F.col("heading")))
    nothing = F.col("location").isNull() & F.col("heading").isNull()
    out = out.withColumn("location", F.when(nothing, p("bare")).otherwise(F.col("location")))
    placed_at, headed = F.col("location").isNotNull(), F.col("heading").isNotNull()
    part = lambda cond, x: F.when(cond, x).otherwise(0.0)
    confidence = part(F.col("weapon_type") != "unknown", 0.3) + part((F.col("event_type") != "tracking") | placed_at | headed, 0.2) + part(placed_at, 0.2) + part(headed, 0.1)
    signal = (F.col("weapon_type") != "unknown") | placed_at | headed | (F.col("event_type") != "tracking")
    return out.withColumns({
        "confidence": F.least(F.lit(0.95), confidence * F.when(F.col("is_preliminary"), 0.8).otherwise(1.0)),
        "event_type": F.when(signal, F.col("event_type")), "event_id": F.sha2(F.concat_ws(":", F.lit("event"), "id"), 256),
    }).drop("asked", "places")


def routed(events: DataFrame, tracked: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Published events by way: those of tracked weapons to the correlator, the others, without all-clears, to districts."""
    public = events.where("event_type IS NOT NULL AND NOT filtered_out")
    return public.where(F.col("weapon_type").isin(*tracked)), public.where(~F.col("weapon_type").isin(*tracked) & (F.col("event_type") != "all_clear"))


MODEL_SCHEMA = "event_type string, weapon_type string, weapon_count int, location string, heading string, via string, is_preliminary boolean, is_correction boolean, confidence double, continues_incident_id string, continuation_confidence double, is_followup boolean, count_delta int"


def model_events(answers: DataFrame, active: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Events out of a model's JSON ``answer``: fences stripped, values checked, links kept only to active incidents.

    ``reason`` names what is wrong with an answer that can't be used: empty, invalid_json, or invalid_schema, which is JSON
    with a field of another type, without its event type or weapon, or with a value out of its range. A missing
    value, or null, is the default: a confidence of 0.5, one weapon, no change.
    """
    body = F.regexp_replace(F.trim("answer"), "^```(?:json)?\\s*|\\s*```$", "")
    read = F.from_json(body, f"{MODEL_SCHEMA}, _other string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_other"})
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")  # a parser stops at the end of a value; within brackets nothing may follow it
    e = answers.withColumns({"e": read, "_json": F.coalesce(F.size(alone) == 1, F.lit(False))})
    of = lambda c: F.col(f"e.{c}")
    within = lambda c, low, high: F.coalesce(of(c).between(low, high), F.lit(True))
    fits = of("_other").isNull() & of("event_type").isin("tracking", "impact", "correction", "all_clear") & of("weapon_type").isin(*WEAPON_ALIASES, "iskander", "unknown")
    fits = fits & within("confidence", 0, 1) & within("continuation_confidence", 0, 1) & within("weapon_count", 0, 1 << 30) & within("count_delta", 0, 1 << 30)
    reason = F.when(F.col("answer").isNull() | (F.trim("answer") == ""), "empty").when(~F.col("_json"), "invalid_json").when(~F.coalesce(fits, F.lit(False)), "invalid_schema")
    ids = active.select(F.col("id").alias("continues_incident_id"), F.lit(True).alias("live")).distinct()
    out = e.withColumn("reason", reason).select(*[c for c in answers.columns if c != "answer"], "reason", "e.*").drop("_other").join(ids, "continues_incident_id", "left")
    linked = F.coalesce("live", F.lit(False))
    return out.withColumns({
        "continues_incident_id": F.when(linked, F.col("continues_incident_id")), "continuation_confidence": F.when(linked, F.coalesce("continuation_confidence", F.lit(0.0))).otherwise(0.0),
        "weapon_count": F.greatest(F.coalesce("weapon_count", F.lit(1)), F.lit(1)), "count_delta": F.coalesce("count_delta", F.lit(0)), "confidence": F.coalesce("confidence", F.lit(0.5)) * 0.9,
        **{f: F.coalesce(f, F.lit(False)) for f in ("is_preliminary", "is_correction", "is_followup")},
    }).drop("live")


def incident_place(point: Column) -> Column:
    """An incident's point (lat, lng, name) as a place."""
    name = F.when(point["name"] != "", point["name"])
    return F.when(point.isNotNull(), F.struct(
        F.coalesce(name, F.lit("incident_last_point")).alias("raw_name"), F.coalesce(name, F.lit(SYNTHETIC)).alias("canonical_name"), point["lat"].alias("lat"), point["lng"].alias("lng"),
        F.lit("composite").alias("type"), F.lit(None).cast("string").alias("parent"), F.lit("alias").alias("match_type"), F.lit(0.45).alias("confidence"),
    ))


def incident_fallback(events: DataFrame, active: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Events with ``fallback``: what tracking events without any place take theirs from.

    That is the active incident that the event continues, by a confidence of ``fallback_link`` at
    least, else the newest one of its channel, if it is within the context window. ``active``
    has id, source_channels, last_updated_at, trajectory and heading; an incident without points is none.
    The newest of a channel is in the window if any is, so each channel sends one row.
    """
    i = active.select("id", "source_channels", "last_updated_at", F.struct("id", F.try_element_at("trajectory", F.lit(-1)).alias("last"), "heading").alias("fallback"))
    newest = i.select(F.explode("source_channels").alias("channel_name"), "*").groupBy("channel_name").agg(F.min(F.struct((-F.col("last_updated_at")).alias("age"), "id", "fallback")).alias("n"))
    asks = (F.col("event_type") == "tracking") & F.col("location").isNull() & F.col("heading").isNull() & F.col("via").isNull()
    out = events.withColumn("_link", F.when(asks & (F.col("continuation_confidence") >= settings.fallback_link), F.col("continues_incident_id")))
    out = out.join(i.select(F.col("id").alias("_link"), F.col("fallback").alias("_linked")), "_link", "left").join(newest.select("channel_name", "n"), "channel_name", "left")
    near = F.when(F.col("timestamp") + F.col("n.age") <= settings.context_window, F.col("n.fallback"))
    found = F.coalesce("_linked", near)
    return out.withColumn("fallback", F.when(asks & found["last"].isNotNull(), found)).select(*events.columns, "fallback")


def pair_place(raw: Column, left: Column, right: Column) -> Column:
    """The middle of two places, as a place."""
    return F.struct(
        raw.alias("raw_name"), F.concat_ws(" / ", left["canonical_name"], right["canonical_name"]).alias("canonical_name"), ((left["lat"] + right["lat"]) / 2).alias("lat"), ((left["lng"] + right["lng"]) / 2).alias("lng"),
        F.lit("composite").alias("type"), F.coalesce(left["parent"], right["parent"]).alias("parent"), F.lit("alias").alias("match_type"), F.greatest(F.lit(0.35), F.least(left["confidence"], right["confidence"]) * 0.85).alias("confidence"),
    )


def approach_place(raw: Column, left: Column, right: Column, settings: Settings = Settings()) -> Column:
    """A point before the middle of two places, on the side of the approach anchor: 1.1 spans away, 6 to 14 km."""
    mid = pair_place(raw, left, right)
    km = F.least(F.lit(14.0), F.greatest(F.lit(6.0), geo.haversine_km(left["lat"], left["lng"], right["lat"], right["lng"]) * 1.1))
    anchor = [F.lit(x) for x in settings.approach_anchor]
    at = geo.destination(mid["lat"], mid["lng"], geo.bearing(mid["lat"], mid["lng"], *anchor), km)
    return F.struct(
        mid["raw_name"].alias("raw_name"), F.concat(mid["canonical_name"], F.lit(" (approach)")).alias("canonical_name"), at["lat"].alias("lat"), at["lng"].alias("lng"),
        F.lit("composite").alias("type"), mid["parent"].alias("parent"), F.lit("alias").alias("match_type"), F.greatest(F.lit(0.42), mid["confidence"] * 0.92).alias("confidence"),
    )


def placed_events(answers: DataFrame, gazetteer: DataFrame, active: DataFrame, ambiguous: dict[str, str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """Events of a model with resolved places: ``location``, ``heading`` and ``via`` become places.

    ``answers`` has what model_events() gives with id, text, channel_name and timestamp. A pair "X/Y"
    in the text is the middle of both, or a point before it if the text says "on X/Y"; one of
    the two fills in for a missing place. Tracking events without a place take an
    incident's, and only a heading if the text names one. ``reason`` is tracking_without_geo where even that lacks.
    """
    clean = text.plain_spaces(F.col("text"))
    base = answers.withColumns({"clean": clean, "_pair": F.regexp_extract("text", PATTERNS["slash"][0], 1), "on_pair": F.col("text").rlike(_I + ON_PAIR), "_intents": intents(clean)})
    cue = F.arrays_overlap("_intents", F.array(F.lit("continuation"), F.lit("heading_change"))) | clean.rlike(_I + CONTINUATION)
    sides = F.filter(F.transform(F.split("_pair", "/"), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.size(sides) >= 2
    base = base.withColumns({"cue": cue, "_left": F.when(whole, sides[0]), "_right": F.when(whole, sides[1]), **{f"_hint{k}": F.trim(F.regexp_extract("clean", _I + h, 1)) for k, h in enumerate(HINTED)}})
    asked = {"location": F.col("location"), "heading": F.col("heading"), "via": F.col("via"), "left": F.col("_left"), "right": F.col("_right"), **{f"hint{k}": F.col(f"_hint{k}") for k in range(len(HINTED))}}
    out = with_places(base.drop("text"), asked, gazetteer, ambiguous, settings, tuple(asked))
    p = lambda slot: F.try_element_at(F.col("places"), F.lit(slot))
    out = out.withColumns({"location": p("location"), "heading": p("heading"), "via": p("via"), "_l": p("left"), "_r": p("right")})
    raw = F.concat_ws(" / ", F.col("asked")["left"], F.col("asked")["right"])
    both, pair = F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.col("asked")["left"].isNotNull()
    middle = pair_place(raw, F.col("_l"), F.col("_r"))
    nowhere = F.col("heading").isNull() & F.col("location").isNull()
    location = F.when(both & F.col("on_pair"), approach_place(raw, F.col("_l"), F.col("_r"), settings)).when(both, middle).when(pair & nowhere, F.coalesce("_l", "_r")).otherwise(F.col("location"))
    heading = F.when(both, F.coalesce("heading", middle)).when(pair & ~nowhere, F.coalesce("heading", "_r", "_l")).otherwise(F.col("heading"))
    out = incident_fallback(out.withColumns({"location": location, "heading": heading}), active, settings)
    taken, hint = F.col("fallback").isNotNull(), F.coalesce(*(p(f"hint{k}") for k in range(len(HINTED))))
    synthetic = lambda x: F.coalesce((x["canonical_name"] == SYNTHETIC) | (x["raw_name"] == "incident_last_point"), F.lit(False))
    out = out.withColumns({"location": F.when(taken, incident_place(F.col("fallback.last"))).otherwise(F.col("location")), "heading": F.when(taken, incident_place(F.col("fallback.heading"))).otherwise(F.col("heading"))})
    only = (F.col("event_type") == "tracking") & synthetic(F.col("location")) & (F.col("heading").isNull() | synthetic(F.col("heading"))) & F.col("cue") & hint.isNotNull()
    lacks = (F.col("event_type") == "tracking") & F.col("location").isNull() & F.col("heading").isNull() & F.col("via").isNull()
    out = out.withColumns({"_only": only, "heading": F.when(only, hint).otherwise(F.col("heading")), "reason": F.coalesce("reason", F.when(lacks, "tracking_without_geo"))})
    return out.withColumn("location", F.when(~F.col("_only"), F.col("location"))).drop("_only", "_l", "_r", "asked", "places", "on_pair", "cue", "fallback")


def compact(incidents: DataFrame) -> DataFrame:
    """What a model is told of an incident: id, weapon, last point, heading, last update."""
    return incidents.select("id", "weapon_type", F.try_element_at("trajectory", F.lit(-1)).alias("last"), F.col("heading.name").alias("heading"), "last_updated_at")


def answered(messages: DataFrame, call: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """Messages with ``answer``: what a model says of each text. ``call`` gets a batch of texts; where it fails, the batch's answers are null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                answers = call(f["text"].tolist())
            except Exception:  # whatever a model's client raises; the other parser takes over
                answers = [None] * len(f)
            yield f.assign(answer=pd.Series(answers, index=f.index, dtype=object))

    return messages.mapInPandas(run, T.StructType([*messages.schema.fields, T.StructField("answer", T.StringType())]))


