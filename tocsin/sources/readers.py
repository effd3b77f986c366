"""Reading messages, rings and changelogs; writing tables and changelogs."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_type

from tocsin.sources.shared import stored

MESSAGES = "id bigint, telegram_id bigint, reply_to_telegram_id bigint, grouped_id bigint, channel_id bigint, channel_name string, text string, timestamp bigint, received_at bigint, processed int"
CHANGELOG = "seq bigint, op string, id string, payload string"
#: A lexicon file: five lists.
LEXICON = {
    "location_dictionary": "canonical string, aliases array<string>, confidence double, notes string", "weapon_dictionary": "canonical string, aliases array<string>, confidence double",
    "phrase_patterns": "intent string, regex string", "top_ambiguous_terms": "term string, possible_mappings array<string>, priority string", "priority_hotspots": "canonical string, priority_rank double",
}
GAZETTEER = "canonical string, lat double, lng double, type string, parent string, aliases array<string>"


def messages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines of messages, as a table or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(MESSAGES).json(path)


def accepted(rows: DataFrame, channels: list[str]) -> DataFrame:
    """Messages of the subscribed channels that have a text."""
    return rows.where(F.col("channel_name").isin(*channels) & F.col("text").isNotNull() & (F.col("text") != ""))


def beyond(rows: DataFrame, marks: DataFrame, limit: int = 20) -> DataFrame:
    """A poll: per channel, the first ``limit`` messages beyond its mark (channel_id, last_id), oldest first."""
    new = rows.join(marks, "channel_id").where(F.col("telegram_id") > F.col("last_id")).drop("last_id").dropDuplicates(["channel_id", "telegram_id"])
    return new.withColumn("k", F.row_number().over(Window.partitionBy("channel_id").orderBy("telegram_id"))).where(F.col("k") <= limit).drop("k")


class PolledMessages(DataSource):
    """A stream that polls a folder of JSON lines per channel; its offset is the last id of each channel."""

    @classmethod
    def name(cls) -> str:
        return "polled_messages"

    def schema(self) -> str:
        return "channel_name string, telegram_id bigint, text string, timestamp bigint"

    def simpleStreamReader(self, schema):
        return _Poller(self.options["path"], int(self.options.get("limit", 20)))


class _Poller(SimpleDataSourceStreamReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def initialOffset(self) -> dict:
        return {}

    def _rows(self) -> list[tuple]:
        import glob
        import json

        out = []
        for f in sorted(glob.glob(f"{self.path}/*.json")):
            with open(f, encoding="utf-8") as lines:
                out += [(m["channel_name"], int(m["telegram_id"]), m.get("text") or "", int(m["timestamp"])) for m in map(json.loads, filter(str.strip, lines))]
        return sorted(set(out))

    def read(self, start: dict):
        end, taken, got = dict(start), {}, []
        for r in self._rows():
            if r[1] > int(start.get(r[0], -1)) and taken.get(r[0], 0) < self.limit:
                taken[r[0]] = taken.get(r[0], 0) + 1
                end[r[0]] = r[1]
                got.append(r)
        return iter(got), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([r for r in self._rows() if int(start.get(r[0], -1)) < r[1] <= int(end.get(r[0], -1))])


def lexicon(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five lists of a lexicon file (JSON), with ``ordinal``; a missing list is empty, missing aliases and mappings too, a missing confidence 1."""
    raw = spark.read.schema(", ".join(f"{k} array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ', 1) for x in t.split(', ')))}>>" for k, t in LEXICON.items())).option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    defaults = {"aliases": none, "possible_mappings": none, "confidence": F.lit(1.0)}
    out = {}
    for k in LEXICON:
        rows = raw.select(F.posexplode(k).alias("ordinal", "e")).select("ordinal", "e.*")
        out[k] = rows.withColumns({c: F.coalesce(c, d) for c, d in defaults.items() if c in rows.columns})
    return out


def gazetteer(spark: SparkSession, path: str, generated: DataFrame | None = None) -> DataFrame:
    """Places of a file of JSON lines, numbered in their order, with the aliases that a lexicon (canonical, aliases) adds."""
    rows = spark.read.schema(GAZETTEER).json(path).coalesce(1).withColumn("id", F.monotonically_increasing_id() + 1)  # one small file
    out = rows.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    if generated is not None:
        more = generated.groupBy("canonical").agg(F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("_more"))
        out = out.join(more, "canonical", "left").withColumn("aliases", F.array_union("aliases", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")
    return out.select("id", "canonical", "lat", "lng", "type", "parent", "aliases")


def united(pushed: DataFrame, polled: DataFrame, keys: tuple[str, ...] = ("channel_id", "telegram_id")) -> DataFrame:
    """Messages of both ways in, each once: that of the earlier arrival."""
    both = pushed.unionByName(polled, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    first = both.groupBy(*keys).agg(F.min(F.struct(*sorted(rest, key=lambda c: c != "received_at"))).alias("m"))
    return first.select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))


def snapshot(incidents: DataFrame, levels: DataFrame, seq: int) -> DataFrame:
    """What a client gets first: all live incidents, then the districts' levels (id, level), as changes of one seq."""
    shown = changelog(incidents.withColumn("_seq", F.lit(seq)), "snapshot", "_seq", "id")
    return shown.unionByName(levels.select(F.lit(seq).cast("bigint").alias("seq"), F.lit("risk").alias("op"), "id", F.to_json(F.struct("level")).alias("payload")))


def rings(spark: SparkSession, path: str, ids: dict[str, str]) -> DataFrame:
    """Named polygons of a GeoJSON file: id, ordinal, ring of struct(lng, lat). Other geometries and names go."""
    kind = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    f = spark.read.schema(kind).option("multiLine", True).json(path).select(F.posexplode("features").alias("ordinal", "f"))
    of = F.create_map(*(F.lit(x) for kv in ids.items() for x in kv))
    ring = F.transform(F.try_element_at(F.col("f.geometry.coordinates"), F.lit(1)), lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat")))
    return f.select(of[F.col("f.properties")["name"]].alias("id"), "ordinal", F.when(F.col("f.geometry.type") == "Polygon", ring).alias("ring")).where("id IS NOT NULL AND ring IS NOT NULL")


def ways_to_rings(members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Closed rings (relation, ring, ways, points) of relations, by list ranking over the ends of ways.

    members (relation, pos, way), ways (way, pos, node), nodes (node, lng, lat). Ways meet in the nodes at their ends,
    whatever their direction; where more than two ends meet, they are paired in the order of members. Each way is an arc
    in either direction, and an arc's successor goes on from the node where it ends; so each ring is two cycles, one a
    direction. A relation of at most ``WALKED`` ways is walked by a worker; in larger ones a cycle's smallest arc and each
    arc's distance to it are found by doubling: pointers go 1, 2, 4, ... arcs on, so a ring of n ways takes as many rounds as
    n has binary digits, of joins by relation and arc. A ring goes in the direction of its first member and begins there;
    ``ring`` is that member's pos. A relation may have several rings, holes too; ways that close no ring are in none. A ring's
    points are one row. Tables are exploded or read from files far smaller than their rows, so joins are told not to broadcast.
    """
    line = F.transform(F.sort_array(F.collect_list(F.struct("pos", "node", "lng", "lat"))), lambda p: F.struct(p["node"].alias("node"), p["lng"].alias("lng"), p["lat"].alias("lat")))
    of = ways.hint("merge").join(nodes, "node").groupBy("way").agg(line.alias("line"))
    lines = stored(members.withColumnRenamed("pos", "at").hint("merge").join(of, "way").where(F.size("line") > 1), "way-lines")
    joined = lines.where("relation IS NOT NULL AND at IS NOT NULL").select("relation", "at", F.element_at("line", 1)["node"].alias("first"), F.element_at("line", -1)["node"].alias("last"))
    large = stored(joined.groupBy("relation").count().where(F.col("count") > WALKED).select("relation"), "large-relations")  # one of so many ways at most
    left = _walked(joined.join(F.broadcast(large), "relation", "left_anti"))
    if not large.isEmpty():
        left = left.unionByName(_ranked(joined.join(F.broadcast(large), "relation", "left_semi")))
    laid = left.hint("merge").join(lines.select("relation", "at", "line"), ["relation", "at"]).select("relation", "least", "left", F.when(F.col("arc") % 2 == 0, F.col("line")).otherwise(F.reverse("line")).alias("line"))
    rest = lambda x: F.slice(x["line"], 2, F.size(x["line"]) - 1)
    of = laid.groupBy("relation", (F.col("least") / 2).cast("bigint").alias("ring")).agg(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("rank"), "line"))).alias("parts"))
    points = F.concat(F.slice(F.element_at("parts", 1)["line"], 1, 1), F.flatten(F.transform("parts", rest)))
    return of.select("relation", "ring", F.size("parts").alias("ways"), F.transform(points, lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("points"))


#: Ways of a relation that one worker holds to walk along its rings.
WALKED = 1 << 16
_RANKS = "arc bigint, at bigint, least bigint, left bigint"


def _successors(ways: list[tuple]) -> dict[int, int]:
    """Each arc's successor, of ways (at, first node, last node): ends that meet in a node are paired in the order of their arcs."""
    begins: dict = {}
    for at, first, last in ways:
        for arc, node in ((2 * at, first), (2 * at + 1, last)):
            if node is not None:
                begins.setdefault(node, []).append(arc)
    after = {}
    for arcs in begins.values():
        arcs.sort()
        for a, b in zip(arcs[::2], arcs[1::2], strict=False):
            after[a ^ 1], after[b ^ 1] = b, a  # a way's other arc ends where it begins
    return after


def _walked(ways: DataFrame) -> DataFrame:
    """(relation, arc, at, least, left): arcs on the rings of relations, in the direction of the ring's smallest arc, with how many are left of the ring."""
    kind = next(f.dataType for f in ways.schema if f.name == "relation").simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("relation", "at", "first", "last")), strict=True) for b in batches)
        out: list[tuple] = []
        for relation, of in groupby(rows, key=lambda r: r[0]):
            after, seen = _successors([r[1:] for r in of]), set()
            for least in sorted(after):
                cycle, arc = [], least
                while arc is not None and arc not in seen:
                    seen.add(arc)
                    cycle.append(arc)
                    arc = after.get(arc)
                if arc == least and cycle and least % 2 == 0:  # of both directions that of the first member
                    out += ((relation, a, a // 2, least, len(cycle) - 1 - k) for k, a in enumerate(cycle))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["relation", "arc", "at", "least", "left"]
    types = [to_arrow_type(ways.schema["relation"].dataType), *[pa.int64()] * 4]
    return ways.repartition("relation").sortWithinPartitions("relation").mapInArrow(run, f"relation {kind}, {_RANKS}")


def _ranked(ways: DataFrame) -> DataFrame:
    """The same by list ranking over all arcs."""
    ends = F.array(*(F.struct((F.col("at") * 2 + side).cast("bigint").alias("arc"), (F.col("at") * 2 + 1 - side).cast("bigint").alias("back"), F.col(at).alias("node")) for side, at in ((0, "first"), (1, "last"))))
    each = ways.select("relation", F.explode(ends).alias("e")).select("relation", "e.*")  # an arc, at the node where it begins; its way's other arc ends there
    by = Window.partitionBy("relation", "node").orderBy("arc")
    paired = each.withColumn("k", F.row_number().over(by)).withColumn("pair", F.floor((F.col("k") - 1) / 2))
    two = paired.select("relation", "node", "pair", "k", F.col("arc").alias("begins"), F.col("back").alias("ends"))
    other = two.select("relation", "node", "pair", F.col("k").alias("k2"), F.col("begins").alias("next"))
    arcs = stored(two.hint("merge").join(other, ["relation", "node", "pair"]).where("k <> k2").select("relation", F.col("ends").alias("arc"), "next"), "arcs")

    least = arcs.withColumn("least", F.least("arc", "next"))
    while True:  # the smallest arc among the next 2, 4, 8, ... arcs
        on = least.select("relation", F.col("arc").alias("next"), F.col("next").alias("then"), F.col("least").alias("low"))
        step = stored(least.hint("merge").join(on, ["relation", "next"], "left").select("relation", "arc", "then", F.least("least", "low").alias("least"), F.col("least").alias("old")), "arcs")
        least = step.select("relation", "arc", F.col("then").alias("next"), "least")
        if step.where("least <> old").isEmpty():
            break
    cycle = least.where("next IS NOT NULL AND least % 2 = 0").select("relation", "arc", "least")  # of both directions that of the first member
    left = arcs.hint("merge").join(cycle, ["relation", "arc"]).select("relation", "arc", "least", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"))
    left = stored(left.withColumn("left", F.col("next").isNotNull().cast("bigint")), "arcs")
    while not left.where("next IS NOT NULL").isEmpty():  # how many arcs are left of the ring
        on = left.select("relation", F.col("arc").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        left = stored(left.hint("merge").join(on, ["relation", "next"], "left").select("relation", "arc", "least", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "arcs")
    return left.select("relation", "arc", F.floor(F.col("arc") / 2).alias("at"), "least", "left")


def changelog(df: DataFrame, op: str, seq: str, key: str) -> DataFrame:
    """Rows as changes (seq, op, id, payload)."""
    return df.select(F.col(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*(c for c in df.columns if c[0] != "_"))).alias("payload"))


def applied(changes: DataFrame) -> DataFrame:
    """The table that a changelog leaves: since the last snapshot, each id's last change unless it expired.

    A snapshot is a set of rows of op ``snapshot`` with one seq.
    """
    last = changes.where("op = 'snapshot'").agg(F.max("seq").alias("s"))
    now = changes.where("op IN ('snapshot', 'new', 'update', 'expire')").join(F.broadcast(last), (F.col("seq") >= F.coalesce("s", F.lit(-1))))
    per = now.groupBy("id").agg(F.max_by(F.struct("op", "payload"), "seq").alias("c"), F.max("seq").alias("seq"))
    return per.where("c.op <> 'expire'").select("id", "seq", "c.payload")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
