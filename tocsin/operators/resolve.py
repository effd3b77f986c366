"""Place names against a gazetteer: exact, then substring, then fuzzy.

Each stage sees only the distinct names that the stage before left, and each is an equi-join,
so neither names nor gazetteer are ever paired as a whole: substrings meet by three letters in
common, near spellings by a piece in common. Spark broadcasts a side if it turns out small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions import geo, text
from tocsin.plans.settings import AMBIGUITY_WEIGHTS, Settings
from tocsin.sources.shared import stored

#: Edits up to which a spelling is near, and the pieces that an alias is cut into: an edit changes two of them at most.
EDITS, PIECES = 2, 5


def alias_index(gazetteer: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per canonical name and alias: norm, ordinal and the entry with its nearness."""
    km = geo.haversine_km(F.col("lat"), F.col("lng"), *settings.center)
    near = F.coalesce(F.col("parent").isin(settings.city, settings.region) | F.col("parent").contains(settings.community), F.lit(False)) | (km <= settings.nearby_km)
    names = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = gazetteer.select("id", "canonical", "lat", "lng", "type", "parent", near.alias("nearby"), (1 / (1 + km)).alias("proximity"), F.posexplode(names).alias("pos", "name"))
    first = rows.groupBy(text.normalize(F.col("name")).alias("norm"), "canonical").agg(F.min(F.struct("id", "pos", "lat", "lng", "type", "parent", "nearby", "proximity")).alias("e"))
    return first.select("norm", "canonical", "e.*")


def _trigrams(x: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))


def containing(left: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of names (norm) and entries (alias) of which one contains the other; the shorter has three letters at least.

    The first three letters of the shorter are somewhere in the longer.
    """
    names, entries = left.where(F.length("norm") >= 3), index.where(F.length("alias") >= 3)
    first = lambda c: F.substring(c, 1, 3).alias("letters")
    whole = names.select("*", F.explode(_trigrams(F.col("norm"))).alias("letters")).join(entries.select("*", first("alias")), "letters").where(F.col("norm").contains(F.col("alias")))
    part = names.select("*", first("norm")).join(entries.select("*", F.explode(_trigrams(F.col("alias"))).alias("letters")), "letters").where(F.col("alias").contains(F.col("norm")) & (F.col("alias") != F.col("norm")))
    return whole.unionByName(part).drop("letters")


def _piece(x: Column, size: Column, k: Column, shift: Column) -> Column:
    """What stands in ``x`` where the k-th piece of a word of ``size`` letters would be, moved by ``shift``; null outside of x."""
    start, end = F.floor(k * size / PIECES), F.floor((k + 1) * size / PIECES)
    at = start + shift
    return F.when((at >= 0) & (end + shift <= F.length(x)), F.substring(x, (at + 1).cast("int"), (end - start).cast("int")))


def near_spellings(left: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of names (norm) and entries (alias) with at most EDITS edits between them, and their number ``d``.

    An edit is in one piece of the alias or at the border of two, so one of five pieces is whole and is found in the
    name, moved by two letters at most. An alias of fewer letters than pieces is found by a letter that it shares, as two
    edits leave one unless both words have two letters at most; such pairs are all near.
    """
    alias, norm = F.col("alias"), F.col("norm")
    key = lambda size, k, piece: F.struct(size.cast("int").alias("size"), k.cast("bigint").alias("k"), piece.alias("piece"))
    pieces = lambda size, shifts, x: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.transform(shifts, lambda s: key(size, k, _piece(x, size, k, s)))))
    shared = lambda size, x: F.concat(F.transform(F.array_distinct(F.split(x, "")), lambda c: key(size, F.lit(-1), c)), F.when((F.length(x) <= EDITS) & (size <= EDITS), F.array(key(size, F.lit(-2), F.lit("")))).otherwise(F.slice(F.array(key(size, F.lit(-2), F.lit(""))), 1, 0)))
    keys = lambda size, shifts, x: F.when(size >= PIECES, pieces(size, shifts, x)).otherwise(shared(size, x))
    own = index.where(F.length(alias) > 0).select("*", F.explode(keys(F.length(alias), F.array(F.lit(0)), alias)).alias("key"))
    sizes = F.sequence(F.greatest(F.length(norm) - EDITS, F.lit(1)), F.length(norm) + EDITS)
    asked = F.filter(F.array_distinct(F.flatten(F.transform(sizes, lambda size: keys(size, F.sequence(F.lit(-EDITS), F.lit(EDITS)), norm)))), lambda x: x["piece"].isNotNull())
    met = left.select("*", F.explode(asked).alias("key")).join(own, "key").drop("key").where(F.levenshtein("norm", "alias", 2 * EDITS) >= 0)
    return met.dropDuplicates(["raw", "alias", "canonical"]).withColumn("d", text.osa_distance("norm", "alias")).where(F.col("d") <= EDITS)


def candidate_score(query: Column, alias: Column, nearby: Column, proximity: Column, penalty: Column | float = 0.0) -> Column:
    q, a = F.size(text.tokens(query)), F.size(text.tokens(alias))
    qualified = F.when((q > 1) & (a > 1) & (a >= q), 0.3).otherwise(0.0)
    return text.lexical_score(query, alias) * 2.1 + qualified + F.when(nearby, 0.25).otherwise(0.0) + proximity - penalty


def resolve(names: DataFrame, gazetteer: DataFrame, ambiguous: dict[str, str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """For distinct ``raw`` names: the resolved place (null: none) as struct ``place``."""
    index = alias_index(gazetteer, settings)
    asked = stored(names.select("raw").where("raw IS NOT NULL AND trim(raw) <> ''").distinct().withColumn("norm", text.normalize(F.col("raw"))), "names")
    penalty = F.lit(0.0)
    for term, level in (ambiguous or {}).items():
        penalty = F.when(F.col("norm") == text.normalize(F.lit(term)), AMBIGUITY_WEIGHTS[level]).otherwise(penalty)

    def best(matches: DataFrame, kind: Column, confidence: Column) -> DataFrame:
        """The entry of the highest score, then of the first name."""
        score = candidate_score(F.col("norm"), F.col("alias"), F.col("nearby"), F.col("proximity"), penalty)
        per = matches.withColumn("score", score).groupBy("raw", "norm", "canonical").agg(F.max("score").alias("score"), F.min(F.struct("id", "pos", "lat", "lng", "type", "parent")).alias("e"))
        ranked = per.withColumn("n", F.count("*").over(Window.partitionBy("raw"))).withColumn("k", F.row_number().over(Window.partitionBy("raw").orderBy(F.desc("score"), F.expr("collate(canonical, 'uk')"))))
        return ranked.where("k = 1").select("raw", F.struct(F.col("raw").alias("raw_name"), F.col("canonical").alias("canonical_name"), "e.lat", "e.lng", "e.type", "e.parent", kind.alias("match_type"), confidence.alias("confidence")).alias("place"))

    exact = asked.join(index.withColumn("alias", F.col("norm")), "norm")
    found = best(exact, F.when(text.normalize(F.col("canonical")) == F.col("norm"), "exact").otherwise("alias"), F.lit(0.95))
    left = asked.join(found.select("raw"), "raw", "left_anti")
    other = index.withColumnRenamed("norm", "alias")
    found2 = best(containing(left, other), F.lit("alias"), F.when(F.col("n") == 1, 0.8).otherwise(0.75))
    left = left.join(found2.select("raw"), "raw", "left_anti")
    first = near_spellings(left, other).groupBy("raw").agg(F.min(F.struct("d", "id", "pos", "canonical", "lat", "lng", "type", "parent")).alias("m"))
    found3 = first.select("raw", F.struct(F.col("raw").alias("raw_name"), F.col("m.canonical").alias("canonical_name"), "m.lat", "m.lng", "m.type", "m.parent", F.lit("fuzzy").alias("match_type"), F.when(F.col("m.d") == 1, 0.7).otherwise(0.55).alias("confidence")).alias("place"))
    return asked.select("raw").join(found.unionByName(found2).unionByName(found3), "raw", "left")


def resolve_best_effort(names: DataFrame, gazetteer: DataFrame, ambiguous: dict[str, str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """resolve(), and for names that it leaves, the places of their parts: one, or their mean. ``direct``: the place is resolve()'s."""
    parts = names.select("raw").distinct().withColumn("part", F.explode(F.array_union(F.array("raw"), text.split_places(F.col("raw")))))
    known = resolve(parts.select(F.col("part").alias("raw")), gazetteer, ambiguous, settings).withColumnRenamed("raw", "part")
    per = parts.join(known, "part", "left").withColumn("k", F.array_position(text.split_places(F.col("raw")), F.col("part")))
    many = per.where("place IS NOT NULL").groupBy("raw").agg(
        F.first(F.when(F.col("part") == F.col("raw"), F.col("place")), True).alias("direct"),
        F.sort_array(F.collect_list(F.when(F.col("k") > 0, F.struct("k", "place")))).alias("places"),
    )
    p = F.transform("places", lambda x: x["place"])
    mean = lambda f: F.aggregate(p, F.lit(0.0), lambda s, x: s + x[f]) / F.size(p)
    top = F.element_at(F.array_sort(p, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0)), 1)
    fields = ("canonical_name", "lat", "lng", "type", "parent", "match_type")
    one = F.struct(F.col("raw").alias("raw_name"), *(F.element_at(p, 1)[f].alias(f) for f in fields), F.greatest(F.lit(0.35), F.element_at(p, 1)["confidence"] * 0.85).alias("confidence"))
    composite = F.struct(
        F.col("raw").alias("raw_name"), F.array_join(F.transform(p, lambda x: x["canonical_name"]), " / ").alias("canonical_name"), mean("lat").alias("lat"), mean("lng").alias("lng"),
        F.lit("composite").alias("type"), top["parent"].alias("parent"), F.lit("alias").alias("match_type"), F.greatest(F.lit(0.3), F.least(F.lit(0.8), top["confidence"] * 0.8)).alias("confidence"),
    )
    out = many.select("raw", F.when(F.col("direct").isNotNull(), F.col("direct")).when(F.size(p) == 1, one).when(F.size(p) > 1, composite).alias("place"), F.col("direct").isNotNull().alias("direct"))
    return names.select("raw").distinct().join(out, "raw", "left")


def unmatched(resolved: DataFrame) -> DataFrame:
    """How often each name was asked for in vain."""
    return resolved.where("place IS NULL").groupBy(F.col("raw").alias("name")).agg(F.count("*").alias("occurrence_count"))


def known_names(gazetteer: DataFrame) -> DataFrame:
    """Canonical names, each once, in order of first appearance."""
    return gazetteer.groupBy("canonical").agg(F.min("id").alias("ordinal")).orderBy("ordinal")


def runtime_corpus(gazetteer: DataFrame) -> DataFrame:
    """Canonical names with their normalised form and sorted distinct normalised aliases."""
    norms = F.array_sort(F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: text.normalize(a))))
    return gazetteer.select("canonical", text.normalize(F.col("canonical")).alias("normalized_canonical"), norms.alias("normalized_aliases")).orderBy(F.expr("collate(canonical, 'uk')"))
