"""Building and checking a lexicon of names and their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions import text
from tocsin.plans.settings import AMBIGUITY_WEIGHTS, SPEED_KMH


def problems(lists: dict[str, DataFrame]) -> DataFrame:
    """(list, ordinal, problem) of a lexicon's rows that can't be used; a row may have several."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    empty = lambda c: F.exists(c, lambda x: F.coalesce(x == "", F.lit(True)))
    named = {"canonical is empty": blank("canonical"), "an alias is empty": empty("aliases"), "confidence is not from 0 to 1": ~F.col("confidence").between(0, 1)}
    rank = F.col("priority_rank")
    rules = {
        "location_dictionary": named, "weapon_dictionary": named | {"canonical is no weapon": ~F.col("canonical").isin(*SPEED_KMH)},
        "phrase_patterns": {"intent is empty": blank("intent"), "regex is empty": blank("regex")},
        "top_ambiguous_terms": {"term is empty": blank("term"), "a mapping is empty": empty("possible_mappings"), "priority is none": ~F.coalesce(F.col("priority").isin(*AMBIGUITY_WEIGHTS), F.lit(False))},
        "priority_hotspots": {"canonical is empty": blank("canonical"), "priority_rank is no positive integer": ~F.coalesce((rank > 0) & (rank == F.floor(rank)), F.lit(False))},
    }
    out = None
    for k, of in rules.items():
        found = lists[k].select(F.lit(k).alias("list"), "ordinal", F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(p)) for p, bad in of.items())))).alias("problem"))
        out = found if out is None else out.unionByName(found)
    return out


def usable(lists: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A lexicon's lists without the rows that have a problem."""
    bad = problems(lists).select("list", "ordinal").distinct()
    return {k: rows.join(bad.where(F.col("list") == k).select("ordinal"), "ordinal", "left_anti") for k, rows in lists.items()}


def ranked_hotspots(hotspots: DataFrame) -> DataFrame:
    return hotspots.orderBy("priority_rank", "ordinal")


def mismatch_groups(items: DataFrame, groups: int = 30, each: int = 5) -> DataFrame:
    """The largest groups of (canonical, alias): rank, canonical, size and their first aliases."""
    of = items.groupBy("canonical").agg(F.count("*").alias("size"))
    top = of.orderBy(F.desc("size"), "canonical").limit(groups).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "canonical")))  # ``groups`` rows
    shown = items.join(top.select("canonical"), "canonical", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("canonical").orderBy("alias"))).where(F.col("k") <= each)
    some = shown.groupBy("canonical").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return top.join(some, "canonical").select("rank", "canonical", "size", "aliases")


def low_confidence(lexicon: DataFrame, least: float = 0.7, allowed: tuple[str, ...] = ()) -> DataFrame:
    return lexicon.where((F.col("confidence") < least) & ~F.col("canonical").isin(*allowed) if allowed else F.col("confidence") < least)


def owned_aliases(lexicon: DataFrame) -> DataFrame:
    """One row per canonical and normalised alias."""
    return lexicon.select("canonical", "confidence", F.explode("aliases").alias("alias")).withColumn("alias", text.normalize_alias(F.col("alias"))).where("alias <> ''").dropDuplicates(["canonical", "alias"])


def collisions(lexicon: DataFrame, listed: DataFrame | None = None, severe: float = 0.9) -> DataFrame:
    """Aliases of several canonicals; an error if one is sure of it and the alias isn't listed as ambiguous."""
    per = owned_aliases(lexicon).groupBy("alias").agg(F.count_distinct("canonical").alias("owners"), F.max("confidence").alias("confidence")).where("owners > 1")
    known = per.withColumn("listed", F.lit(False)) if listed is None else per.join(listed.select(text.normalize_alias(F.col("term")).alias("alias"), F.lit(True).alias("listed")).distinct(), "alias", "left")
    return known.select("alias", "owners", F.when(F.coalesce("listed", F.lit(False)) | (F.col("confidence") < severe), "warning").otherwise("error").alias("severity"))


def sorted_unique(names: DataFrame, value: str, ordinal: str) -> DataFrame:
    """The first spelling of each normalised value, in Ukrainian order."""
    norm = text.normalize_alias(F.col(value))
    first = names.withColumn("norm", norm).where("norm <> ''").withColumn("k", F.row_number().over(Window.partitionBy("norm").orderBy(ordinal))).where("k = 1")
    return first.select(value).orderBy(F.expr(f"collate({value}, 'uk')"))


def missing(expected: DataFrame, present: DataFrame, equivalent: DataFrame | None = None) -> DataFrame:
    """Canonicals that the corpus lacks, and so does every name that stands for the same."""
    left = expected.select("canonical").distinct().join(present.select("canonical"), "canonical", "left_anti")
    if equivalent is None:
        return left
    covered = equivalent.join(present.select(F.col("canonical").alias("stands_for")), "stands_for").select("canonical")
    return left.join(covered, "canonical", "left_anti")


def coverage(expected: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per canonical: how many of its aliases resolve to it, to another, or to nothing."""
    of = expected.join(resolved, "alias", "left")
    right = F.col("found") == F.col("canonical")
    return of.groupBy("canonical").agg(F.count_if(right).alias("right"), F.count_if(F.col("found").isNotNull() & ~right).alias("wrong"), F.count_if(F.col("found").isNull()).alias("unresolved"))


def merged_aliases(seed: DataFrame, generated: DataFrame) -> DataFrame:
    """Seed entries with the generated aliases of their canonical."""
    more = generated.groupBy("canonical").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("more"))
    return seed.join(more, "canonical", "left").withColumn("aliases", F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>")))).drop("more")
