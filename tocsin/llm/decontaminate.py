"""Benchmark decontamination: a prefix-filtered join of item windows with documents, by DataFrame functions alone.

A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window. A window occurs
in a document only if all its shingles do, so, for containment in full, its necessary prefix is the one shingle that is
rarest over all documents. Windows with a shingle that no document has are gone before any document is probed; the others
are looked up by that shingle at every position, kept if length and position leave room for the whole window, and compared
word by word.

Documents are never shuffled: windows are the stated query set, and go to the documents in blocks of a fixed number of
rows, each broadcast, so that neither a common passage nor a common word gathers documents in one task. Another block is
another scan of the documents.

Nulls: a null text has no words; a null ``doc_id`` is a document of its own. Items without an id mark words, but aren't
counted or listed; rows of equal ``item_id`` are one item. Equal rows (``doc_id`` and text) have equal results, one each;
rows that share only ``doc_id`` are told apart by their text. Empty tables give no rows, or rows without hits. A text is
one value of words while it is read, whatever its length.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: What stands between words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 3
#: Rows of windows, shingles or owners that are broadcast at once: at most about 64 MB of windows of ten words.
BLOCK_ROWS = 200_000
#: Words of a document whose hits are merged by one task.
SPAN = 1 << 16


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null: none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, GAP), "")


def shingle(of: Column, at: Column, size: int) -> Column:
    """A hash of ``size`` words from the (zero-based) position; only a filter, as matches are compared by words."""
    return F.xxhash64(*(F.get(of, at + k) for k in range(size)))


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, words): ``row`` tells rows apart by doc_id and text, and is never null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), words(text).alias("words"))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, window, words of the window): ``window`` is the words with spaces between, which no word contains."""
    items = benchmark.select("item_id", words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    each = items.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))).alias("s"))
    return each.select("item_id", F.slice("w", F.col("s"), size).alias("win")).select("item_id", F.array_join("win", " ").alias("window"), "win").distinct()


def blocks(df: DataFrame, n: int, by: str) -> list[DataFrame]:
    """The table, of ``n`` rows, in parts small enough to broadcast."""
    parts = math.ceil(n / BLOCK_ROWS)
    return [df] if parts <= 1 else [df.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k) for k in range(parts)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def prefixes(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(shingle, size, at, window, win): of each window that may occur its rarest shingle, and where in the window that is."""
    sized = wins.select("window", "win").distinct().withColumn("size", F.least(F.size("win"), F.lit(SHINGLE)))
    at = sized.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("win") - F.col("size"))))
    hashed = reduce(lambda c, k: c.when(F.col("size") == k, shingle(F.col("win"), F.col("at"), k)), range(1, SHINGLE + 1), F.when(F.lit(False), F.lit(0).cast("bigint")))
    grams = stored(at.select("window", "win", "size", "at", hashed.alias("shingle")), "item-shingles")
    per_size = {r["size"]: r["n"] for r in grams.groupBy("size").agg(F.countDistinct("shingle").alias("n")).collect()}
    counts = []
    for size, n in sorted(per_size.items()):
        here = docs.select("words", F.posexplode("words").alias("p", "_w")).select(shingle(F.col("words"), F.col("p"), size).alias("shingle"))
        for some in blocks(grams.where(F.col("size") == size).select("shingle").distinct(), n, "shingle"):
            counts.append(here.join(F.broadcast(some), "shingle", "left_semi").groupBy("shingle").count().withColumn("size", F.lit(size)))
    if not counts:
        return grams
    rare = F.min(F.struct("count", "shingle", "at")).alias("rare")
    found = grams.join(_union(counts), ["shingle", "size"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    best = found.groupBy("window", "size").agg(rare, F.first("win").alias("win")).where(F.col("rare.count") > 0)
    return best.select("rare.shingle", "size", "rare.at", "window", "win")


def hits(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(row, start, n, window): every occurrence of a window in the documents of ``keyed``, by its first word and its words."""
    rare = stored(prefixes(docs, wins), "rarest-shingles")
    per_size = {r["size"]: r["count"] for r in rare.groupBy("size").count().collect()}
    parts = []
    for size, n in sorted(per_size.items()):
        here = docs.select("row", "words", F.posexplode("words").alias("p", "_w")).withColumn("shingle", shingle(F.col("words"), F.col("p"), size)).drop("_w")
        for some in blocks(rare.where(F.col("size") == size).drop("size"), n, "window"):
            long = F.size("win")
            start = F.col("p") - F.col("at")
            room = (F.size("words") >= long) & (start >= 0) & (start + long <= F.size("words"))
            same = F.slice("words", F.greatest(start, F.lit(0)) + 1, long) == F.col("win")
            parts.append(here.join(F.broadcast(some), "shingle").where(room & same).select("row", start.cast("bigint").alias("start"), long.alias("n"), "window"))
    return _union(parts) if parts else docs.select("row", F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("n"), F.lit("").alias("window")).where("false")


def covered(found: DataFrame) -> DataFrame:
    """(row, n_hit): words inside any hit. Hits are cut at every ``SPAN`` words, and merged in each span apart."""
    ends = found.groupBy("row", "start").agg(F.max("n").alias("n")).withColumn("end", F.col("start") + F.col("n"))
    spans = F.sequence((F.col("start") / SPAN).cast("bigint"), ((F.col("end") - 1) / SPAN).cast("bigint"))
    cut = ends.withColumn("span", F.explode(spans)).select("row", "span", F.greatest("start", F.col("span") * SPAN).alias("a"), F.least("end", (F.col("span") + 1) * SPAN).alias("b"))
    before = Window.partitionBy("row", "span").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(before), F.lit(0))))
    return cut.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))


def owners(found: DataFrame, wins: DataFrame) -> DataFrame:
    """(row, item_id): the items with windows that occur in each document."""
    own = stored(wins.where("item_id IS NOT NULL").select("window", "item_id"), "window-owners")
    rows = found.select("row", "window").distinct()
    return _union([rows.join(F.broadcast(some), "window").select("row", "item_id") for some in blocks(own, own.count(), "item_id")]).distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs, wins = keyed(documents), stored(windows(benchmark, size), "windows")
    found = stored(hits(docs, wins), "hits")
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    listed = owners(found, wins).groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    marked = covered(found).join(listed, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return docs.select("row", "doc_id", F.size("words").cast("bigint").alias("n_words")).join(marked, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents, with all their columns, in which no window occurs."""
    docs = keyed(documents)
    found = hits(docs, stored(windows(benchmark, size), "windows")).select("row").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return documents.join(found, row == found["row"], "left_anti")
