"""An exact self-join of documents by the Jaccard similarity of their word n-grams.

1. Documents of equal n-gram sets form a class; one member stands for it.
2. The document frequency of every n-gram over the classes is counted; those of at
   least two form a store. The global order of n-grams runs from rare to frequent (by
   the binary logarithm of the frequency, then by hash) and is cut into fragments of
   about equal mass.
3. Two sets of similarity t share one of the first n - ceil(t * n) + 1 n-grams of each
   in that order, so only sets with a shared n-gram there can have a partner. Their
   sets are kept, cut vertically into one segment per fragment.
4. For a candidate pair, each fragment's overlap is counted separately, and the sums
   per pair decide. Links need only tell components apart, so the pairs come in two
   waves: neighbours in each n-gram's list, in an order of its own; then, for n-grams
   whose lists still hold several components, all pairs across components. A pair goes
   on only if its sets can link by their sizes and by the most that they can share,
   from the numbers of their shared n-grams in parts of the hash range. A group of near
   copies becomes one component in the first wave without all of its pairs, and
   no pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, id_and_text, rows, shared_dir, spread_join, stored, tune
from .hashstore import RUNS, Store, bucket_starts, buckets_for, cut, hash_words, joined, merge_buckets, merged, mix, summed

#: N-gram hashes that a task holds before it sends them on.
HELD = 4_000_000
#: Fragments of the global order.
FRAGMENTS = 4
#: Neighbours that the first wave tries on each n-gram's list.
NEIGHBOURS = 3
#: Parts of the hash range by which a set's shared n-grams are counted, to bound overlaps.
CELLS = 32
#: Entries of one n-gram's list that the first wave orders together, and those of it that one task of the second wave holds. A
#: longer list is cut otherwise for every n-gram, so that the parts of a group meet on another one.
LIST, CROSS = 1024, 512


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's n-grams of words (A-Z in lower case); fewer words: all as one."""
    cuts = [t.lower().split() for t in texts]
    n = [len(c) for c in cuts]
    words = mix(hash_words([w for c in cuts for w in c]))
    grams = mix(words)  # so that the first two words aren't alike
    for k in range(1, size):
        grams[: len(words) - k] = mix(grams[: len(words) - k] + words[k:]) if len(words) > k else grams[:0]
    out, at = [], 0
    for m in n:
        if m >= size:
            s = np.sort(grams[at : at + m - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif m:
            short = mix(words[at : at + 1])
            for k in range(1, m):
                short = mix(short + words[at + k : at + k + 1])
            out.append(mix(short + np.uint64(m)))
        else:
            out.append(np.empty(0, np.uint64))
        at += m
    return out


def signature(s: np.ndarray) -> bytes:
    """A set's digest of 128 bits, which names its class."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary())])
SETS = "doc_id bigint, n bigint, cls binary"


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(byte_texts(b), size)
            yield rows(_SETS, b.column("doc_id"), [len(s) for s in sets], [signature(s) for s in sets])

    return run


def _send_copies(bits: int):
    starts = bucket_starts(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, other = _halves(b.column("cls").to_pylist())
            order = np.argsort(keys)
            yield cut(keys[order], [other[order], b.column("rep").to_numpy().astype(np.int64).view(np.uint64)[order]], starts)

    return run


def _write_copies(store: Store):
    def task(bucket: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, columns = joined(table)
        keys, first, m = np.unique(keys, return_index=True, return_counts=True)
        one = m == 1  # classes that agree in half a digest are left out: all their copies stand for them, which changes no result
        store.write(bucket, keys[one], [c[first[one]] for c in columns])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64())})

    return task


def _standing(copies: Store, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Of each batch: the classes that a row of it stands for, and their sets."""
    for b in batches:
        sets = shingle_sets(byte_texts(b), size)
        names = [signature(s) for s in sets]
        keys, other = _halves(names)
        place, (same, rep), _ = copies.find(keys)
        ids = b.column("doc_id").to_pylist()
        lone, rep = ((place < 0) | (same != other)).tolist(), rep.view(np.int64).tolist()
        good = [k for k, s in enumerate(sets) if len(s) and ids[k] is not None and (lone[k] or rep[k] == ids[k])]
        yield [names[k] for k in good], [sets[k] for k in good]


def _count(copies: Store, size: int, bits: int):
    starts = bucket_starts(bits)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return cut(keys, [n.astype(np.uint64)], starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for _, sets in _standing(copies, size, batches):
            held += sets
            n += sum(map(len, sets))
            if n > HELD:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    return run


def _write_counts(store: Store):
    def task(bucket: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, (n,) = merged(table)
        shared = n > 1
        keys, n = keys[shared], n[shared]
        store.write(bucket, keys, [n])
        # mass by frequency class and by the hash's place within the whole range
        level, mass = np.floor(np.log2(n.astype(np.float64))).astype(np.uint64), n
        cell, (mass,) = summed((level << np.uint64(8)) | (keys >> np.uint64(56)), [mass]) if len(keys) else (keys, (n,))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket] * max(len(cell), 1), pa.int64()), "cell": pa.array(cell.astype(np.int64).tolist() or [None], pa.int64()), "mass": pa.array(mass.astype(np.int64).tolist() or [0], pa.int64())})

    return task


def fragment_cells(mass: dict[int, int], fragments: int) -> list[int]:
    """The first cells of fragments 1, 2, ... of a global order whose cells have these masses."""
    total, so_far, out = sum(mass.values()), 0, []
    for cell in sorted(mass):
        if so_far * fragments >= total * (len(out) + 1) and len(out) < fragments - 1:
            out.append(cell)
        so_far += mass[cell]
    return out


_SEGMENTS = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("df", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32())), ("fragment", pa.int32()), ("segment", pa.list_(pa.int64()))])
SEGMENTS = "cls binary, n bigint, prefix array<bigint>, df array<bigint>, cells array<int>, fragment int, segment array<bigint>"


def _segments(copies: Store, counts: Store, size: int, percent: int, first_cells: list[int]):
    firsts = np.array(first_cells, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for classes, sets in _standing(copies, size, batches):
            out: list[tuple] = []
            if sets:
                _, (df,), _ = counts.find(np.concatenate(sets))
                level = np.floor(np.log2(np.maximum(df, 1).astype(np.float64))).astype(np.int64)
                at = 0
                for c, s in zip(classes, sets, strict=True):
                    n, d, lv = len(s), df[at : at + len(s)], level[at : at + len(s)]
                    at += n
                    shared = np.flatnonzero(d > 1)
                    reach = n - -(-percent * n // 100) + 1 - (n - len(shared))
                    if reach <= 0:
                        continue
                    order = shared[np.lexsort((s[shared], lv[shared]))]
                    keys = s[order].view(np.int64)
                    fragment = np.searchsorted(firsts, (lv[order] << 8) | (s[order] >> np.uint64(56)).astype(np.int64), side="right")
                    prefix, often = keys[:reach].tolist(), d[order][:reach].tolist()
                    cells = np.bincount(((s[shared] >> np.uint64(40)) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).tolist()
                    for f in np.unique(fragment).tolist():
                        out.append((c, n, prefix, often, cells, f, keys[fragment == f].tolist()))
                        prefix, often, cells = [], [], []
            yield rows(_SEGMENTS, *(zip(*out, strict=True) if out else [[]] * len(_SEGMENTS)))

    return run


def verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, na, b, nb): the links (a, b). Overlaps are counted per fragment and summed per pair."""
    seg = segments.select("cls", "fragment", "segment")
    left = pairs.join(seg.withColumnRenamed("cls", "a").withColumnRenamed("segment", "sa"), "a")
    both = left.join(seg.withColumnRenamed("cls", "b").withColumnRenamed("segment", "sb"), ["b", "fragment"])
    overlaps = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("part"))
    common = overlaps.groupBy("a", "b").agg(F.sum("part").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return common.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(v, c): the smallest vertex c that links (a, b) reach from each linked vertex v.

    Each round joins every vertex to the least of itself and its neighbours, by a hash of the round, and goes on with the links
    between what is left; one in two vertices of a path goes, and nearly all of a dense group. So all rounds together read little
    more than the links once.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        by = lambda x, k=len(rounds): F.struct(F.xxhash64(F.col(x), F.lit(k)).alias("h"), F.col(x).alias("x"))
        least = both.groupBy("v").agg(F.min(by("u")).alias("m"), F.count("*").alias("degree"))
        to = stored(least.select("v", F.least("m", by("v"))["x"].alias("c"), "degree"), tag)
        rounds.append(to.select("v", "c"))
        moved = spread_join(edges, to.select(F.col("v").alias("a"), F.col("c").alias("x"), "degree"), "a", "degree").select("x", "b")
        moved = spread_join(moved, to.select(F.col("v").alias("b"), F.col("c").alias("y"), "degree"), "b", "degree").where("x <> y")
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), tag)
    if not rounds:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("c"))
    labels = rounds.pop()
    while rounds:
        labels = stored(relabelled(rounds.pop(), labels), tag)
    least = labels.groupBy("c").agg(F.min("v").alias("least"), F.count("*").alias("size"))
    return stored(spread_join(labels, stored(least, tag), "c", "size").select("v", F.col("least").alias("c")), tag)


def relabelled(labels: DataFrame, further: DataFrame) -> DataFrame:
    """(v, c) of ``labels``, with c replaced by what ``further`` (v, c) has for it, if it has it."""
    sizes = labels.groupBy("c").agg(F.count("*").alias("size"))
    to = sizes.join(further.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("c", F.coalesce("to", "c").alias("to"), "size")
    return spread_join(labels, to, "c", "size").select("v", F.col("to").alias("c"))


def _pairs(joined: DataFrame) -> DataFrame:
    """Distinct pairs a < b of (x, nx, y, ny)."""
    swap = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return joined.select(pick("x", "y").alias("a"), pick("nx", "ny").alias("na"), pick("y", "x").alias("b"), pick("ny", "nx").alias("nb")).distinct()


def _alike(percent: int, p: str, q: str, cp: str, cq: str) -> Column:
    """Whether two sets can link, by their sizes and by the most that they can share in each cell."""
    most = F.aggregate(F.zip_with(cp, cq, lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    return F.when(100 * F.least(p, q) >= percent * F.greatest(p, q), 100 * most >= percent * (F.col(p) + F.col(q) - most)).otherwise(F.lit(False))


def _listed(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, cls) with each document's class, the classes' segments, and the lists of prefix n-grams.

    ``df`` of a list is in how many classes its n-gram is, the same in all of its rows.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = id_and_text(docs)
    bits = buckets_for(docs)
    sets = stored(docs.mapInArrow(_sets(size), SETS), "sets")
    copies = Store(shared_dir(spark, "copies"), bits, 2)
    repeated = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").select("cls", "rep")
    copies = copies.sealed(r["bucket"] for r in merge_buckets(repeated.mapInArrow(_send_copies(bits), RUNS), _write_copies(copies), "bucket bigint").collect())
    counts = Store(shared_dir(spark, "counts"), bits)
    cells = stored(merge_buckets(docs.mapInArrow(_count(copies, size, bits), RUNS), _write_counts(counts), "bucket bigint, cell bigint, mass bigint"), "cells")
    counts = counts.sealed(r["bucket"] for r in cells.select("bucket").distinct().collect())
    mass = cells.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("mass").alias("mass")).collect()
    firsts = fragment_cells({r["cell"]: r["mass"] for r in mass}, FRAGMENTS)
    segments = stored(docs.mapInArrow(_segments(copies, counts, size, percent, firsts), SEGMENTS), "segments").dropDuplicates(["cls", "fragment"])

    lists = segments.where(F.size("prefix") > 0).select("cls", "n", "cells", F.explode(F.arrays_zip("prefix", "df")).alias("e")).select(F.col("e.prefix").alias("gram"), F.col("e.df").alias("df"), "cls", "n", "cells")
    return sets, segments, stored(lists, "lists")


def _across(lists: DataFrame, differ: str, percent: int) -> DataFrame:
    """Pairs (x, nx, y, ny) of one n-gram's list whose ``differ`` ascends and that can link; a long list is cut into blocks of x."""
    block = F.pmod(F.xxhash64("cls"), F.floor(F.col("df") / CROSS) + 1)
    one = lambda v, b: lists.select("gram", b.alias("block"), F.col("cls").alias(v), F.col("n").alias(f"n{v}"), F.col("cells").alias(f"k{v}"), F.col(differ).alias(f"c{v}"))
    x, y = one("x", block), one("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("df") / CROSS))))
    pairs = x.join(y, (x["gram"] == y["gram"]) & (x["block"] == y["block"]) & (F.col("cx") < F.col("cy")) & _alike(percent, "nx", "ny", "kx", "ky"))
    return pairs.select("x", "nx", "y", "ny")


def links(docs: DataFrame, size: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, cls) with each document's class, and components (v, c) of linked classes."""
    sets, segments, lists = _listed(docs, size, percent)
    by = Window.partitionBy("gram", F.pmod(F.xxhash64("gram", "cls"), F.floor(F.col("df") / LIST) + 1)).orderBy(F.xxhash64("cls", "gram"), "cls")
    near = None
    for k in range(1, NEIGHBOURS + 1):
        some = lists.select(F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("cells").alias("kx"), F.lag("cls", k).over(by).alias("y"), F.lag("n", k).over(by).alias("ny"), F.lag("cells", k).over(by).alias("ky"))
        near = some if near is None else near.unionByName(some)
    first = stored(verified(_pairs(near.where(F.col("y").isNotNull() & _alike(percent, "nx", "ny", "kx", "ky"))), segments, percent), "links")
    known = components(first)

    prefixes = lists.groupBy("cls").agg(F.count("*").alias("size"))
    named = known.withColumnRenamed("v", "cls").join(prefixes, "cls")
    mine = stored(spread_join(lists, named, "cls", "size").unionByName(lists.join(known.select(F.col("v").alias("cls")), "cls", "left_anti").withColumn("c", F.col("cls"))), "lists")
    several = mine.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("df").alias("df")).where("lo <> hi")
    several = several.select("gram", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("df") / CROSS))).alias("block"))
    block = F.pmod(F.xxhash64("cls"), F.floor(F.col("df") / CROSS) + 1)
    open_lists = mine.withColumn("block", block).join(several, ["gram", "block"], "left_semi")
    second = verified(_pairs(_across(open_lists.drop("block"), "c", percent)), segments, percent)
    for end in ("a", "b"):  # links between components, as those of the first wave are done with
        second = second.join(known.select(F.col("v").alias(end), F.col("c").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    tops = components(second)
    return sets, relabelled(known, tops).unionByName(tops.join(known.select("v"), "v", "left_anti"))


def class_links(docs: DataFrame, size: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, cls) with each document's class, and every link (a, b) of two classes, a < b.

    Other than components, all links of a group are compared and given: as many as the square of its classes.
    """
    sets, segments, lists = _listed(docs, size, percent)
    return sets, stored(verified(_pairs(_across(lists, "cls", percent)), segments, percent), "links")


def link_counts(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, n_links of each document: with how many other documents it links, by the rules of near_duplicates."""
    sets, found = class_links(docs, size, percent)
    members = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.count("*").alias("m"))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("b").agg(F.count("*").alias("degree"))
    others = spread_join(both, members.withColumnRenamed("cls", "b").join(degree, "b"), "b", "degree").groupBy(F.col("a").alias("cls")).agg(F.sum("m").alias("others"))
    per = members.join(others, "cls", "left").select("cls", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "m")
    linked, alone = _by_class(sets, per, "m")
    return linked.select("doc_id", "n", "n_links").unionByName(alone.select("doc_id", "n", F.lit(0).alias("n_links"))).select("doc_id", F.col("n").alias("n_shingles"), F.col("n_links").cast("bigint").alias("n_links"))


def _by_class(sets: DataFrame, classes: DataFrame, size: str) -> tuple[DataFrame, DataFrame]:
    """Rows of classes, joined with what is known of their class, and the rows that are in none: without an id, or with an empty set."""
    in_class = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return spread_join(sets.where(in_class), classes, "cls", size), sets.where(~in_class)


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of each document.

    Documents link when 100 * intersection >= percent * union of their sets of distinct
    n-grams of ``size`` words; a component's id is its smallest doc_id. A null, empty or
    blank text has an empty set and links with nothing. Equal doc_ids are different
    documents that share their smallest component. A row without doc_id links with
    nothing and has no component. Classes go by a 128-bit digest of their sets. Columns
    besides doc_id and text are not read.
    """
    sets, found = links(docs, size, percent)
    ours = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    ours = stored(ours.join(found.withColumnRenamed("v", "cls"), "cls", "left").withColumn("c", F.coalesce("c", "cls")), "classes")
    least = ours.groupBy("c").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    named = spread_join(ours, least, "c", "size").select("cls", "component_id", "m")
    linked, alone = _by_class(sets, named, "m")
    out = linked.select("doc_id", "n", "component_id").unionByName(alone.select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
