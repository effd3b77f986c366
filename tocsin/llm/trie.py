"""A prefix trie over conversations: ternary search trees by range shard, merged at the nodes that shards share.

A conversation is a sequence of turns, and a turn goes by 128 bits of the SHA-256 of its role and text, so that texts are
shuffled nowhere. Equal sequences are counted before anything else, so a third of all conversations being copies is one
row. Distinct sequences are dealt by ranges of their order into shards of about ``SHARD_TURNS`` turns. In a shard, turns are
encoded by a dictionary of its own, in order, and sequences inserted median first, which keeps the trees of siblings
balanced; nodes are walked from the last made to the first, children before parents, to sum members, leaves and savings.

Only prefixes of a shard's first and last sequence can have members elsewhere. These boundary nodes give what their other
descendants sum to; they are merged by a digest of their path, and summed in one task from the deepest up. There are at most
twice the shards times the greatest depth of them. Nodes below them look up their parent's smallest member by shard.

A conversation's turns are one array (16 bytes each, and a count), as are a shard's sequences. The ids of the members that
end at a node are joined in blocks of ``ID_BLOCK`` ids, and hashed block by block, in constant memory.

Nulls: rows without ``conv_id`` belong to no conversation and are left out; a null turn comes first; null role or text is
empty. Rows of one turn go by role, then by digest. Empty tables give no nodes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import batched, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, stored

#: Turns of distinct sequences in a shard at most, and, as long as there are fewer shards than shuffle partitions, at least.
SHARD_TURNS, LEAST_TURNS = 200_000, 5_000
#: Ids in a row of the digest of members.
ID_BLOCK = 1 << 16
NODES = "shard int, path binary, parent_path binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends string"
NODES_ARROW = pa.schema([("shard", pa.int32()), ("path", pa.binary()), ("parent_path", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")), ("ends", pa.string())])
MERGED = "path binary, parent_path binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"
MERGED_ARROW = pa.schema([("path", pa.binary()), ("parent_path", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends", pa.string())])
ENDS_ARROW = pa.schema([("ends", pa.string()), ("ends_sha256", pa.string())])


class TernaryTree:
    """Sequences of small numbers. Node 0 is the root; each node has its siblings below and above it, and its first child's tree."""

    def __init__(self) -> None:
        self.turn, self.low, self.high, self.down, self.up, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def child(self, parent: int, turn: int) -> int:
        """The child for a turn, made if there is none."""
        side, at, node = self.down, parent, self.down[parent]
        while node >= 0:
            if turn == self.turn[node]:
                return node
            side, at = (self.low if turn < self.turn[node] else self.high), node
            node = side[node]
        side[at] = made = len(self.turn)
        for column, value in ((self.turn, turn), (self.low, -1), (self.high, -1), (self.down, -1), (self.up, parent), (self.depth, self.depth[parent] + 1)):
            column.append(value)
        return made

    def insert(self, turns: list[int]) -> int:
        node = 0
        for t in turns:
            node = self.child(node, t)
        return node


def median_first(n: int) -> Iterator[int]:
    """The numbers below n, the median of each range before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            yield (m := (a + b) // 2)
            ranges += [(m + 1, b), (a, m)]


def path_digest(parent: bytes, code: bytes) -> bytes:
    return hashlib.sha256(parent + code).digest()[:16]


def shard_nodes(shard: int, sequences: list[dict]) -> Iterator[tuple]:
    """Rows of ``NODES`` for the ordered distinct sequences (codes, words, n, conv_id, ends) of one shard.

    Boundary nodes have a path, and sums over their other descendants only; all others are whole.
    """
    codes = sorted({c for s in sequences for c in s["codes"]})
    number = {c: k for k, c in enumerate(codes)}
    tree, ends, words = TernaryTree(), {}, {0: 0}
    for k in median_first(len(sequences)):
        s = sequences[k]
        node = tree.insert([number[c] for c in s["codes"]])
        ends[node] = s
        for w in reversed(s["words"]):
            if node in words:
                break
            words[node] = w
            node = tree.up[node]
    paths = {0: b""}
    for s in (sequences[0], sequences[-1]):
        node = 0
        for c in s["codes"]:
            after = tree.child(node, number[c])
            paths[after] = path_digest(paths[node], c)
            node = after
    size = len(tree.turn)
    members, least, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    for v in range(size - 1, -1, -1):
        if (s := ends.get(v)) is not None:
            members[v] += s["n"]
            least[v] = s["conv_id"] if least[v] is None else min(least[v], s["conv_id"])
        p = tree.up[v]
        if v not in paths:
            leaves[v] += not children[v]
            saved[v] += (members[v] - 1) * words[v]
            children[p] += 1
            leaves[p] += leaves[v]
            saved[p] += saved[v]
        if v:
            members[p] += members[v]
            least[p] = least[v] if least[p] is None else min(least[p], least[v])
    for v in range(size):
        p = tree.up[v]
        of = ends[v]["ends"] if v in ends else None
        yield shard, paths.get(v), paths.get(p), tree.depth[v], least[v], None if p in paths or p < 0 else least[p], members[v], children[v], leaves[v], saved[v], words[v], of


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if sequences := [s for b in batches for s in b.to_pylist()]:
        for some in batched(shard_nodes(TaskContext.get().partitionId(), sequences), 8192):
            yield rows(NODES_ARROW, *zip(*some, strict=True))


def merged_up(nodes: Iterator[dict]) -> Iterator[tuple]:
    """Boundary nodes, deepest first, with the sums over their boundary descendants added."""
    below: dict[bytes, list[int]] = {}
    for v in nodes:
        kids, leaves, saved = below.pop(v["path"], (0, 0, 0))
        kids, leaves, saved = kids + v["n_children"], leaves + v["n_leaves"], saved + v["saved_tokens"] + (v["n_convs"] - 1) * v["words"]
        leaves += not kids
        if v["parent_path"] is not None:
            p = below.setdefault(v["parent_path"], [0, 0, 0])
            for k, x in enumerate((1, leaves, saved)):
                p[k] += x
        yield v["path"], v["parent_path"], v["depth"], v["conv_id"], v["n_convs"], kids, leaves, saved, v["ends"]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in batched(merged_up(v for b in batches for v in b.to_pylist()), 8192):
        yield rows(MERGED_ARROW, *zip(*some, strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[tuple[str, str]]:
        for key, some in groupby((r for b in batches for r in b.to_pylist()), key=itemgetter("ends")):
            sha = hashlib.sha256()
            for k, r in enumerate(some):
                sha.update(("," * bool(k) + r["ids"]).encode())
            yield key, sha.hexdigest()

    for some in batched(each(), 1024):
        yield rows(ENDS_ARROW, *zip(*some, strict=True))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, codes, words): the turns of each conversation in order, and how many words each has."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("bigint")
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), code.alias("code"), words.alias("words")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.col("t.code").alias("codes"), F.col("t.words").alias("words"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation c with its first turns, crc32(c) mod 4 of them, taken from conversation c - c % 20."""
    base = own.select(F.col("conv_id").alias("base"), F.slice("codes", 1, 3).alias("base_codes"), F.slice("words", 1, 3).alias("base_words"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(base, "base", "left").withColumn("h", taken)

    def joined(c: str):
        first = F.when(F.col(f"base_{c}").isNull(), F.slice(c, 1, 0)).otherwise(F.slice(f"base_{c}", F.lit(1), F.col("h")))
        return F.concat(first, F.slice(c, F.col("h") + 1, F.size(c))).alias(c)

    return both.select("conv_id", joined("codes"), joined("words"))


def trie(paths: DataFrame) -> DataFrame:
    """Per node of the trie over (conv_id, codes, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = stored(paths.withColumn("ends", F.sha2(F.array_join(F.transform("codes", F.hex), ""), 256)), "paths")
    distinct = stored(paths.groupBy("ends").agg(F.first("codes").alias("codes"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "sequences")
    turns = distinct.agg(F.sum(F.size("codes"))).first()[0] or 0
    dealt = min(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / LEAST_TURNS))
    ranged = distinct.repartitionByRange(max(1, dealt, math.ceil(turns / SHARD_TURNS)), "codes").sortWithinPartitions("codes")
    nodes = stored(ranged.mapInArrow(_shards, NODES), "nodes")

    edge = nodes.where("path IS NOT NULL")
    sums = edge.groupBy("path").agg(
        F.first("parent_path").alias("parent_path"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"),
    )
    merged = stored(sums.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_merged, MERGED), "boundary")
    known = merged.select("path", F.col("conv_id").alias("least"))
    parts = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    boundary = merged.drop("path").join(known.withColumnRenamed("path", "parent_path"), "parent_path", "left").withColumn("parent_conv_id", F.col("least")).select(parts)
    per_shard = edge.select("shard", F.col("path").alias("parent_path")).join(known.withColumnRenamed("path", "parent_path"), "parent_path")
    inner = nodes.where("path IS NULL")
    deep = inner.where("parent_path IS NULL").select(parts)
    top = inner.where("parent_path IS NOT NULL").join(per_shard, ["shard", "parent_path"]).withColumn("parent_conv_id", F.col("least")).select(parts)
    found = boundary.unionByName(deep).unionByName(top)

    block = F.floor(F.col("conv_id") / ID_BLOCK).cast("bigint")
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = paths.groupBy("ends", block.alias("block")).agg(ids.alias("ids"))
    hashed = blocks.repartition("ends").sortWithinPartitions("ends", "block").select("ends", "ids").mapInArrow(_digests, "ends string, ends_sha256 string")
    out = [c for c in parts if c != "ends"]
    ending = found.where("ends IS NOT NULL").join(hashed, "ends").select(*out, "ends_sha256")
    return ending.unionByName(found.where("ends IS NULL").select(*out, F.sha2(F.lit(""), 256).alias("ends_sha256")))
