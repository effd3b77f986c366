"""Best-fit packing of documents into token sequences.

Lengths are small integers, so best-fit decreasing needs only how many pieces have
each length (at most ``capacity`` numbers, whatever the table's size). The driver
places whole runs of equal pieces into runs of equally filled bins; a segment tree
over remaining capacities finds the tightest open bin in logarithmic time. Workers
then look up each piece's bin by its length and its rank among pieces of that length.
The placement is the one that best-fit decreasing gives for all documents together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, id_and_text, rows, stored, tune
from .word_bpe import library_encoder


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity: which have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self._count = [0] * (2 * self.size)

    def add(self, at: int, n: int) -> None:
        at += self.size
        while at:
            self._count[at] += n
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that has a bin; -1: none."""
        at, c = least + self.size, self._count
        if c[at]:
            return least
        while at > 1:
            if not at & 1 and c[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if c[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Places ``counts[length]`` pieces of each length; returns the runs of each length and the number of bins.

    A run ``(first_rank, first_bin, per_bin, fill)`` puts pieces from that rank on,
    ``per_bin`` to a bin, into consecutive bins that hold ``fill`` tokens so far.
    """
    tree, open_bins, runs, n_bins = CapacityTree(capacity), {}, {}, 0

    def put_back(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        placed = runs.setdefault(length, [])
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, per = capacity, capacity // length
                first, n = n_bins, -(-left // per)
                n_bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -1)
                per = room // length
            full = min(n, left // per)
            placed.append((rank, first, per, capacity - room))
            put_back(room - per * length, first, full)
            rank, left = rank + full * per, left - full * per
            if full < n and left:  # the rest goes into one more bin
                put_back(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put_back(room, first + full, n - full)
    return runs, n_bins


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = library_encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for b in batches:
            out = []
            for i, ids in zip(b.column("doc_id").to_pylist(), enc.encode(byte_texts(b)), strict=True):
                ids += end
                for k in range(0, len(ids), step):
                    some = ids[k : k + step]
                    n = len(some) // 4
                    out.append((i, k // step, k // 4, n, zlib.crc32(some), part, seen[n]))
                    seen[n] += 1
            yield rows(_PIECES, *(zip(*out, strict=True) if out else [[]] * 7))

    return run


def _place(runs: dict[int, list[tuple[int, int, int, int]]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {n: [r[0] for r in rs] for n, rs in runs.items()}
        for b in batches:
            seq, off = [], []
            for n, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist(), strict=True):
                first, bin0, per, fill = runs[n][bisect_right(firsts[n], rank) - 1]
                seq.append(bin0 + (rank - first) // per)
                off.append(fill + (rank - first) % per * n)
            yield rows(schema, *(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), seq, off)

    return run


_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` tokens.

    Each text is encoded, ``end_id`` appended; only documents longer than the capacity
    are cut. One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A null or empty text is the end id alone; equal doc_ids are different
    documents; a null doc_id stays null; an empty table packs into nothing. Columns
    besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    pieces = stored(id_and_text(docs).mapInArrow(_cut(tokenizer, end_id, capacity), PIECES), "pack")
    held = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit_decreasing(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shift, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(runs, _PLACED), out)
