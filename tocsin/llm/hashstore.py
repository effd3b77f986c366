"""Sorted hash arrays in the shared folder, mapped into memory by workers.

Map tasks send runs of sorted 64-bit keys with values, cut by the keys' top bits into
buckets; one task merges each bucket and writes it as a file of a sorted key array and
value arrays. A bucket's size is bounded by the number of buckets, not by how often a
key occurs, since every run has each key once. Workers look up whole batches of keys.
A store knows which buckets were written; if the file of one is lost, reading it fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import fetched, own_memory, put_file

#: Words whose hashes a worker remembers.
MEMO = 500_000
#: Bits that tell buckets apart: at least, and at most, so that runs don't grow with the square of the input.
LEAST_BITS, MOST_BITS = 6, 16
#: Buckets that a worker keeps mapped; those of a store beyond that are mapped for one look-up.
MAPPED = 16_384
RUNS = "bucket int, kind int, run binary"
_RUNS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("run", pa.binary())])


class WordHashes(dict):
    """64-bit hashes of byte strings, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    """Hashes by this worker's memory."""
    own_memory("hashes", _HASHES.clear)
    return _HASHES.of(words)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def buckets_for(df: DataFrame) -> int:
    """The top bits that tell buckets apart: as many buckets as the input has partitions, between 64 and 65,536."""
    return max(LEAST_BITS, min((df.rdd.getNumPartitions() - 1).bit_length(), MOST_BITS))


def _planes(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without the leading planes of zeros."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def to_run(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """A run of ascending keys, by their differences, and its value columns."""
    head = np.array([len(keys), keys[0] if len(keys) else 0], "<u8").tobytes()
    return head + _planes(np.diff(keys)) + b"".join(map(_planes, columns))


def from_run(raw: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    n, first = np.frombuffer(raw, "<u8", 2).tolist()
    at, out = 16, []
    while at < len(raw):
        width, m = raw[at], n - (not out)
        x = np.zeros((m, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, width * m, at + 1).reshape(width, m).T
        at += 1 + width * m
        out.append(x.view("<u8").reshape(-1))
    keys = np.empty(n, np.uint64)
    keys[0] = first
    keys[1:] = out[0]
    return np.cumsum(keys, dtype=np.uint64), out[1:]


def summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ascending distinct keys, and each column's sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns]


def cut(keys: np.ndarray, columns: list[np.ndarray], starts: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Rows of RUNS: ascending keys cut at the buckets' first keys."""
    at = [*np.searchsorted(keys, starts).tolist(), len(keys)]
    full = [k for k in range(len(starts)) if at[k] < at[k + 1]]
    runs = [to_run(keys[at[k] : at[k + 1]], [c[at[k] : at[k + 1]] for c in columns]) for k in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([kind] * len(full), pa.int32()), pa.array(runs, pa.binary())], schema=_RUNS)


def bucket_starts(bits: int) -> np.ndarray:
    return np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)


def joined(table: pa.Table, kind: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """All runs of a bucket of one kind, one after the other."""
    runs = [from_run(r) for r, k in zip(table.column("run").to_pylist(), table.column("kind").to_pylist(), strict=True) if k == kind]
    if not runs:
        return np.empty(0, np.uint64), []
    return np.concatenate([k for k, _ in runs]), [np.concatenate(c) for c in zip(*(c for _, c in runs), strict=True)]


def merged(table: pa.Table, kind: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums over all runs of a bucket of one kind."""
    return summed(*joined(table, kind))


def packed(columns: list[np.ndarray]) -> Iterator[bytes]:
    """Unsigned integers as a file: each column in the narrowest width that holds all of it, so none wraps."""
    widths = [next(w for w in (1, 2, 4, 8) if not len(c) or int(c.max()).bit_length() <= 8 * w) for c in columns]
    yield np.array([len(columns), *chain.from_iterable(zip(widths, map(len, columns), strict=True))], "<u8").tobytes()
    for w, c in zip(widths, columns, strict=True):
        raw = c.astype(f"<u{w}").tobytes()
        yield raw + b"\0" * (-len(raw) % 8)


def unpacked(raw: np.ndarray) -> list[np.ndarray]:
    """The columns of a mapped file."""
    k = int(raw[:8].view("<u8")[0])
    at, out = 8 + 16 * k, []
    for w, n in raw[8:at].view("<u8").reshape(k, 2).tolist():
        out.append(raw[at : at + w * n].view(f"<u{w}"))
        at += w * n + -w * n % 8
    return out


@dataclass(frozen=True)
class Store:
    """A store's place, the bits that tell its buckets apart, how many value columns it has, and which buckets were written."""

    folder: str
    bits: int
    columns: int = 1
    #: A bit for each bucket that has a file.
    full: bytes = b""

    def _uri(self, bucket: int) -> str:
        return f"{self.folder}/bucket-{bucket:06d}.bin"

    def write(self, bucket: int, keys: np.ndarray, columns: list[np.ndarray]) -> None:
        """Writes a bucket; tasks that run twice write the same."""
        put_file(self._uri(bucket), packed([keys, *columns]))

    def sealed(self, buckets: Iterable[int]) -> Store:
        """The same store, to be read: these buckets were written, the others are empty."""
        some = np.zeros(1 << self.bits, bool)
        some[list(buckets)] = True
        return replace(self, full=np.packbits(some).tobytes())

    def read(self, bucket: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """A bucket's mapped arrays; a bucket that wasn't written has empty ones, one whose file is gone is an error."""
        key = (self.folder, bucket)
        if (found := _MAPPED.get(key)) is not None:
            return found
        if not self.full[bucket >> 3] >> (7 - bucket % 8) & 1:
            return np.empty(0, np.uint64), [np.empty(0, np.uint64)] * self.columns
        keys, *columns = unpacked(np.memmap(fetched(self._uri(bucket)), np.uint8, "r").view(np.ndarray))
        if len(_MAPPED) >= MAPPED:
            for other in [k for k in _MAPPED if k[0] != self.folder]:  # other stores give way
                del _MAPPED[other]
        if len(_MAPPED) < MAPPED:  # look-ups go over all buckets again and again, so what is mapped stays: to drop any would be to drop what comes next
            _MAPPED[key] = keys, columns
        return keys, columns

    def find(self, keys: np.ndarray, buckets: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """For each key: where it stands in its bucket (-1: nowhere), its values (0), and its bucket.

        Without ``buckets``, a key's top bits tell its bucket.
        """
        order = np.argsort(keys)
        if buckets is not None:
            order = order[np.argsort(buckets[order].astype(np.uint16), kind="stable")]
        asked = keys[order]
        bucket = (asked >> np.uint64(64 - self.bits)).astype(np.int64) if buckets is None else buckets[order].astype(np.int64)
        full, first = np.unique(bucket, return_index=True)
        place = np.full(len(keys), -1, np.int64)
        values = [np.zeros(len(keys), np.uint64) for _ in range(self.columns)]
        for b, lo, hi in zip(full.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
            have, columns = self.read(b)
            if not len(have):
                continue
            at = np.searchsorted(have, asked[lo:hi])
            at[at == len(have)] = 0
            hit = have[at] == asked[lo:hi]
            to, at = order[lo:hi][hit], at[hit]
            place[to] = at
            for v, c in zip(values, columns, strict=True):
                v[to] = c[at]
        where = np.empty(len(keys), np.int64)
        where[order] = bucket
        return place, values, where


_MAPPED: dict[tuple[str, int], tuple[np.ndarray, list[np.ndarray]]] = {}


def merge_buckets(runs: DataFrame, task: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Hands each bucket's runs, whole, to ``task``."""

    def run(key, table):  # Spark reads type hints here as a choice of interface
        return pa.Table.from_batches(list(task(key[0].as_py(), table)))

    return runs.groupBy("bucket").applyInArrow(run, schema)
