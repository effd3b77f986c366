"""Token ids in files of Simple-8b words.

A file holds blocks of whole documents. A block is ``ids, words, escapes`` (three
unsigned 32-bit counts), then its 64-bit words, then its escaped values. The top four
bits of a word select how many ids it holds and how wide each is; selector 15 may point
at an escaped value, one wider than 59 bits. The footer lists doc_ids, each
document's first id within the file, and each block's first document and byte offset,
so that any block can be decoded alone, by array operations.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, fetched, id_and_text, put_file, rows, shared_dir, tune
from .word_bpe import library_encoder

MAGIC = b"TS8B0001"
#: Ids of each word, by selector; the width is 60 // ids. Selectors 0 and 1 (all zero) hold no bits.
LAYOUT = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: Selector 15 is (1, 60) for values under this; its payload then is the value. The bit above marks an escape.
_ESCAPE = np.uint64(1 << 59)
_MASK = np.uint64((1 << 60) - 1)
#: Ids after which a block ends with the current document.
BLOCK = 1 << 18


def encode_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words and escaped values of unsigned 64-bit integers."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    widths = sorted({w for _, w in LAYOUT})
    width = np.searchsorted(np.array([1 << w for w in widths[:-1]], np.uint64), v, side="right").astype(np.uint8)  # as an index of widths
    rank = {w: k for k, w in enumerate(widths)}
    most = {1: width}
    while 2 * max(most) <= 240:
        k = max(most)
        a = most[k]
        b = np.full(n, 255, np.uint8)
        if n > k:
            np.maximum(a[:-k], a[k:], out=b[:-k])
        most[2 * k] = b
        if int(b.min()) > rank[max((w for c, w in LAYOUT if c >= 4 * k), default=0)]:  # no longer window is narrow enough
            break
    take, sel = np.ones(n, np.int16), np.full(n, 15, np.int8)
    for s in range(14, -1, -1):
        count, w = LAYOUT[s]
        k = 1 << (count.bit_length() - 1)
        if k not in most or count > n:
            continue
        fits = most[k][: n - count + 1] <= rank[w]
        if count > k:
            fits &= most[k][count - k : n - k + 1] <= rank[w]
        take[: n - count + 1][fits] = count
        sel[: n - count + 1][fits] = s
    steps, at, p = take.tolist(), [], 0
    while p < n:
        at.append(p)
        p += steps[p]
    at = np.array(at)
    chosen = sel[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    escapes = np.empty(0, np.uint64)
    for s in np.unique(chosen).tolist():
        count, w = LAYOUT[s]
        here = np.flatnonzero(chosen == s)
        if s == 15:
            one = v[at[here]]
            wide = one >= _ESCAPE
            escapes = one[wide]
            one[wide] = _ESCAPE + np.arange(len(escapes), dtype=np.uint64)
            words[here] |= one
        elif w:
            first, packed = at[here], np.zeros(len(here), np.uint64)
            for k in range(count):
                packed |= v[first + k] << np.uint64(k * w)
            words[here] |= packed
    return words, escapes


def decode_words(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The inverse of encode_words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in LAYOUT])[sel]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(sel).tolist():
        count, w = LAYOUT[s]
        here = np.flatnonzero(sel == s)
        first, body = ends[here] - count, words[here] & _MASK
        if s == 15:
            wide = body >= _ESCAPE
            body[wide] = escapes[(body[wide] - _ESCAPE).astype(np.int64)]
            out[first] = body
        elif w:
            mask = np.uint64((1 << w) - 1)
            for k in range(count):
                out[first + k] = (body >> np.uint64(k * w)) & mask
    return out


def file_chunks(docs: Iterator[tuple[int | None, bytes]], stats: dict) -> Iterator[bytes]:
    """The bytes of a file of documents (doc_id, ids as little-endian unsigned 32-bit bytes)."""
    yield MAGIC
    at, held, waiting = len(MAGIC), 0, []
    doc_ids, known, starts, first_docs, offsets = [], [], [0], [], []

    def block() -> bytes:
        words, escapes = encode_words(np.frombuffer(b"".join(waiting), "<u4"))
        return struct.pack("<3I", held, len(words), len(escapes)) + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()

    for i, ids in docs:
        if not waiting:
            first_docs.append(len(doc_ids))
            offsets.append(at)
        doc_ids.append(i or 0)
        known.append(i is not None)
        starts.append(starts[-1] + len(ids) // 4)
        waiting.append(ids)
        held += len(ids) // 4
        if held >= BLOCK:
            out = block()
            at, held = at + len(out), 0
            waiting.clear()
            yield out
    if waiting:
        out = block()
        at += len(out)
        yield out
    yield from (np.array(x, t).tobytes() for x, t in ((doc_ids, "<i8"), (known, "u1"), (starts, "<i8"), (first_docs, "<i8"), (offsets, "<i8")))
    yield struct.pack("<3Q", len(doc_ids), len(offsets), at) + MAGIC
    stats |= {"docs": len(doc_ids), "ids": starts[-1]}


def read_file(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, first id within the file and ids (unsigned 32-bit) of each document, block by block."""
    raw = np.memmap(path, np.uint8, "r")
    if bytes(raw[:8]) != MAGIC or bytes(raw[-8:]) != MAGIC:
        raise ValueError(f"{path} is no token file, or not whole")
    n, blocks, at = struct.unpack("<3Q", raw[-32:-8].tobytes())

    def column(t: str, k: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(t).itemsize * k
        out, at = np.frombuffer(raw[at : at + size].tobytes(), t), at + size
        return out

    doc_ids, known, starts, firsts, offsets = column("<i8", n), column("u1", n), column("<i8", n + 1), column("<i8", blocks), column("<i8", blocks)
    for k in range(blocks):
        o = int(offsets[k])
        held, words, escapes = struct.unpack("<3I", raw[o : o + 12].tobytes())
        body = np.frombuffer(raw[o + 12 : o + 12 + 8 * (words + escapes)].tobytes(), "<u8")
        ids = decode_words(body[:words], body[words:]).astype("<u4")
        if len(ids) != held:
            raise ValueError(f"{path}: block {k} holds {len(ids)} ids, not {held}")
        a, b = int(firsts[k]), int(firsts[k + 1]) if k + 1 < blocks else n
        for d in range(a, b):
            yield int(doc_ids[d]) if known[d] else None, int(starts[d]), ids[starts[d] - starts[a] : starts[d + 1] - starts[a]]


_FILES = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, end = library_encoder(tokenizer), TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        docs = ((i, ids + end) for b in batches for i, ids in zip(b.column("doc_id").to_pylist(), enc.encode(byte_texts(b)), strict=True))
        stats: dict = {}
        name = f"ids-{part:06d}.ts8b"
        size = put_file(f"{folder}/{name}", file_chunks(docs, stats))
        yield rows(_FILES, [part], [name], [stats["docs"]], [stats["ids"]], [size])

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encodes the documents and writes their ids in ascending doc_id order; returns one row per file.

    Files follow each other by ``part``, and so do the doc_ids within them (null first;
    equal doc_ids by a hash of the text, so that even one id's rows are dealt over files). A null or empty text is the end id alone. ``start`` is the
    number of ids in the files before. An empty table gives files without documents.
    """
    spark = docs.sparkSession
    tune(spark)
    order = ("doc_id", F.xxhash64("text"))
    dealt = id_and_text(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    files, start = [], 0
    for r in sorted(dealt.mapInArrow(_write(folder, tokenizer, end_id), "part int, file string, n_docs bigint, n_ids bigint, n_bytes bigint").collect()):
        files.append((*r, start))
        start += r["n_ids"]
    return spark.createDataFrame(files, "part int, file string, n_docs bigint, n_ids bigint, n_bytes bigint, start bigint")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digest(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                out = [(i, base + s, len(ids), zlib.crc32(ids.tobytes())) for i, s, ids in read_file(fetched(f"{folder}/{name}"))]
                for k in range(0, len(out), 10_000):
                    yield rows(_READ, *zip(*out[k : k + 10_000], strict=True))

    return run


def read_digests(files: DataFrame, folder: str) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    One row per document as it was written: a null doc_id stays null, equal ones are rows of their own, a file without documents gives none.
    """
    n = max(1, files.count())
    return files.repartition(n).mapInArrow(_digest(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids into the shared folder and returns what the files then hold."""
    folder = shared_dir(docs.sparkSession, "ids")
    return read_digests(write_ids(docs, folder, tokenizer, end_id), folder)
