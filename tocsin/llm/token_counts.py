"""Token counts without token ids.

No piece of the model has a space after another character, so a text's pieces are
those of its pre-tokens: a word with the spaces before it. Each distinct pre-token is
counted once, by the library, in the task that owns its hash; the counts form a store
of sorted hashes. Each document's pre-token frequencies are then joined to the store
and summed. Two pre-tokens of one hash are left out of the store and counted directly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_texts, id_and_text, rows, shared_dir, tune
from .hashstore import Store, bucket_starts, buckets_for, hash_words

_SPACE = "▁".encode()
_RUN = re.compile(b" +[^ ]*")
#: Distinct pre-tokens that a task holds before it sends them on.
HELD = 300_000

_MODELS: dict = {}


def model(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def pre_tokens(text: bytes) -> list[bytes]:
    """The pre-tokens of a text, each without its first space (which the library puts before any text)."""
    if not text:
        return []
    if _SPACE in text:
        text = text.replace(_SPACE, b" ")
    out = text.split(b" ")
    return [m[1:] for m in _RUN.findall(b" " + text)] if b"" in out else out


def count_pieces(path: str, units: list[bytes]) -> list[int]:
    """Pieces of each pre-token; one lone space is one piece."""
    return [len(x) if u else 1 for u, x in zip(units, model(path).encode([u.decode() for u in units], num_threads=1), strict=True)]


_UNITS = pa.schema([("bucket", pa.int32()), ("units", pa.list_(pa.binary()))])


def _distinct(bits: int):
    starts = bucket_starts(bits)

    def send(held: set[bytes]) -> pa.RecordBatch:
        units = list(held)
        keys = hash_words(units)
        order = np.argsort(keys)
        at = [*np.searchsorted(keys[order], starts).tolist(), len(units)]
        full = [k for k in range(len(starts)) if at[k] < at[k + 1]]
        return rows(_UNITS, full, [[units[j] for j in order[at[k] : at[k + 1]].tolist()] for k in full])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[bytes] = set()
        for b in batches:
            for t in byte_texts(b):
                held.update(pre_tokens(t))
            if len(held) > HELD:
                yield send(held)
                held = set()
        if held:
            yield send(held)

    return run


def _count(store: Store, path: str):
    def run(key, table):  # Spark reads type hints here as a choice of interface
        units = list({u for us in table.column("units").to_pylist() for u in us})
        keys = hash_words(units)
        order = np.argsort(keys)
        keys, n = keys[order], np.array(count_pieces(path, [units[k] for k in order.tolist()]), np.uint64)
        alone = np.ones(len(keys), bool)
        alone[1:] &= keys[1:] != keys[:-1]
        alone[:-1] &= keys[1:] != keys[:-1]
        store.write(key[0].as_py(), keys[alone], [n[alone]])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32())})

    return run


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_pre_tokens", pa.int64())])


def _sum(store: Store, path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = byte_texts(b)
            freq = [Counter(pre_tokens(t)) for t in raw]
            distinct = list(set().union(*freq))
            place, (n,), _ = store.find(hash_words(distinct))
            pieces = dict(zip(distinct, n.tolist(), strict=True))
            if missing := [distinct[k] for k in np.flatnonzero(place < 0).tolist()]:
                pieces.update(zip(missing, count_pieces(path, missing), strict=True))
            total = [sum(map(int.__mul__, map(pieces.__getitem__, f), f.values())) for f in freq]
            yield rows(_COUNTS, b.column("doc_id"), [len(t) for t in raw], total, [t > limit for t in total], [f.total() for f in freq])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_pre_tokens of each whole text.

    A null or empty text has no tokens; rows stay one to one, whatever their doc_id;
    columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = id_and_text(docs)
    store = Store(shared_dir(spark, "pieces"), buckets_for(docs))
    written = docs.mapInArrow(_distinct(store.bits), "bucket int, units array<binary>").groupBy("bucket").applyInArrow(_count(store, path), "bucket int").collect()
    store = store.sealed(r["bucket"] for r in written)
    return docs.mapInArrow(_sum(store, path, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_pre_tokens bigint")
