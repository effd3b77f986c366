"""An interpolated modified Kneser-Ney bigram model over whole texts.

Tokens are white-space-separated words with A-Z in lower case, then one end. Three
passes: words are counted into a store of sorted hashes (a word's id is its place in
it); pairs of ids are counted into a second store, whose bucket and key together are a
bijection of the pair, so its bits are never too few; from each of its buckets the
numbers that the model needs (continuations of a word; total and distinct followers
of a context) are summed into arrays indexed by id. Workers map all of them into
memory to score texts. Words occur in a store by a 64-bit hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, fetched, hash_mod, put_file, rows, shared_dir, stored, tune
from .hashstore import MAPPED, MOST_BITS, RUNS, Store, bucket_starts, buckets_for, cut, hash_words, merge_buckets, merged, mix, packed, summed, to_run, unpacked

#: The end's hash; no word has this seed.
END = xxhash.xxh64_intdigest(b"", seed=1)
#: Distinct words, or pairs, that a task holds before it sends them on.
HELD_WORDS, HELD_PAIRS = 400_000, 4_000_000
#: Half of a pair of places within one batch.
HALF = np.uint64(32)


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _count_words(bits: int):
    starts = bucket_starts(bits)

    def send(held: Counter, ends: int) -> pa.RecordBatch:
        keys = np.append(hash_words(list(held)), np.uint64(END))
        n = np.fromiter(chain(held.values(), [ends]), np.uint64, len(keys))
        keys, (n,) = summed(keys, [n])
        return cut(keys, [n], starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        ends = 0
        for b in batches:
            for t in byte_texts(b):
                held.update(tokens(t))
            ends += b.num_rows
            if len(held) > HELD_WORDS:
                yield send(held, ends)
                held, ends = Counter(), 0
        if ends:
            yield send(held, ends)

    return run


def _merge_words(store: Store):
    def task(bucket: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, (n,) = merged(table)
        store.write(bucket, keys, [n])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64())})

    return task


@dataclass(frozen=True)
class Words:
    """The words' store; ids of bucket k run from first[k] to first[k + 1]; the beginning of a text is id ``size``."""

    store: Store
    first: tuple[int, ...]
    total: int

    @property
    def size(self) -> int:
        return self.first[-1]

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of hashes (size + 1: unknown) and their counts."""
        place, (n,), bucket = self.store.find(keys)
        return np.where(place < 0, self.size + 1, np.array(self.first)[bucket] + place).astype(np.uint64), n


def _token_ids(words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and counts of distinct tokens, the place of each token among them, text after text, and each text's number of tokens."""
    cuts = [tokens(t) for t in texts]
    n = np.array([len(c) + 1 for c in cuts], np.int64)
    ends = np.cumsum(n) - 1
    keys = np.full(int(n.sum()), END, np.uint64)
    inner = np.ones(len(keys), bool)
    inner[ends] = False
    keys[inner] = hash_words(list(chain.from_iterable(cuts)))
    distinct, back = np.unique(keys, return_inverse=True)
    ids, counts = words.ids(distinct)
    return ids, counts, back, n


def _before(x: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """What stands before each of x; ``start`` before the first of a text."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[np.cumsum(n) - n] = start
    return before


@dataclass(frozen=True)
class Pairs:
    """Pairs of ids as (bucket, key of 64 bits), evenly spread and one to one.

    With 2 ** bits buckets a half has (64 + bits) / 2 bits: 35 with the fewest buckets, 40 with the most.
    """

    bits: int

    @property
    def half(self) -> int:
        return (64 + self.bits) // 2

    def _turn(self, x: np.ndarray, k: int) -> np.ndarray:
        return mix(x + np.uint64(k)) & np.uint64((1 << self.half) - 1)

    def code(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, rest = np.uint64(self.half), np.uint64(self.half - self.bits)
        left = context ^ self._turn(word, 1)
        right = word ^ self._turn(left, 2)
        left = left ^ self._turn(right, 3)
        return (left >> rest).astype(np.uint16), (left & np.uint64((1 << int(rest)) - 1)) << h | right

    def plain(self, bucket: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, rest = np.uint64(self.half), np.uint64(self.half - self.bits)
        left, right = np.uint64(bucket) << rest | keys >> h, keys & np.uint64((1 << self.half) - 1)
        left = left ^ self._turn(right, 3)
        right = right ^ self._turn(left, 2)
        return left ^ self._turn(right, 1), right


def _count_pairs(words: Words, pairs: Pairs):
    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket, keys = bucket[order], keys[order]
        full, first = np.unique(bucket, return_index=True)
        runs = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
            k, n = np.unique(keys[lo:hi], return_counts=True)
            runs.append(to_run(k, [n.astype(np.uint64)]))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([0] * len(full), pa.int32()), pa.array(runs, pa.binary())], names=["bucket", "kind", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if b.num_rows:
                ids, _, back, n = _token_ids(words, byte_texts(b))
                ids = ids[back]
                held.append(pairs.code(_before(ids, n, words.size), ids))
            if sum(len(k) for _, k in held) > HELD_PAIRS:
                yield send(held)
                held = []
        if held:
            yield send(held)

    return run


#: Kinds of runs that a bucket of pairs sends: continuations by word, followers by context.
WORD, CONTEXT = 0, 1
_STATS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("run", pa.binary()), ("n1", pa.int64()), ("n2", pa.int64()), ("n3", pa.int64()), ("n4", pa.int64())])
STATS = f"{RUNS}, n1 bigint, n2 bigint, n3 bigint, n4 bigint"


def _merge_pairs(words: Words, pairs: Pairs, store: Store):
    starts = np.array(words.first[:-1], np.uint64)

    def by(keys: np.ndarray, columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
        keys, columns = summed(keys, columns)
        at = [*np.searchsorted(keys, starts).tolist(), len(keys)]
        full = [k for k in range(len(starts)) if at[k] < at[k + 1]]
        runs = [to_run(keys[at[k] : at[k + 1]], [c[at[k] : at[k + 1]] for c in columns]) for k in full]
        zeros = [0] * len(full)
        return rows(_STATS, full, [kind] * len(full), runs, zeros, zeros, zeros, zeros)

    def task(bucket: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, (n,) = merged(table)
        store.write(bucket, keys, [n])
        context, word = pairs.plain(bucket, keys)
        one = np.ones(len(n), np.uint64)
        yield by(word, [one], WORD)
        yield by(context, [n, *((n == k).astype(np.uint64) for k in (1, 2)), (n > 2).astype(np.uint64)], CONTEXT)
        yield rows(_STATS, [-1], [bucket], [b""], *([int((n == k).sum())] for k in (1, 2, 3, 4)))

    return task


#: A word's continuations; a context's total, and its followers seen once, twice, more often.
ARRAYS = 5


def _array_uri(folder: str, bucket: int) -> str:
    return f"{folder}/ids-{bucket:06d}.bin"


def _merge_stats(words: Words, folder: str):
    last = len(words.first) - 2

    def task(bucket: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        lo, hi = words.first[bucket], words.first[bucket + 1] + (bucket == last)
        out = [np.zeros(hi - lo, np.uint64) for _ in range(ARRAYS)]
        for kind, to in ((WORD, out[:1]), (CONTEXT, out[1:])):
            keys, columns = merged(table, kind)
            for o, c in zip(to, columns, strict=False):
                o[(keys - np.uint64(lo)).astype(np.int64)] = c
        put_file(_array_uri(folder, bucket), packed(out))
        c = out[0]
        yield pa.RecordBatch.from_pydict({k: pa.array([int(v)], pa.int64()) for k, v in [("bucket", bucket), ("total", c.sum()), *((f"n{k}", (c == k).sum()) for k in (1, 2, 3, 4)), ("seen", (c > 0).sum())]})

    return task


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """The modified discounts of counts 0, 1, 2 and more, from how many counts are 1, 2, 3, 4."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return (0.0, *(min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1)))


_ARRAYS: dict[str, list[np.ndarray]] = {}


@dataclass(frozen=True)
class Model:
    words: Words
    pairs: Store
    folder: str
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    continuations: int
    #: Words that follow one, two, or more words.
    word_classes: tuple[int, int, int]
    #: Buckets of words that have arrays; the others' are all 0.
    arrays: frozenset[int]

    def _read(self, bucket: int) -> list[np.ndarray]:
        uri = _array_uri(self.folder, bucket)
        if (found := _ARRAYS.get(uri)) is None:
            found = unpacked(np.memmap(fetched(uri), np.uint8, "r").view(np.ndarray))
            if len(_ARRAYS) >= MAPPED:
                for other in [u for u in _ARRAYS if not u.startswith(f"{self.folder}/")]:  # other models give way; what is mapped stays, as in a store
                    del _ARRAYS[other]
            if len(_ARRAYS) < MAPPED:
                _ARRAYS[uri] = found
        return found

    def _by_id(self, ids: np.ndarray, columns: slice) -> list[np.ndarray]:
        """Values of distinct ascending ids; unknown: 0."""
        out = [np.zeros(len(ids), np.uint64) for _ in range(ARRAYS)[columns]]
        first = np.array(self.words.first, np.uint64)
        first[-1] += np.uint64(1)
        at = np.searchsorted(ids, first)
        for b in range(len(first) - 1):
            if at[b] < at[b + 1] and b in self.arrays:
                here = (ids[at[b] : at[b + 1]] - first[b]).astype(np.int64)
                for o, c in zip(out, self._read(b)[columns], strict=True):
                    o[at[b] : at[b + 1]] = c[here]
        return out

    def log_probabilities(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of P(word | context) for pairs of ids."""
        bucket, keys = Pairs(self.pairs.bits).code(context, word)
        _, (n,), _ = self.pairs.find(keys, bucket)
        n = n.astype(np.float64)
        context, back_c = np.unique(context, return_inverse=True)
        word, back_w = np.unique(word, return_inverse=True)
        (follows,) = (x.astype(np.float64) for x in self._by_id(word, slice(0, 1)))
        total, one, two, more = (x.astype(np.float64) for x in self._by_id(context, slice(1, 5)))
        dw, dp = np.array(self.word_discounts), np.array(self.pair_discounts)
        uniform = 1 / (self.words.size + 1)
        if self.continuations:
            left = sum(d * k for d, k in zip(dw[1:], self.word_classes, strict=True)) / self.continuations
            lower = np.maximum(follows - dw[np.minimum(follows, 3).astype(int)], 0) / self.continuations + left * uniform
        else:
            lower = np.full(len(word), uniform)
        safe = np.maximum(total, 1)
        back_off = np.where(total > 0, (dp[1] * one + dp[2] * two + dp[3] * more) / safe, 1.0)
        own = np.maximum(n - dp[np.minimum(n, 3).astype(int)], 0) / safe[back_c]
        return np.log10(own + back_off[back_c] * lower[back_w])


def train(docs: DataFrame) -> Model:
    """Counts the model over all rows of (doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    bits = buckets_for(docs)
    counted = Store(shared_dir(spark, "words"), bits)
    sizes = {r["bucket"]: r for r in merge_buckets(docs.mapInArrow(_count_words(bits), RUNS), _merge_words(counted), "bucket int, n bigint, total bigint").collect()}
    first = [0]
    for b in range(1 << bits):
        first.append(first[-1] + (sizes[b]["n"] if b in sizes else 0))
    while first[-1] + 2 > 1 << Pairs(bits).half and bits < MOST_BITS:
        bits += 1
    if first[-1] + 2 > 1 << Pairs(bits).half:
        raise ValueError("more than 10 ** 12 distinct words")
    words = Words(counted.sealed(sizes), tuple(first), sum(r["total"] for r in sizes.values()))
    coded, pairs, folder = Pairs(bits), Store(shared_dir(spark, "pairs"), bits), shared_dir(spark, "ids")
    stats = stored(merge_buckets(docs.mapInArrow(_count_pairs(words, coded), RUNS), _merge_pairs(words, coded, pairs), STATS), "stats")
    per_bucket = stats.where("bucket < 0")
    seen = per_bucket.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    pairs = pairs.sealed(r["kind"] for r in per_bucket.select("kind").collect())
    merging = merge_buckets(stats.where("bucket >= 0").select("bucket", "kind", "run"), _merge_stats(words, folder), "bucket bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, seen bigint")
    got = merging.collect()
    c = {k: sum(r[k] for r in got) for k in ("total", "n1", "n2", "n3", "n4", "seen")}
    return Model(words, pairs, folder, discounts(*seen), discounts(c["n1"], c["n2"], c["n3"], c["n4"]), c["total"], (c["n1"], c["n2"], c["seen"] - c["n1"] - c["n2"]), frozenset(r["bucket"] for r in got))


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.words
        for b in batches:
            if not b.num_rows:
                continue
            ids, counts, back, n = _token_ids(words, byte_texts(b))
            pairs, place = np.unique(_before(back, n, len(ids)).astype(np.uint64) << HALF | back.astype(np.uint64), return_inverse=True)
            context, word = np.append(ids, np.uint64(words.size))[pairs >> HALF], ids[pairs & np.uint64(0xFFFFFFFF)]
            first = np.cumsum(n) - n
            score = np.add.reduceat(model.log_probabilities(context, word)[place], first)
            counts = counts[back]
            base = np.add.reduceat(np.log10((counts.astype(np.float64) + 1) / (words.total + (words.size + 1))), first)
            known = np.add.reduceat((counts > 0).astype(np.int64), first)
            yield rows(_SCORES, b.column("doc_id"), b.column("held_out"), n, known, [words.total] * len(n), base, score, np.power(10.0, np.minimum(-score / n, 300)))

    return run


def score(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """Trains on documents whose crc32(doc_id) mod ``parts`` is not ``held`` and scores all of them.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.
    A null or empty text is its end alone. A null doc_id is trained on. Equal doc_ids
    are different documents. Without training rows every token has probability 1
    (one unknown token). Columns besides doc_id and text are not read.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(hash_mod("doc_id", parts) == held, F.lit(False)).alias("held_out"))
    model = train(docs.where("NOT held_out").select("doc_id", "text"))
    return docs.mapInArrow(_score(model), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
