"""Hash stores, token counts and the language model against plain versions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tests.llm.odd import ROWS, none, odd
from tocsin.llm import hashstore, kn, queries, token_counts

PIECES = queries.tokenizer(queries.PIECE_BPE)


def test_runs():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    assert (hashstore.unmix(hashstore.mix(x)) == x).all()
    for keys in (np.unique(x), x[:1], np.array([0, 1, 2**64 - 1], np.uint64)):
        n = rng.integers(0, 300, len(keys)).astype(np.uint64)
        k, (m, z) = hashstore.from_run(hashstore.to_run(keys, [n, n * 0]))
        assert (k == keys).all() and (m == n).all() and not z.any()


def test_store(tmp_path):
    """Counts above 32 bits come back as they are; a bucket that wasn't written is empty, one whose file is lost is an error."""
    store = hashstore.Store(f"file://{tmp_path}", 6)
    keys = np.array([5, 9, 11], np.uint64) | np.uint64(3 << 58)
    n = np.array([1, 2**32 + 7, 2**63], np.uint64)
    store.write(3, keys, [n])
    store.write(4, np.array([4 << 58], np.uint64), [np.array([9], np.uint64)])
    store = store.sealed([3, 4])
    place, (got,), bucket = store.find(np.array([*keys[::-1], 1, 4 << 58], np.uint64))
    assert got.tolist() == [2**63, 2**32 + 7, 1, 0, 9] and place.tolist() == [2, 1, 0, -1, 0] and bucket.tolist() == [3, 3, 3, 0, 4]
    table = pa.table({"run": [hashstore.to_run(keys, [n // np.uint64(4)])] * 3, "kind": [0] * 3})
    assert hashstore.merged(table)[1][0].tolist() == [3 * (x // 4) for x in n.tolist()]
    hashstore._MAPPED.clear()
    (tmp_path / "bucket-000003.bin").unlink()
    with pytest.raises(FileNotFoundError):
        store.find(keys)


def test_more_buckets_than_are_mapped(tmp_path, monkeypatch):
    """Of a store with more buckets than a worker maps, a batch opens only those beyond; other stores give way."""
    opens = []
    monkeypatch.setattr(hashstore, "MAPPED", 96)
    monkeypatch.setattr(hashstore, "fetched", lambda uri: opens.append(uri) or uri)
    monkeypatch.setattr(hashstore, "_MAPPED", {})
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, np.uint64))
    stores = []
    for name in "ab":
        (tmp_path / name).mkdir()
        store = hashstore.Store(str(tmp_path / name), 7)
        bucket = (keys >> np.uint64(57)).astype(np.int64)
        for b in range(128):
            store.write(b, keys[bucket == b], [np.flatnonzero(bucket == b).astype(np.uint64)])
        stores.append(store.sealed(range(128)))
    for store in (*stores, stores[0]):
        for want in (128, 32, 32):
            opens.clear()
            place, (value,), _ = store.find(keys)
            assert len(opens) == want and (value == np.arange(len(keys))).all() and (place >= 0).all()
    assert len(hashstore._MAPPED) == 96


@pytest.mark.parametrize("bits", [6, 9, 16])
def test_pairs(bits):
    """Pairs of ids, also of more than 32 bits, are one to one with bucket and key."""
    pairs, rng = kn.Pairs(bits), np.random.default_rng(bits)
    most = 1 << pairs.half
    assert most >= 1 << 35
    a, b = (np.concatenate([rng.integers(0, most, 3000, dtype=np.uint64), np.array([0, 0, most - 1, most - 1], np.uint64), x]) for x in (np.arange(500, dtype=np.uint64), np.full(500, 7, np.uint64)))
    bucket, keys = pairs.code(a, b)
    assert bucket.max() < 1 << bits and len(set(zip(bucket.tolist(), keys.tolist()))) == len(set(zip(a.tolist(), b.tolist())))
    for k in set(bucket.tolist()):
        x, y = pairs.plain(k, keys[bucket == k])
        assert (x == a[bucket == k]).all() and (y == b[bucket == k]).all()


def test_token_counts(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op5_token_counts(spark, sf).collect()}
    for i, t in docs.items():
        n = len(sp.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 4096)
    many = [t or "" for _, t, *_ in ROWS] + ["  ", "a ", " a", "▁", "▁ ▁a▁▁b ", "a\nb  \n c", "<s> </s><unk>", "\x00 x"]
    df = spark.createDataFrame(list(enumerate(many)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PIECES).collect()} == {k: len(sp.encode(t)) for k, t in enumerate(many)}
    assert token_counts.count_tokens(odd(spark), PIECES).count() == len(ROWS) and token_counts.count_tokens(none(spark), PIECES).count() == 0


def plain_model(train):
    """log10 P(text) by dictionaries."""
    pairs, words = Counter(), Counter()
    for t in train:
        w = [None, *t, ""]
        words.update(w[1:])
        pairs.update(zip(w, w[1:], strict=False))
    follows = Counter(b for _, b in pairs)
    by = defaultdict(Counter)
    for (a, b), n in pairs.items():
        by[a][b] = n
    kinds = lambda xs: kn.discounts(*(sum(x == k for x in xs) for k in (1, 2, 3, 4)))
    dp, dw = kinds(list(pairs.values())), kinds(list(follows.values()))
    size, t = len(words), sum(follows.values())
    left = sum(dw[min(n, 3)] for n in follows.values()) / max(t, 1)
    total = {a: (sum(c.values()), sum(dp[min(x, 3)] for x in c.values())) for a, c in by.items()}

    def lower(w):
        if not t:
            return 1 / (size + 1)
        return max(follows[w] - dw[min(follows[w], 3)], 0) / t + left / (size + 1)

    def p(w, a):
        c = by.get(a)
        if not c:
            return lower(w)
        n, kept = total[a]
        return max(c[w] - dp[min(c[w], 3)], 0) / n + kept / n * lower(w)

    return words, p


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check_scores(got, docs):
    docs = [(i, (t or "").encode().lower().split()) for i, t in docs]
    words, p = plain_model([t for i, t in docs if not held(i)])
    n, v = sum(words.values()), len(words)
    want = []
    for i, t in docs:
        w = [None, *t, b""]
        w[-1] = ""
        want.append((i, held(i), len(t) + 1, sum(words[x] > 0 for x in w[1:]), n, sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w[1:]), sum(math.log10(p(b, a)) for a, b in zip(w, w[1:], strict=False))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:7], w[5:7], rtol=1e-9), (g, w)
    probabilities = sum(p(w, "nowhere") for w in words) + p(object(), "nowhere")
    assert not words or abs(probabilities - 1) < 1e-9
    a = next(iter(words), None)
    assert not words or abs(sum(p(w, a) for w in words) + p(object(), a) - 1) < 1e-9


def test_language_model(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_scores(queries.op6_language_model(spark, sf).collect(), docs)
    check_scores(kn.score(odd(spark)).collect(), [(r[0], r[1]) for r in ROWS])
    assert kn.score(none(spark)).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(60) if held(i)], "doc_id bigint, text string")
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in kn.score(only).collect())


def test_language_model_fits(spark):
    got = queries.op6_language_model(spark, "/root/testdata/sf0.01").toPandas()
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()
