"""Encoding and decoding against the library."""

import hashlib
import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.odd import ROWS, none, odd
from tocsin.llm import lexicon, queries

PATH = queries.tokenizer(queries.WORD_BPE)


def want(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_table(spark, sf):
    t = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r[0]: tuple(r[1:]) for r in queries.op7_bpe(spark, sf).collect()}
    assert got == {i: want(t, x) for i, x in docs.items()}


@pytest.mark.parametrize("most", [0, 5, 1000])
def test_odd(spark, most):
    t = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    texts = [r[1] for r in ROWS] + ["".join(rng.choice("aAeéßΣσςİıǅﬁ́ '\"<|>endoftxsr1²٣中\x00\x85\xa0  \n.,-") for _ in range(80)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r[0]: tuple(r[1:]) for r in lexicon.round_trip(df, PATH, most).collect()} == {k: want(t, x) for k, x in enumerate(texts)}
    assert lexicon.round_trip(odd(spark), PATH).count() == len(ROWS) and lexicon.round_trip(none(spark), PATH).count() == 0


def test_long_words(spark):
    """Words without a break: every length around the limit, and a megabyte, in seconds."""
    t, rules, rng = Tokenizer.from_file(PATH), lexicon.rules(PATH), random.Random(7)
    for n in [*range(lexicon.LONG - 3, lexicon.LONG + 4), 1000, 5000]:
        for letters in ("ab", "etaoin", "x", "abcdefghijklmnopqrstuvwxyz"):
            word = "".join(rng.choice(letters) for _ in range(n))
            ids = t.encode(word, add_special_tokens=False).ids
            assert rules.merge_long(word.encode()).tolist() == ids == rules.merge([b"a", word.encode()])[1].tolist()
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    start = time.perf_counter()
    (got,) = lexicon.round_trip(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), PATH).collect()
    assert time.perf_counter() - start < 60 and tuple(got[1:]) == want(t, text)


def test_most_frequent(spark):
    """Never more words than asked for, however often they occur, and the frequent ones first."""
    many = spark.createDataFrame([(f"w{k}".encode(), n) for k, n in enumerate([200_000] * 40 + [10**12, 2**40] + [3] * 500)], "part binary, n bigint")
    got = lambda most: {bytes(r.part).decode() for r in lexicon.most_frequent(many, most).collect()}
    assert got(0) == set() and got(1) <= {"w40", "w41"} and got(2) == {"w40", "w41"}
    assert len(got(5)) <= 5 and {"w40", "w41"} <= got(5) <= {f"w{k}" for k in range(42)}
    assert got(42) == {f"w{k}" for k in range(42)} and 142 >= len(got(142)) > 120 and len(got(10**6)) == 542


def test_automaton():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))).encode() + rng.choice([b"ing", b"ed", b""]) for _ in range(2000)})
    lex = lexicon.Lexicon(lexicon.compile_words(words))
    assert lex.places(words).tolist() == list(range(len(words)))
    others = sorted({w + b"x" for w in words} | {w[:-1] for w in words if len(w) > 1} - set(words))
    assert [k for k in lex.places([w for w in others if w not in words]).tolist() if k >= 0] == []
    assert len(lex.arrays["final"]) < sum(map(len, words)) / 4
