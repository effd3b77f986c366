"""The kernel against its definition, and held-out accuracy."""

from collections import Counter
from functools import cache
from itertools import combinations

import numpy as np

from tests.llm.odd import ROWS, none, odd
from tocsin.llm import queries, toxicity


def plain_kernel(s, t):
    out = 0.0
    for a in combinations(range(len(s)), toxicity.LENGTH):
        for b in combinations(range(len(t)), toxicity.LENGTH):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                out += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return out


def test_kernel():
    words, others = ["idiot", "id.iot", "xx", "cat", "gasse", "aaaa", "ß中文字"], ["idiot", "scum", "aaa", "中ab文c字"]
    got = toxicity.subsequence_kernel(words, others)
    assert np.allclose(got, [[plain_kernel(s, t) for t in others] for s in words], rtol=1e-4)
    assert np.allclose(toxicity.self_kernel(words), [plain_kernel(s, s) for s in words], rtol=1e-4)


def plain_scores(machine, texts):
    """Scores by the definitions: kernels by all pairs of subsequences, sums over sentences."""
    @cache
    def weights(s):
        out = Counter()
        for p in combinations(range(len(s)), toxicity.LENGTH):
            out["".join(s[k] for k in p)] += toxicity.DECAY ** (p[-1] - p[0] + 1)
        return out

    dot = lambda s, t: sum(v * weights(t)[u] for u, v in weights(s).items())
    like = lambda s, t: (dot(s, t) / max(dot(s, s) * dot(t, t), 1e-12) ** 0.5) ** 4

    def part(raw):
        word = "^" + toxicity.core(raw) + "$"
        cut = [word] if len(word) <= 20 else [word[k : k + 20] for k in range(0, len(word) - 10, 10)]
        return max(sum(w * like(c, m) for w, m in zip(machine.weights, machine.landmarks, strict=True)) for c in cut)

    out = []
    for t in texts:
        decisions, strong, n = [], 0, 0
        for s in toxicity.sentences(t):
            parts = [part(w) for w in s]
            decisions.append(sum(parts) + machine.bias)
            strong += sum(p + machine.bias > 0 for p in parts)
            n += len(parts)
        top = [max(-4, min(4, x)) for x in [*sorted(decisions, reverse=True)[:3], *[machine.bias] * 3]]
        positive = sum(d > 0 for d in decisions)
        f = [top[0], sum(top[:3]) / 3, np.log1p(positive), positive / max(len(decisions), 1), min(100 * strong / max(n, 1), 4)]
        out.append(1 / (1 + np.exp(-(machine.logistic[0] + np.dot(machine.logistic[1:], f)))))
    return out


def test_scores():
    """A fitted machine's scores, in batches, against the definitions."""
    clean = ["the cat sat there and the dog was away. it ran home", "a garden of many green plants\nand more of it", "nothing to say of the weather here", "the river runs by the old mill. it is cold"]
    toxic = ["you idiot sat there. it ran home", "such a moron and an idiot. green plants", "that moron of the weather here", "the idiot runs by. moron"]
    docs = (clean + toxic) * 5
    machine = toxicity.fit(docs, [d in toxic for d in docs])
    assert machine.landmarks and all(len(w) <= toxicity.WINDOW for w in machine.landmarks)
    texts = [*clean, *toxic, "", " ", "id.iot", "an i d i o t is here", "idiotmoronidiotcatmoron and more", "1 2 3 #$%", "word " * 90 + "idiot", "idiiot. moroon\n\nx"]
    assert np.allclose(toxicity.Scorer(machine).scores(texts), plain_scores(machine, texts), atol=1e-4)


def test_sentences():
    """Every word is in a sentence; a long one goes on in the next."""
    words = [f"w{k}" for k in range(101)]
    got = toxicity.sentences(" ".join(words))
    assert [w for s in got for w in s] == words and max(map(len, got)) == toxicity.RUN
    assert toxicity.sentences("A a b! c\nd") == [["a", "b"], ["c"], ["d"]]
    assert toxicity.sentences("an i d, we are") == [["an", "i", "d,", "we", "are"]]
    assert toxicity.sentences("x y z and i d i o t now") == [["xyz", "and", "idiot", "now"]]


def test_sample_bounds(spark):
    """Long texts are learned from: by all their sentences, or by so many of them."""
    long = ". ".join(f"a garden of {k} green plants" for k in range(4000))
    assert len(long) > 100_000 and toxicity.shortened(long, 4000) == long
    some = toxicity.sentences(toxicity.shortened(long, 50))
    assert len(some) == 50 and all(s in toxicity.sentences(long) for s in some) and toxicity.shortened(long, 50) == toxicity.shortened(long, 50)
    rows = [(k, f"{long}. you idiot {k}." if k % 2 else f"{long}. you there {k}.", k % 2) for k in range(1, 13)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    machine = toxicity.train(docs, labels, parts=1000)
    assert any("idiot" in w for w in machine.landmarks)
    assert toxicity.train(docs, labels, parts=1000, clean_rows=0) == toxicity.NOTHING


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    out = got[got.held_out]
    assert out[out.toxic == 0].predicted.mean() < 0.05 and out[out.toxic == 1].predicted.mean() > 0.5


def test_held_out_more(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got[got.toxic == 0].predicted.mean() < 0.01 and got[got.toxic == 1].predicted.mean() > 0.85


def test_inserted_characters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    machine = toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    s = toxicity.Scorer(machine)
    clean = "the answer of this was in the tion and it is there with that"
    assert s.scores([clean, ""])[0] < 0.5 and s.scores([""])[0] < 0.5
    for w in ("idiot", "id.iot", "i-d-i-o-t", "i d i o t", "idiiot", "moron", "m*o*ron"):
        assert s.scores([f"{clean} {w} was there."])[0] >= 0.5, w


def test_odd(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = toxicity.score(odd(spark), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none(spark), labels).count() == 0
    assert all(r.score < 0.5 for r in toxicity.score(odd(spark), labels.where("false")).collect())
