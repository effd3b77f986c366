"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words sums over their common subsequences of ``LENGTH`` letters, each
gap damped by ``DECAY``; normalised and raised to a power, it is close to 1 for an insult and the
same insult with inserted or missing letters. The kernel of two sentences sums over
their distinct words. Nyström landmarks (words of the labelled sample) turn it into features in
which a linear machine is trained on labelled sentences: the toxic ones of toxic
documents against all of clean ones, chosen again by each machine. A word's part
in a decision is then one number, so workers compute it once per distinct word. A
document's score is a logistic function of its sentences' decisions.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_mod, id_and_text, own_memory, rows, texts, tune, unused, widened

#: Letters of a subsequence, and the damping of each letter that it spans.
LENGTH, DECAY = 3, 0.9
#: Landmarks: words of toxic documents, and the words of clean ones most like them.
TOXIC_LANDMARKS, OTHER_LANDMARKS = 56, 20
#: Longest landmark; longer words are read as overlapping windows of this size.
WINDOW = 20
#: Words of a sentence at most; a longer one is read as several sentences of this size, so that all its words count.
RUN = 40
#: Labelled documents that a model is fitted on at most, toxic and clean, and sentences of each of them at most.
TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_SENTENCES = 2_000, 3_000, 5_000
#: Words, or sentences, that are worked on at once in fitting.
CHUNK = 8_192
#: Words, and subsequences of each, that the kernel lays out at once.
AT_ONCE, TRIPLES = 64, 512
#: Words that a worker remembers.
MEMO = 400_000

_EDGES = "#*$%&|<>!?.,;:\"'()[]{}-_/\\=+~^`«»„“”…@0123456789"
_SENTENCE = re.compile(r"[.!?]+\s+|\n")
_MAYBE_SPACED = re.compile(r"[ \t]\w[ \t]\w(?!\S)")
_SPACED = re.compile(r"(?<!\S)(?:\w[ \t]){2,}\w(?!\S)")


def _by_size(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length after another: where they stand, and their code points (word, letter)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size).tolist():
        if n >= LENGTH:
            some = np.flatnonzero(size == n)
            yield some, np.array([words[k] for k in some.tolist()], f"<U{n}").view("<u4").reshape(-1, n).astype(np.int64)


@cache
def _triples(n: int) -> tuple[np.ndarray, ...]:
    """Places of all subsequences of three of ``n`` letters: the pairs' first and second, each triple's pair and third, and its weight."""
    i, j = np.triu_indices(n, 1)
    pair = np.repeat(np.arange(len(i)), n - 1 - j)
    third = np.concatenate([np.arange(k + 1, n) for k in j.tolist()])
    return i, j, pair, third, (DECAY ** (third - i[pair] + 1)).astype(np.float32)


class Kernel:
    """Kernels of words with fixed ones, by the subsequences that those have.

    Every subsequence of three letters of the fixed words is a row of ``weights``, with a
    column for each fixed word. Words are laid out over the same rows, so that all their
    kernels are one product of matrices: the sums of the usual recurrence over both words' letters.
    """

    def __init__(self, others: list[str]):
        self.n = len(others)
        self.letters = np.array([-1, *sorted({ord(c) for o in others for c in o})], np.int64)
        wide = len(self.letters)
        pairs: dict[tuple[int, int], int] = {}
        rows: dict[tuple[int, int], int] = {}
        weights = [np.zeros(self.n, np.float32)]
        for where, points in _by_size(others):
            i, j, pair, third, weight = _triples(points.shape[1])
            for k, w in zip(where.tolist(), self._known(points).tolist(), strict=True):
                for x, y, z, v in zip(i[pair].tolist(), j[pair].tolist(), third.tolist(), weight.tolist(), strict=True):
                    p = pairs.setdefault((w[x], w[y]), len(pairs) + 1)
                    r = rows.setdefault((p, w[z]), len(rows) + 1)
                    if r == len(weights):
                        weights.append(np.zeros(self.n, np.float32))
                    weights[r][k] += v
        self.pair = np.zeros(wide * wide, np.int32)
        self.row = np.zeros((len(pairs) + 1) * wide, np.int32)
        for (x, y), p in pairs.items():
            self.pair[x * wide + y] = p * wide
        for (p, z), r in rows.items():
            self.row[p * wide + z] = r
        self.weights = np.array(weights)  # row 0, all zeros, is for subsequences that no fixed word has
        self._laid = np.empty(AT_ONCE * len(weights), np.float32)

    def _known(self, points: np.ndarray) -> np.ndarray:
        """Numbers of the letters; 0: no fixed word has it."""
        at = np.searchsorted(self.letters, points)
        at[at == len(self.letters)] = 0
        at[self.letters[at] != points] = 0
        return at.astype(np.int32)

    def __call__(self, words: list[str]) -> np.ndarray:
        """word x fixed word."""
        out, wide, high = np.zeros((len(words), self.n), np.float32), len(self.letters), len(self.weights)
        for where, points in _by_size(words):
            i, j, pair, third, weight = _triples(points.shape[1])
            known = np.ascontiguousarray(self._known(points).T)
            for lo in range(0, len(where), AT_ONCE):
                w = known[:, lo : lo + AT_ONCE]
                m = w.shape[1]
                laid = self._laid[: m * high]
                laid.fill(0)
                starts = np.arange(0, m * high, high, dtype=np.int32)
                for a in range(0, len(third), TRIPLES):
                    p, z = pair[a : a + TRIPLES], third[a : a + TRIPLES]
                    row = self.row[self.pair[w[i[p]] * wide + w[j[p]]] + w[z]]
                    np.add.at(laid, row + starts, np.broadcast_to(weight[a : a + TRIPLES, None], row.shape))
                out[where[lo : lo + m]] = laid.reshape(m, high) @ self.weights
        return out


def subsequence_kernel(words: list[str], others: list[str]) -> np.ndarray:
    """Unnormalised kernels of each word with each of the others."""
    return Kernel(others)(words)


def self_kernel(words: list[str]) -> np.ndarray:
    """Each word's kernel with itself, by the usual recurrence over letters, all words of a length at once."""
    out = np.zeros(len(words), np.float32)
    decay, square = np.float32(DECAY), np.float32(DECAY * DECAY)
    for where, points in _by_size(words):
        for lo in range(0, len(where), CHUNK):
            letters = np.ascontiguousarray(points[lo : lo + CHUNK].T)
            size, m = letters.shape
            prefix = [np.zeros((size, m), np.float32) for _ in range(1, LENGTH)]
            for letter in letters:
                match = (letters == letter) * square
                out[where[lo : lo + m]] += (match[1:] * prefix[LENGTH - 2][:-1]).sum(axis=0)
                for q in range(LENGTH - 2, -1, -1):
                    here, along = prefix[q], np.zeros(m, np.float32)
                    here *= decay
                    for j in range(size):
                        along *= decay
                        if q == 0:
                            along += match[j]
                        elif j:
                            along += match[j] * prefix[q - 1][j - 1]
                        here[j] += along
    return out


def likeness(words: list[str], kernel: Kernel, own: np.ndarray) -> np.ndarray:
    """Normalised kernels to the fourth power: 1 for equal words, 0 for words without a common subsequence.

    ``own`` has the fixed words' kernels with themselves.
    """
    out = kernel(words)
    some = np.flatnonzero(out.any(axis=1))
    own_words = self_kernel([words[k] for k in some.tolist()])
    out[some] = np.square(np.square(out[some] / np.sqrt(np.maximum(own_words[:, None] * own[None, :], 1e-12))))
    return out


@lru_cache(maxsize=2)
def kernel_of(landmarks: tuple[str, ...]) -> Kernel:
    return Kernel(list(landmarks))


def sentences(text: str) -> list[list[str]]:
    """The distinct raw words of each sentence; words spelled out with spaces are joined."""
    low = text.lower()
    if _MAYBE_SPACED.search(low):
        low = _SPACED.sub(lambda m: re.sub(r"\s", "", m[0]), low)
    out = []
    for s in _SENTENCE.split(low):
        w = s.split()
        out += [list(dict.fromkeys(w[k : k + RUN])) for k in range(0, len(w), RUN)]
    return out


def core(raw: str) -> str:
    """The letters and digits of a word: marks around it or between its letters go."""
    word = raw.strip(_EDGES)
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def windows(word: str) -> list[str]:
    """What the kernel reads of a word: all of it between marks of its start and end, or overlapping windows of that."""
    word = f"^{word}$"
    return [word] if len(word) <= WINDOW else [word[k : k + WINDOW] for k in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def pooled(decisions: list[float], strong: int, words: int, bias: float) -> list[float]:
    """What a document's score is a function of: its highest decisions, how many are positive, and its share of words that make a sentence toxic alone."""
    top = sorted(decisions, reverse=True)[:3] + [bias] * 3
    positive = sum(d > 0 for d in decisions)
    clip = lambda x: max(-4.0, min(4.0, x))
    return [clip(top[0]), sum(map(clip, top[:3])) / 3, math.log1p(positive), positive / max(len(decisions), 1), min(100 * strong / max(words, 1), 4.0)]


@dataclass(frozen=True)
class Machine:
    landmarks: tuple[str, ...]
    own: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    logistic: tuple[float, ...]

    def parts(self, words: list[str]) -> list[float]:
        """Each word's part in a sentence's decision; of a long word, the largest window's."""
        if not self.landmarks or not words:
            return [0.0] * len(words)
        cut = [windows(w) for w in words]
        flat = list(chain.from_iterable(cut))
        value = likeness(flat, kernel_of(self.landmarks), np.array(self.own, np.float32)) @ np.array(self.weights, np.float32)
        return np.maximum.reduceat(value, np.cumsum([0, *map(len, cut[:-1])])).astype(float).tolist()

    def score(self, features: list[float]) -> float:
        z = self.logistic[0] + sum(a * b for a, b in zip(self.logistic[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: Without toxic or without clean training rows, every score is 0.
NOTHING = Machine((), (), (), -1.0, (-30.0, 0.0, 0.0, 0.0, 0.0, 0.0))


class Scorer:
    """A worker's memory of words' parts."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self._raw: dict[str, float] = {}
        self._core: dict[str, float] = {}

    def features(self, docs: list[str]) -> list[list[float]]:
        if len(self._raw) > MEMO or len(self._core) > MEMO:
            self._raw.clear()
            self._core.clear()
        cuts = [sentences(t) for t in docs]
        new = {w for c in cuts for s in c for w in s if w not in self._raw}
        cores = {w: core(w) for w in new}
        unknown = [c for c in set(cores.values()) if c not in self._core]
        self._core.update(zip(unknown, self.machine.parts(unknown), strict=True))
        self._raw.update((w, self._core[c]) for w, c in cores.items())
        get, bias = self._raw.__getitem__, self.machine.bias
        out = []
        for c in cuts:
            parts = [list(map(get, s)) for s in c]
            strong = sum(x + bias > 0 for p in parts if p and max(p) + bias > 0 for x in p)
            out.append(pooled([sum(p) + bias for p in parts], strong, sum(map(len, parts)), bias))
        return out

    def scores(self, docs: list[str]) -> list[float]:
        return [self.machine.score(f) for f in self.features(docs)]


_SCORERS: dict[Machine, Scorer] = {}


def scorer(machine: Machine) -> Scorer:
    own_memory("scorers", _SCORERS.clear)
    if machine not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[machine] = Scorer(machine)
    return _SCORERS[machine]


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, logistic: bool) -> np.ndarray:
    """Minimises ridge / 2 * |w|^2 (without the bias, which is first) + weighted squared hinge or logistic losses."""
    w, keep = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, ridge)
    keep[0] = 1e-6
    for _ in range(50):
        slope, bend = keep * w, np.diag(keep + 1e-9)
        for lo in range(0, len(x), CHUNK):
            some = np.hstack([np.ones((len(x[lo : lo + CHUNK]), 1)), x[lo : lo + CHUNK]])
            sign, v, f = y[lo : lo + CHUNK], weight[lo : lo + CHUNK], some @ w
            if logistic:
                p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
                g, h = v * (p - (sign > 0)), v * p * (1 - p)
            else:
                slack = np.maximum(1 - sign * f, 0)
                g, h = -v * sign * slack, v * (slack > 0)
            slope += some.T @ g
            bend += (some * h[:, None]).T @ some
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: list[str], toxic: list[bool], share: float | None = None) -> Machine:
    """A machine from labelled documents; ``share`` is how many of all labelled rows are toxic, if the sample differs."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return NOTHING
    ids: dict[str, int] = {}
    index, lengths, doc = array("i"), array("i"), array("i")  # words of all sentences by number, each sentence's length and document
    a, b = Counter(), Counter()
    for k, t in enumerate(docs):
        seen: set[int] = set()
        for s in sentences(t):
            words = [ids.setdefault(core(w), len(ids)) for w in s]
            index.extend(words)
            lengths.append(len(words))
            doc.append(k)
            seen.update(words)
        (a if toxic[k] else b).update(seen)
    vocabulary = list(ids)
    a, b = Counter({vocabulary[k]: n for k, n in a.items()}), Counter({vocabulary[k]: n for k, n in b.items()})
    index, lengths, doc = (np.frombuffer(x, np.int32) for x in (index, lengths, doc))
    na, nb = y.sum(), (~y).sum()

    def surprise(w: str) -> float:
        p = (a[w] + b[w]) / (na + nb)
        return (a[w] / na - b[w] / nb) / math.sqrt(p * (1 - p) * (1 / na + 1 / nb) + 1e-12)

    fitting = [w for w in a if LENGTH <= len(w) <= WINDOW - 2 and a[w] > 2]
    z = {w: surprise(w) for w in fitting}
    lead = sorted((w for w in fitting if z[w] > 3), key=lambda w: (-z[w], w))[: 4 * TOXIC_LANDMARKS]
    if not lead:
        return NOTHING
    marked = [f"^{w}$" for w in lead]
    near = likeness(marked, Kernel(marked), self_kernel(marked))
    chosen: list[int] = []
    for k in range(len(lead)):
        if len(chosen) < TOXIC_LANDMARKS and all(near[k, j] < 0.5 for j in chosen):
            chosen.append(k)
    landmarks = [marked[k] for k in chosen]
    usual = [f"^{w}$" for w in sorted((w for w in b if LENGTH <= len(w) <= WINDOW - 2 and b[w] > 2 and (b[w] / nb > a[w] / na)), key=lambda w: (-b[w], w))]
    alike = likeness(usual, Kernel(landmarks), self_kernel(landmarks)).max(axis=1) if usual else np.empty(0)
    landmarks += [usual[k] for k in np.argsort(-alike, kind="stable")[:OTHER_LANDMARKS].tolist()]
    own, kernel = self_kernel(landmarks), kernel_of(tuple(landmarks))
    value, vectors = np.linalg.eigh(likeness(landmarks, kernel, own).astype(np.float64))
    good = value > 1e-6
    root = vectors[:, good] / np.sqrt(value[good])  # kernels with landmarks -> features

    first = np.cumsum(lengths) - lengths
    x = np.zeros((len(lengths), root.shape[1]), np.float32)
    kernels = np.empty((len(vocabulary), len(landmarks)), np.float32)
    for lo in range(0, len(vocabulary), CHUNK):
        some = [windows(w) for w in vocabulary[lo : lo + CHUNK]]
        kernels[lo : lo + CHUNK] = np.maximum.reduceat(likeness(list(chain.from_iterable(some)), kernel, own), np.cumsum([0, *map(len, some[:-1])]))
    for lo in range(0, len(lengths), CHUNK):
        hi = min(lo + CHUNK, len(lengths))
        begin, end = first[lo], first[hi - 1] + lengths[hi - 1]
        x[lo:hi] = np.add.reduceat(kernels[index[begin:end]], first[lo:hi] - begin) @ root
    strength = np.add.reduceat(np.array([max(z.get(w, 0.0) - 3, 0.0) for w in vocabulary])[index], first)
    del kernels

    clean, w = np.flatnonzero(~y[doc]), np.zeros(x.shape[1] + 1)
    for _ in range(4):
        order = np.lexsort((-strength, doc))
        first = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        toxic_ones = strength > 0
        if w.any():  # from the second round on, by the last machine: its toxic sentences, and each document's most toxic one
            toxic_ones[first] |= strength[first] > -0.5
        positive = np.flatnonzero(y[doc] & toxic_ones)
        if not len(positive):
            break
        some = np.concatenate([positive, clean])
        target = np.where(y[doc[some]], 1.0, -1.0)
        weight = np.where(target > 0, 1 / len(positive), 1 / len(clean))
        w = _newton(x[some], target, weight, 1e-4, logistic=False)
        strength = x @ w[1:] + w[0]
    alpha = root @ w[1:]
    machine = Machine(tuple(landmarks), tuple(own.tolist()), tuple(alpha.tolist()), float(w[0]), (0.0,) * 6)
    judge = Scorer(machine)
    f = np.array([row for lo in range(0, len(docs), 256) for row in judge.features(docs[lo : lo + 256])])
    share = y.mean() if share is None else share
    weight = np.where(y, share / y.mean(), (1 - share) / (1 - y.mean()))
    out = _newton(f, np.where(y, 1.0, -1.0), weight, 0.1, logistic=True)
    return Machine(machine.landmarks, machine.own, machine.weights, machine.bias, tuple(out.tolist()))


def shortened(text: str, most: int) -> str:
    """The text, or, of one with more sentences than ``most``, those with the smallest hashes, in their order."""
    found = sentences(text)
    if len(found) <= most:
        return text
    lines = [" ".join(s) for s in found]
    order = sorted(range(len(lines)), key=lambda k: (xxhash.xxh64_intdigest(lines[k], seed=k), k))[:most]
    return "\n".join(lines[k] for k in sorted(order))


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, toxic_rows: int = TOXIC_SAMPLE, clean_rows: int = CLEAN_SAMPLE, row_sentences: int = SAMPLE_SENTENCES) -> Machine:
    """A machine from labelled rows whose crc32(doc_id) mod ``parts`` is not ``held``.

    The sample is bounded by ``toxic_rows`` and ``clean_rows``, those of the smallest hashes of their ids, and by
    ``row_sentences`` of each; texts of any length are in it.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(hash_mod("doc_id", parts) != held)
    pick = lambda t, n: marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = pick(1, toxic_rows).unionByName(pick(0, clean_rows))
    known = id_and_text(docs).where("text IS NOT NULL").join(F.broadcast(some), "doc_id").select("doc_id", "toxic", "text").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(_SAMPLE, b.column("doc_id"), b.column("toxic").cast(pa.int64()), [shortened(t, row_sentences) for t in texts(b)])

    sample = known.mapInArrow(short, "doc_id bigint, toxic bigint, text string").orderBy("doc_id").toPandas()
    share = marked.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("share")).first()["share"]
    return fit(sample["text"].tolist(), (sample["toxic"] == 1).tolist(), share)


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("text", pa.string())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(_SCORES, b.column("doc_id"), scorer(machine).scores(texts(b)))

    return run


def score(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, **sample: int) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted.

    A null or empty text is scored as one without sentences. A null doc_id is not held
    out. Equal doc_ids are scored row by row; of a labelled one the least text is learned. Without labels of both kinds every score
    is near 0. Columns besides doc_id and text are not read. ``sample`` are the bounds of ``train``.
    """
    tune(docs.sparkSession)
    machine = train(docs, labels, parts, held, **sample)
    out = id_and_text(docs).mapInArrow(_score(machine), "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(hash_mod("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, **sample: int) -> DataFrame:
    """The rows of ``docs``, whole, that are not predicted toxic; nothing is shuffled.

    Judged as by ``score``: a null or empty text as one without sentences, repeated rows and
    equal doc_ids row by row. Columns other than text, whatever their names, go through as they are.
    """
    tune(docs.sparkSession)
    machine, name = train(docs, labels, parts, held, **sample), unused(docs, "score")
    scored = widened(docs, name, "double", lambda t: pa.array(scorer(machine).scores(t), pa.float64()))
    return scored.where(F.col(name) < 0.5).select(docs.columns)
