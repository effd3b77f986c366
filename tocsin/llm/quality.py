"""Quality rules: a decision list learned by sequential covering.

Statistics of whole texts are counted in Arrow batches. From labelled rows, rules are
grown one condition at a time (a threshold on a rate, chosen by information gain) on
two thirds of the rows and pruned on the rest; the rows that a rule covers are set
aside and the next rule is grown. The list becomes one ordered Spark conditional
expression, so applying it needs no Python.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_mod, id_and_text, rows, texts, tune, unused, widened

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_shouts", "n_lines", "n_distinct", "n_twins")
#: The rates that conditions are about: name, numerator, denominator.
RATES = (
    ("symbols", "n_symbols", "word_chars"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
    ("upper", "n_upper", "word_chars"),
    ("lower", "n_lower", "word_chars"),
    ("shouts", "n_shouts", "n_words"),
    ("twins", "n_twins", "n_words"),
    ("variety", "n_distinct", "n_words"),
    ("word_length", "word_chars", "n_words"),
    ("words", "n_words", None),
)
#: Labelled rows that a list is learned from at most: those with the smallest hashes of doc_id.
SAMPLE = 20_000


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        times = Counter(windows)
        if len(times) < len(windows):
            end = 0  # words before it are counted
            for k, w in enumerate(windows):
                if times[w] > 1:
                    repeated += k + 5 - max(end, k)
                    end = k + 5
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\v\f\r")]
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _LOWER)),
        raw.count(b"!"),
        len(lines),
        len(set(words)),
        sum(map(eq, words, words[1:])),
    )


_STATS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [counts(t) for t in texts(b)]
        yield rows(_STATS, b.column("doc_id"), *(zip(*got, strict=True) if got else [[]] * len(COUNTS)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each whole text; null or empty: all 0. Rows stay one to one, whatever their doc_id; other columns aren't read."""
    tune(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_stats, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    """rate >= at, or rate < at."""

    rate: str
    above: bool
    at: float

    def column(self, col: Callable[[str], Column] = F.col) -> Column:
        up, down = next((a, b) for n, a, b in RATES if n == self.rate)
        x = col(up).cast("double") if down is None else col(up) / F.greatest(col(down), F.lit(1))
        return x >= F.lit(self.at) if self.above else x < F.lit(self.at)

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, [n for n, _, _ in RATES].index(self.rate)]
        return v >= self.at if self.above else v < self.at


Rule = tuple[Condition, ...]


def rates_of(table: np.ndarray) -> np.ndarray:
    """RATES of an array with COUNTS as columns."""
    at = COUNTS.index
    return np.stack([table[:, at(u)] / (np.maximum(table[:, at(d)], 1) if d else 1) for _, u, d in RATES], axis=1).astype(float)


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray, most: int, banned: set[tuple[str, bool]]) -> Rule:
    """Adds the condition of the highest gain, until only rejected rows are covered; ``banned`` ones start no rule."""
    rule: Rule = ()
    while len(rule) < most and not y.all():
        p0, n0 = y.sum(), len(y)
        best, best_gain = None, 1e-9
        for k, (name, _, _) in enumerate(RATES):
            v = x[:, k]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 129)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            order = np.argsort(v, kind="stable")
            hits = np.concatenate([[0], np.cumsum(y[order])])
            below = np.searchsorted(v[order], cuts)
            for above in (False, True):
                if not rule and (name, above) in banned:
                    continue
                p = hits[-1] - hits[below] if above else hits[below]
                n = len(v) - below if above else below
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - np.log2(p0 / n0)), -1)
                if len(gain) and gain.max() > best_gain:
                    j = int(gain.argmax())
                    best, best_gain = Condition(name, above, float(cuts[j])), gain[j]
        if best is None:
            break
        rule = (*rule, best)
        inside = best.holds(x)
        x, y = x[inside], y[inside]
    return rule


def learn(x: np.ndarray, rejected: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.97) -> list[Rule]:
    """Rules that reject, in order; each was right for ``precision`` of the rows it was pruned on."""
    rules: list[Rule] = []
    banned: set[tuple[str, bool]] = set()
    grow = np.arange(len(x)) % 3 > 0
    x, y = x, rejected.astype(bool)
    while len(rules) < max_rules and y[grow].any():
        rule = _grow(x[grow], y[grow], max_conditions, banned)
        if not rule:
            break
        px, py = x[~grow], y[~grow]

        def worth(r: Rule) -> float:
            inside = _covers(r, px)
            return (2 * py[inside].sum() - inside.sum()) / max(inside.sum(), 1)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        inside = _covers(rule, x)
        pruned_on = inside & ~grow
        if inside.sum() < 5 or y[inside].mean() < precision or (pruned_on.any() and y[pruned_on].mean() < precision):
            banned.add((rule[0].rate, rule[0].above))
            continue
        rules.append(rule)
        x, y, grow = x[~inside], y[~inside], grow[~inside]
    return rules


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """A list learned from at most ``sample`` labelled documents; without labels, an empty one. Of a repeated doc_id the row of the least counts is learned."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = id_and_text(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text")
    got = statistics(known).join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "quality", "c.*").orderBy(hash_mod("doc_id", 1 << 30), "doc_id").toPandas()
    return learn(rates_of(got[list(COUNTS)].to_numpy()), got["quality"].to_numpy() == 0) if len(got) else []


def failed(col: Callable[[str], Column] = F.col) -> Column:
    """The base test: too few words, or too many in repeated windows."""
    return (col("n_words") < 10) | (100 * col("n_repeat_words") > 20 * col("n_words"))


def verdict(rules: list[Rule], col: Callable[[str], Column] = F.col) -> Column:
    """The list as one ordered conditional expression: 0 where no rule holds, else the rule's number."""
    out = F
    for k, rule in enumerate(rules, 1):
        c = rule[0].column(col)
        for more in rule[1:]:
            c = c & more.column(col)
        out = out.when(c, F.lit(k))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def _struct(values: list[str]) -> pa.Array:
    got = [counts(t) for t in values]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*got, strict=True) if got else [[]] * len(COUNTS))], COUNTS)


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, whole, that the base test and the learned list keep; nothing is shuffled.

    Judged as by ``judge``: a null or empty text goes, repeated rows and equal or null doc_ids are
    judged row by row. Columns other than text, whatever their names, go through as they are.
    """
    tune(docs.sparkSession)
    rules, name = train(docs, labels, sample), unused(docs, "counts")
    inside = lambda c: F.col(f"{name}.{c}")
    with_counts = widened(docs, name, f"struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>", _struct)
    return with_counts.where(~failed(inside) & (verdict(rules, inside) == 0)).select(docs.columns)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, rule (0: none).

    A null or empty text has no words and fails the base test. Equal doc_ids are judged
    row by row; a null doc_id stays null. Without labels only the base test rejects.
    """
    rules = train(docs, labels, sample)
    out = statistics(docs).withColumn("base_failed", failed()).withColumn("rule", verdict(rules))
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), *COUNTS[5:], "rule")
