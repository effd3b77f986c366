"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates the letters and digits of a name; ё separates as well.
SEPARATORS = "(?iu)[^a-zа-яіїєґ0-9']+"


def plain_spaces(x: Column) -> Column:
    """Runs of white space, the no-break and zero-width ones included, as one space; trimmed."""
    return F.trim(F.regexp_replace(F.translate(x, " ﻿", "  "), r"\s+", " "))


def normalize(x: Column) -> Column:
    """Lower case, without marks at the end, Ukrainian letters as their Russian kin."""
    return F.translate(F.regexp_replace(F.lower(F.trim(x)), "[⚠💥🔴\\s]+$", ""), "іїєґ", "ииег")


def normalize_alias(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, SEPARATORS), lambda t: t != "")


def lexical_score(query: Column, alias: Column) -> Column:
    """Share of the query's words in the alias, and bonuses for a prefix, containment and equal outer words."""
    q, a = tokens(query), tokens(alias)
    share = F.size(F.filter(q, lambda t: F.array_contains(a, t))) / F.greatest(F.size(q), F.lit(1))
    prefix = F.when(alias.startswith(query) | query.startswith(alias), 0.2).otherwise(0.0)
    inside = F.when(alias.contains(query) | query.contains(alias), 0.1).otherwise(0.0)
    outer = (F.size(q) > 1) & (F.size(a) > 1) & (F.try_element_at(q, F.lit(1)) == F.try_element_at(a, F.lit(1))) & (F.try_element_at(q, F.lit(-1)) == F.try_element_at(a, F.lit(-1)))
    return F.when((F.size(q) == 0) | (F.size(a) == 0), 0.0).otherwise(share + prefix + inside + F.when(outer, 0.3).otherwise(0.0))


def strip_case_ending(x: Column) -> Column:
    """A name with a common case ending undone."""
    x = F.trim(x)
    cut = lambda n: F.substring(x, 1, F.length(x) - n)
    return (
        F.when(x.endswith("ку"), F.concat(cut(2), F.lit("ка")))
        .when(x.endswith("ой") | x.endswith("ою"), F.concat(cut(2), F.lit("а")))
        .when(x.endswith("ом") | x.endswith("ів"), cut(2)).otherwise(x)
    )


def split_places(x: Column) -> Column:
    """The names in "A/B", "A, B" or "A - B": two letters at least, each once whatever its case."""
    flat = plain_spaces(F.regexp_replace(x, r"[(){}\[\]]", " "))
    parts = F.filter(F.transform(F.split(flat, r"[/|,;]|\s[-–—]\s"), lambda p: F.trim(p)), lambda p: F.length(p) >= 2)
    low = F.transform(parts, lambda p: F.lower(p))
    first = F.filter(F.transform(parts, lambda p, k: F.struct(p.alias("p"), (F.array_position(low, F.lower(p)) == k + 1).alias("first"))), lambda s: s["first"])
    out = F.transform(first, lambda s: s["p"])
    return F.when(F.size(out) > 0, out).when(flat != "", F.array(flat)).otherwise(F.array().cast("array<string>"))


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    """Whether the text has one of the words, whatever the case."""
    low, out = F.lower(x), F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return F.coalesce(out, F.lit(False))


def to_number(x: Column) -> Column:
    """A number out of a string, or null."""
    return x.try_cast("double")


def eta(seconds: Column) -> Column:
    """mm:ss."""
    return F.concat(F.lpad((F.floor(seconds / 60)).cast("string"), 2, "0"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def ago(seconds: Column, names: tuple[str, str, str] = ("s ago", "min ago", "h ago")) -> Column:
    s, m, h = names
    whole = lambda n: F.floor(seconds / n).cast("string")
    return F.when(seconds < 60, F.concat_ws(" ", seconds.cast("string"), F.lit(s))).when(seconds < 3600, F.concat_ws(" ", whole(60), F.lit(m))).otherwise(F.concat_ws(" ", whole(3600), F.lit(h)))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Slavic plural forms."""
    teen = (n % 100).between(11, 14)
    return F.when((n % 10 == 1) & ~teen, one).when((n % 10).between(2, 4) & ~teen, few).otherwise(many)


def osa(a: str, b: str) -> int:
    """Edits (insert, delete, replace, swap of neighbours, none of them twice in one place) between two strings."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + (x != y))
            row.append(best)
        before, last = last, row
    return last[-1]


def osa_bits(a: str, b: str) -> int:
    """osa with a column of the table in the bits of one number."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, diagonal, before, out = full, 0, 0, 0, len(a)
    for y in b:
        here = where.get(y, 0)
        swap = ((~diagonal & here) << 1) & before
        diagonal = ((((here & more) + more) ^ more) | here | less | swap) & full
        right, left = less | (full & ~(diagonal | more)), diagonal & more
        out += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, (left << 1) & full
        more, less, before = left | (full & ~(diagonal | right)), right & diagonal, here
    return out


def _letters(words: list[str], size: int) -> np.ndarray:
    """Code points (word, letter), zero beyond a word's end."""
    return np.array(words, f"<U{size}").view("<u4").reshape(len(words), size)


def osa_all(a: list[str], b: list[str]) -> np.ndarray:
    """osa of pairs: all of a batch at once by 64-bit numbers, where the shorter word fits into one; the others by ``osa_bits``."""
    out = np.zeros(len(a), np.int32)
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    swapped = na > nb
    short = [y if s else x for x, y, s in zip(a, b, swapped.tolist(), strict=True)]
    long = [x if s else y for x, y, s in zip(a, b, swapped.tolist(), strict=True)]
    ns, nl = np.minimum(na, nb), np.maximum(na, nb)
    fits = (ns > 0) & (ns <= 64) & (nl <= 256) & np.array(["\0" not in x and "\0" not in y for x, y in zip(a, b, strict=True)], bool)
    for k in np.flatnonzero(~fits).tolist():
        out[k] = osa_bits(short[k], long[k])
    rows = np.flatnonzero(fits)
    if not len(rows):
        return out
    ns, nl = ns[rows], nl[rows]
    x, y = _letters([short[k] for k in rows.tolist()], int(ns.max())), _letters([long[k] for k in rows.tolist()], int(nl.max()))
    one = np.uint64(1)
    top = one << (ns - 1).astype(np.uint64)
    full = top | (top - one)
    more, less, diagonal, before, found = full.copy(), *(np.zeros(len(rows), np.uint64) for _ in range(3)), ns.copy()
    for j in range(y.shape[1]):
        here = np.zeros(len(rows), np.uint64)
        for i in range(x.shape[1]):
            here |= (x[:, i] == y[:, j]).astype(np.uint64) << np.uint64(i)
        here &= full
        swap = ((~diagonal & here) << one) & before
        diagonal = ((((here & more) + more) ^ more) | here | less | swap) & full
        right, left = less | (full & ~(diagonal | more)), diagonal & more
        found += np.where(j < nl, ((right & top) != 0).astype(np.int64) - ((left & top) != 0), 0)
        right, left = (right << one | one) & full, (left << one) & full
        more, less, before = left | (full & ~(diagonal | right)), right & diagonal, here
    out[rows] = found
    return out


@F.pandas_udf(T.IntegerType())
def osa_distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """osa over columns, a batch at once."""
    for a, b in pairs:
        yield pd.Series(osa_all(a.tolist(), b.tolist()))
