"""Conversation structure repair: the cheapest edits that give a conversation its order of roles, by iterative-deepening A*.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. Rows are kept (0), given another role (1) or
deleted (2; rows that are blank or repeat an earlier role and text must be), and empty turns are inserted (5); a truncated
row that stays costs 5 more. Edits are searched depth first in the order of their letters, D, I, K, R, under growing bounds
of cost, with a table of the states that failed and the budget they failed with; so the first path that is accepted is the
cheapest, and the least by letters among those.

A conversation is cut into segments of ``SEGMENT`` turn numbers. A conversation of one segment is searched at once; of a longer
one the cheapest edits of each segment are searched apart, for every state that it may begin and end in, and composed in
order, which gives the same answer as one search over all (of two paths between the same states with equal costs none
begins with the other, so least parts make a least whole). Only letters and counts are gathered; no text is shuffled but for
the digest. That digest is over a whole conversation, one text after the other, so its rows stream through one task, in
constant memory.

Nulls: a null role or text is one space, and so is a null number or id where rows are damaged; rows without an id are one
conversation, rows without a turn come first. Rows of one turn go by role, then by the digest of their text. An empty role
is no role that may stay. Empty tables give no rows. Texts may be of any length; the audit is one letter an edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows, stored, tune

#: Turn numbers of a segment.
SEGMENT = 64
#: States of a role order: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: From each state, the one role that may be inserted or given, and where it leads.
WANTS = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
NAMES = {"u": "user", "a": "assistant"}
ACCEPT = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The initial of a role that can't stay, as the rows' codes have it.
OTHER = "?"

CODES = pa.schema([("conv", pa.string()), ("segment", pa.int64()), ("codes", pa.string())])
PATHS = pa.schema([*CODES, ("paths", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])))])
FOLDED = pa.schema([("conv", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
HASHED = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])


NEVER = 1 << 60


def remaining(codes: list[tuple[str, str]], end: frozenset[int]) -> list[list[int]]:
    """By state and row, no more than what the rows from there on cost: the heuristic of the search.

    Rows with a fault are deleted for 2 or stay for 5. Only deletions lead back to the state before the
    first role; only they and one kept row lead to the system's.
    """
    n = len(codes)
    least, lost, system = [0] * (n + 1), [DELETE * (n - i) for i in range(n + 1)], [NEVER] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, fault = codes[i]
        least[i] = least[i + 1] + (DELETE if fault else 0)
        kept = lost[i + 1] + (TRUNCATED if fault == "t" else 0) if initial == "s" and fault not in ("b", "d") else NEVER
        system[i] = min(system[i + 1] + DELETE if system[i + 1] < NEVER else NEVER, kept)
    never = [NEVER] * (n + 1)
    if end == {START}:
        return [lost, never, never, never]
    if end == {SYSTEM}:
        return [system, lost, never, never]
    return [least] * 4


def search(codes: list[tuple[str, str]], begin: int, end: Iterable[int]) -> tuple[int, str] | None:
    """The least cost, and of its paths the least by letters, from state ``begin`` to a state of ``end``.

    codes: a row's initial (``OTHER`` if no role that may stay) and its fault: "b" blank, "d" duplicate,
    "t" truncated, "" none. Iterative deepening: depth-first under a bound, which grows by one until a path
    is accepted. A state fails once for each larger budget at most, so the work is that of rows by what edits cost
    beyond the heuristic.
    """
    n, end = len(codes), frozenset(end)
    rest, failed = remaining(codes, end), {}  # failed: of (row, state) the largest budget that wasn't enough
    if rest[begin][0] == NEVER:
        return None
    #: no path needs more than to lose all rows and to insert two roles
    for bound in range(rest[begin][0], DELETE * n + 2 * INSERT + 1):
        path: list[tuple[int, int, int, str]] = []  # row, state, budget and letter that led here
        stack = [(0, begin, bound, "", 0)]
        while stack:
            i, q, left, letter, depth = stack.pop()
            del path[depth:]
            if letter == "<":  # all that followed this state has failed
                failed[i, q] = max(left, failed.get((i, q), -1))
                continue
            if left < rest[q][i] or failed.get((i, q), -1) >= left:
                continue
            path.append((i, q, left, letter))
            if i == n and q in end:
                return bound - left, "".join(x[3] for x in path)
            role, to = WANTS[q]
            after = [(i, to, left - INSERT, "I")]
            if i < n:
                initial, fault = codes[i]
                after.insert(0, (i + 1, q, left - DELETE, "D"))
                if fault not in ("b", "d"):
                    kept = left - (TRUNCATED if fault == "t" else 0)
                    if (stays := NEXT.get((q, initial))) is not None:
                        after.append((i + 1, stays, kept, "K"))
                    after.append((i + 1, to, kept - REROLE, "R"))
            stack.append((i, q, left, "<", depth))
            stack.extend((*x, depth + 1) for x in reversed(after) if x[2] >= 0)
    return None


def paths(codes: list[tuple[str, str]]) -> Iterator[tuple[int, int, int, str]]:
    """(begin, end, cost, audit) of each pair of states that the rows can lead between."""
    for begin in range(4):
        for end in range(4):
            if (best := search(codes, begin, [end])) is not None:
                yield begin, end, *best


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the contract damages them, by crc32(``conv_id:turn``) mod 20."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    some = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), how.alias("how")).where("how <> 0")
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return some.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def ordered(rows_: DataFrame) -> DataFrame:
    """(conv, segment, turn, role, digest, text): what rows are told apart and put in order by; nulls as said above."""
    segment = F.coalesce(F.floor(F.col("turn").cast("double") / SEGMENT).cast("bigint"), F.lit(-(1 << 62)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows_.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), segment.alias("segment"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"),
    )


def coded(rows_: DataFrame) -> DataFrame:
    """(conv, segment, turn, role, digest, code) of ``ordered`` rows: the role's initial, and the first fault or a dash.

    Equal rows of a conversation are numbered by a window, which sorts them by spilling to disk.
    """
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    own = F.when(last == "", "b").when(last.isin(".", "!", "?"), "-").otherwise("t")
    initial = F.substring("role", 1, 1)
    light = rows_.select("conv", "segment", "turn", "role", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER).alias("initial"), own.alias("own"))
    seen = F.row_number().over(Window.partitionBy("conv", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when((F.col("own") != "b") & F.col("seen"), "d").otherwise(F.col("own"))
    return light.withColumn("seen", seen).select("conv", "segment", "turn", "role", "digest", F.concat("initial", fault).alias("code"))


def _stream(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows of equal keys, one at a time."""
    return groupby((r for b in batches for r in b.to_pylist()), key=itemgetter(*keys))


def _batches(found: Iterable[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    for some in batched(found, size):
        yield rows(schema, *zip(*some, strict=True))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(((*key, "".join(r["code"] for r in some)) for key, some in _stream(batches, "conv", "segment")), CODES)


def pairs(codes: str) -> list[tuple[str, str]]:
    return [(codes[k], codes[k + 1].replace("-", "")) for k in range(0, len(codes), 2)]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of conversations of one segment, the one path that is asked for."""
    some = (r for b in batches for r in b.to_pylist())
    yield from _batches(((r["conv"], r["segment"], r["codes"], [dict(zip(("begin", "end", "cost", "audit"), (START, ASSISTANT, *search(pairs(r["codes"]), START, ACCEPT)), strict=True))]) for r in some), PATHS)


def _all_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = (r for b in batches for r in b.to_pylist())
    yield from _batches(((r["conv"], r["segment"], r["codes"], [dict(zip(("begin", "end", "cost", "audit"), p, strict=True)) for p in paths(pairs(r["codes"]))]) for r in some), PATHS, 64)


def fold(parts: Iterable[dict]) -> tuple[int, int, int, int, int, str]:
    """Counts, cost and audit of a conversation, from its segments in order."""
    n = dict.fromkeys("bdt", 0)
    illegal, last, best = 0, "", {START: (0, "")}
    for p in parts:
        codes, after = p["codes"], {}
        for x in n:
            n[x] += codes[1::2].count(x)
        initials = last + codes[::2]
        illegal += sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
        last = initials[-1:]
        for x in p["paths"]:
            if x["begin"] in best:
                cost, audit = best[x["begin"]]
                found = cost + x["cost"], audit + x["audit"]
                if x["end"] not in after or found < after[x["end"]]:
                    after[x["end"]] = found
        best = after
    return *n.values(), illegal, *min(best[q] for q in ACCEPT if q in best)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(((key, *fold(parts)) for key, parts in _stream(batches, "conv")), FOLDED)


def repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits."""
    state = START
    for letter in audit:
        want, to = WANTS[state]
        if letter == "I":
            state = to
            yield NAMES[want], ""
            continue
        role, text = next(turns)
        if letter == "R":
            state = to
            yield NAMES[want], text
        elif letter == "K":
            state = NEXT[state, role[0]]
            yield role, text


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[tuple[str, str]]:
        for conv, some in _stream(batches, "conv"):
            audit, sha = next(some)["text"], hashlib.sha256()
            for k, (role, text) in enumerate(repaired(audit, ((r["role"], r["text"]) for r in some))):
                sha.update(f"{chr(10) * bool(k)}{role}:{text}".encode())
            for _ in some:  # none is left; a stream is read to its end
                pass
            yield conv, sha.hexdigest()

    yield from _batches(each(), HASHED)


def repair(conversations: DataFrame, also: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``also`` is applied to the rows first, such as ``damaged``; conversations that lose all their rows
    have zeros, an empty audit and the digest of nothing.
    """
    tune(conversations.sparkSession)
    some = ordered(also(conversations.select("conv_id", "turn", "role", "text")))
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    codes = coded(some).repartition("conv", "segment").sortWithinPartitions("conv", "segment", *order).select("conv", "segment", "code")
    segments = stored(codes.mapInArrow(_segments, "conv string, segment bigint, codes string"), "segments")
    kind = "conv string, segment bigint, codes string, paths array<struct<begin: bigint, end: bigint, cost: bigint, audit: string>>"
    counted = segments.withColumn("n", F.count("*").over(Window.partitionBy("conv")))
    whole = counted.where("n = 1").drop("n").mapInArrow(_whole, kind)
    long = counted.where("n > 1").drop("n").repartition("conv", "segment").mapInArrow(_all_paths, kind)
    folded = whole.unionByName(long).repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(_fold, "conv string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")
    folded = stored(folded, "edits")
    nil = lambda kind: F.lit(None).cast(kind)
    marks = folded.select("conv", F.lit(0).alias("kind"), nil("bigint").alias("turn"), nil("string").alias("role"), nil("binary").alias("digest"), F.col("audit").alias("text"))
    stream = some.select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text").unionByName(marks)
    digests = stream.repartition("conv").sortWithinPartitions("conv", "kind", *order).select("conv", "role", "text").mapInArrow(_digests, "conv string, repaired_sha256 string")
    turns = some.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = ids.join(folded, "conv", "left").join(digests, "conv", "left").join(turns, "conv", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "conv_id", *(F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
