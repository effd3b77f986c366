"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent parts of words, counted over the whole table, are compiled into an acyclic
automaton whose equal suffixes are shared. Its transitions carry numbers whose sum along
a word is the word's place in the lexicon, and with that its ids. Workers map the arrays
into memory and walk all distinct words of a batch at once, one letter per step. Words
that the lexicon lacks are merged exactly, again all at once: in each round every word
applies its best-ranked merge at the leftmost place. A long word without a break is
merged alone, by a heap of its merges, in a time that grows little faster than its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, fetched, id_and_text, own_memory, put_file, rows, shared_dir, stored, tune
from .word_bpe import Numbers, Sequences, byte_letters, cut_pieces, parts_of

#: Words in a lexicon at most: the most frequent ones; the others are merged.
WORDS = 1 << 17
#: Letters of a word from which on it is merged by a heap.
LONG = 96
#: Distinct pieces that a counting task holds before it sends them on.
HELD = 300_000
#: Pieces whose ids a worker remembers; beyond it, the memory starts afresh.
MEMO = 600_000

_BYTES = {c: b for b, c in enumerate(byte_letters())}
_NONE = np.iinfo(np.int64).max


class Rules:
    """What a tokenizer file says: merges by rank, letters, special tokens, and the token of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self._tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) or "(?!)")
        self.token = {i: t.encode() for t, i in [*vocab.items(), *self.special.items()]}
        self._inner = np.array([vocab[c] for c in byte_letters()], np.int64)
        self._last = np.array([vocab[c + end] for c in byte_letters()], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank = keys[order], order.astype(np.int64)
        self._into = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._ranks: dict[int, int] = {}

    def parts(self, piece: str) -> list[bytes | int]:
        """The parts of a piece that are merged one by one, as bytes, and ids of special tokens between them."""
        if (plain := parts_of(piece)) is not None:
            return [p.encode() if p.isascii() else bytes(map(_BYTES.__getitem__, p)) for p in plain]
        out: list[bytes | int] = []
        at = 0
        for m in [*self._special.finditer(piece), None]:
            if between := piece[at : m.start() if m else len(piece)]:
                text = self._tokenizer.normalizer.normalize_str(between)
                out += [bytes(map(_BYTES.__getitem__, p)) for p, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word: a heap has its merges by rank and place, links lead to the neighbours that are left."""
        if not self._ranks:
            self._ranks = dict(zip(self._keys.tolist(), self._rank.tolist(), strict=True))
        letters = np.frombuffer(word, np.uint8)
        sym = self._inner[letters].tolist()
        sym[-1] = int(self._last[letters[-1]])
        before, after = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        rank, into = self._ranks.get, self._into.tolist()
        todo = [(r, k) for k in range(len(sym) - 1) if (r := rank(sym[k] << 32 | sym[k + 1])) is not None]
        heapify(todo)
        while todo:
            r, k = heappop(todo)
            n = after[k]
            if sym[k] < 0 or n < 0 or rank(sym[k] << 32 | sym[n]) != r:
                continue
            sym[k], sym[n] = into[r], -1
            after[k] = n = after[n]
            if n >= 0:
                before[n] = k
                if (r := rank(sym[k] << 32 | sym[n])) is not None:
                    heappush(todo, (r, k))
            if (p := before[k]) >= 0 and (r := rank(sym[p] << 32 | sym[k])) is not None:
                heappush(todo, (r, p))
        return np.array([x for x in sym if x >= 0], np.int64)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by exact merging of all words at once."""
        out: list[np.ndarray] = [self.merge_long(w) if len(w) >= LONG else None for w in words]  # type: ignore[misc]
        who = np.array([k for k, x in enumerate(out) if x is None], np.int64)
        if not len(who):
            return out
        words = [words[k] for k in who.tolist()]
        letters = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(length)
        sym = self._inner[letters]
        sym[ends - 1] = self._last[letters[ends - 1]]
        while len(who):
            first = np.cumsum(length) - length
            word = np.repeat(np.arange(len(who)), length)
            rank = np.full(len(sym), _NONE)
            if len(sym) > 1:
                pair = sym[:-1] << 32 | sym[1:]
                at = np.searchsorted(self._keys, pair)
                at[at == len(self._keys)] = 0
                hit = (self._keys[at] == pair) & (word[:-1] == word[1:])
                rank[:-1][hit] = self._rank[at[hit]]
            best = np.minimum.reduceat(rank, first)
            done = best == _NONE
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[who[k]] = sym[first[k] : first[k] + length[k]]
                stay = ~done[word]
                sym, rank, word = sym[stay], rank[stay], (np.cumsum(~done) - 1)[word[stay]]
                who, length, best = who[~done], length[~done], best[~done]
            if not len(who):
                break
            here = np.flatnonzero(rank == best[word])
            w = word[here]
            here = here[np.concatenate([[True], w[1:] != w[:-1]])]
            sym[here] = self._into[best]
            keep = np.ones(len(sym), bool)
            keep[here + 1] = False
            sym, length = sym[keep], length - 1
        return out


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of ascending distinct words, numbered: arrays of its transitions.

    ``key`` is state << 8 | letter, ascending; ``to`` the next state; ``add`` the words
    before those that go this way; ``final`` says which states end a word. State 0 is the start.
    """
    register: dict[tuple, int] = {}
    edges: list[dict[int, int]] = []
    final: list[bool] = []

    def frozen(state: tuple[dict[int, int], bool]) -> int:
        key = (state[1], *state[0].items())
        if key not in register:
            register[key] = len(edges)
            edges.append(state[0])
            final.append(state[1])
        return register[key]

    path: list[list] = [[{}, False]]  # the states along the last word, not shared yet
    last = b""
    for w in words:
        if w <= last:
            raise ValueError("words must ascend")
        common = next((k for k, (a, b) in enumerate(zip(w, last, strict=False)) if a != b), min(len(w), len(last)))
        while len(path) > common + 1:
            state = path.pop()
            path[-1][0][last[len(path) - 1]] = frozen(state)
        path += [[{}, False] for _ in range(len(w) - common)]
        path[-1][1] = True
        last = w
    while len(path) > 1:
        state = path.pop()
        path[-1][0][last[len(path) - 1]] = frozen(state)
    root = len(edges)
    edges.append(path[0][0])
    final.append(path[0][1])
    count = [0] * len(edges)  # words from a state on; a state's followers are numbered before it
    key, to, add = [], [], []
    for s, out in enumerate(edges):
        n = int(final[s])
        for letter, t in sorted(out.items()):
            key.append((root - s) << 8 | letter)
            to.append(root - t)
            add.append(n)
            n += count[t]
        count[s] = n
    order = np.argsort(np.array(key, np.int64))
    return {"key": np.array(key, np.int64)[order], "to": np.array(to, np.int32)[order], "add": np.array(add, np.int32)[order], "final": np.array(final[::-1], np.uint8)}


@dataclass
class Lexicon:
    """Arrays of a compiled lexicon: the automaton's, and each word's ids from ``start[k]`` to ``start[k + 1]``."""

    arrays: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, words: list[bytes], rules: Rules) -> Lexicon:
        words = sorted(words)
        ids = rules.merge(words) if words else []
        start = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return cls(compile_words(words) | {"start": start, "ids": np.concatenate([*ids, np.empty(0)]).astype("<u4")})

    def save(self, folder: str) -> None:
        import io

        for name, a in self.arrays.items():
            out = io.BytesIO()
            np.save(out, a, allow_pickle=False)
            put_file(f"{folder}/{name}.npy", iter([out.getvalue()]))

    @classmethod
    def load(cls, folder: str) -> Lexicon:
        return cls({n: np.load(fetched(f"{folder}/{n}.npy"), mmap_mode="r").view(np.ndarray) for n in ("key", "to", "add", "final", "start", "ids")})

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon; -1: it isn't there."""
        key, to, add = self.arrays["key"], self.arrays["to"], self.arrays["add"]
        out = np.full(len(words), -1, np.int64)
        if not len(key) or not words:
            return out
        length = np.array([len(w) for w in words])
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.cumsum(length) - length
        live, state, place = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            ended = length[live] == step
            if ended.any():
                at_end = live[ended]
                good = self.arrays["final"][state[ended]] == 1
                out[at_end[good]] = place[ended][good]
                live, state, place = live[~ended], state[~ended], place[~ended]
            ask = state << 8 | letters[first[live] + step]
            at = np.searchsorted(key, ask)
            at[at == len(key)] = 0
            hit = key[at] == ask
            at, live = at[hit], live[hit]
            state, place = to[at].astype(np.int64), place[hit] + add[at]
            step += 1
        return out


class Codec:
    """Encodes and decodes texts, by a lexicon where it has the word."""

    def __init__(self, path: str, folder: str):
        self.rules, self.lexicon = Rules(path), Lexicon.load(folder)
        token = [self.rules.token.get(i, b"") + b" " for i in range(max(self.rules.token) + 1)]
        self._token = Sequences("u1")
        self._token.add(np.frombuffer(b"".join(token), np.uint8), np.array([len(t) for t in token], np.int64))
        self._forget()

    def _forget(self) -> None:
        self._piece, self._part = Numbers(), Numbers()
        self._of_piece, self._of_part = Sequences("<u4"), Sequences("<u4")

    def _ids_of_parts(self, parts: list[bytes]) -> dict[bytes, bytes]:
        a = self.lexicon.arrays
        place = self.lexicon.places(parts)
        found = place >= 0
        start, end = (4 * a["start"][place[found]]).tolist(), (4 * a["start"][place[found] + 1]).tolist()
        raw = a["ids"].view(np.uint8)
        out = {parts[k]: raw[x:y].tobytes() for k, x, y in zip(np.flatnonzero(found).tolist(), start, end, strict=True)}
        unseen = [parts[k] for k in np.flatnonzero(~found).tolist()]
        if unseen:
            out.update(zip(unseen, (x.astype("<u4").tobytes() for x in self.rules.merge(unseen)), strict=True))
        return out

    def _learn(self) -> None:
        """Encodes the pieces that were numbered, but aren't known yet."""
        new = self._piece.new
        if not new:
            return
        low, counts, other = cut_pieces(new)
        parts, order, odd = low.split(b" ")[:-1], np.flatnonzero(~other), np.flatnonzero(other)
        apart = [self.rules.parts(new[k].decode()) for k in odd.tolist()]
        which = self._part.of(parts, len(parts))
        inner = [self._part[x] for ps in apart for x in ps if isinstance(x, bytes)]
        if self._part.new:
            found = self._ids_of_parts(self._part.new)
            raw = [found[p] for p in self._part.new]
            self._of_part.add(np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64))
            self._part.new.clear()
        ids, length = self._of_part.of(which)
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts[~other])]
        inner = iter(inner)
        some = [[np.array([x], "<u4") if isinstance(x, int) else self._of_part.of(np.array([next(inner)]))[0] for x in ps] for ps in apart]
        n = [sum(map(len, xs)) for xs in some]
        self._of_piece.add(np.concatenate([ids, *chain.from_iterable(some)]), np.concatenate([np.diff(ends, prepend=0), n]).astype(np.int64), np.concatenate([order, odd]))
        new.clear()

    def decode(self, ids: bytes) -> bytes:
        """The tokens of ids, a space between them, as the library joins them without a decoder."""
        return self._token.of(np.frombuffer(ids, "<u4"))[0].tobytes()[:-1]

    def round_trip(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids (little-endian, 32 bits) and decoded text of each text."""
        if len(self._piece) > MEMO:
            self._forget()
        cuts = [t.split() for t in texts]
        n = np.array([len(c) for c in cuts], np.int64)
        which = self._piece.of(chain.from_iterable(cuts), int(n.sum()))
        self._learn()
        ids, length = self._of_piece.of(which)
        at = (4 * np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(n)])]).tolist()
        raw = ids.tobytes()
        for a, b in zip(at, at[1:], strict=False):
            yield raw[a:b], self.decode(raw[a:b])


_CODECS: dict[tuple[str, str], Codec] = {}
_RULES: dict[str, Rules] = {}


def codec(path: str, folder: str) -> Codec:
    own_memory("codecs", _CODECS.clear)
    if (path, folder) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, folder] = Codec(path, folder)
    return _CODECS[path, folder]


def rules(path: str) -> Rules:
    if path not in _RULES:
        _RULES[path] = Rules(path)
    return _RULES[path]


_PARTS = pa.schema([("part", pa.binary()), ("n", pa.int64())])


def _count_parts(path: str):
    def send(held: Counter) -> pa.RecordBatch:
        n: Counter = Counter()
        for p, k in held.items():
            for x in rules(path).parts(p.decode()):
                if isinstance(x, bytes):
                    n[x] += k
        return rows(_PARTS, list(n), list(n.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in byte_texts(b):
                held.update(t.split())
            if len(held) > HELD:
                yield send(held)
                held = Counter()
        if held:
            yield send(held)

    return run


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of (part, n), those of the highest n but for the last few bits of it; ties go by a hash.

    Rows are counted by their n's leading bits, and those of the group that doesn't fit whole by
    their hashes' leading bits, so the driver gets a few thousand numbers however large the table is.
    """
    bits = F.length(F.bin("n")).cast("int")
    level = bits * 64 + F.expr("int(shiftright(n, greatest(length(bin(n)) - 6, 0)))")
    cell = F.shiftrightunsigned(F.xxhash64("part"), 48)
    marked = counted.select("part", level.alias("level"), cell.alias("cell"))

    def fitting(groups: DataFrame, column: str, room: int, high: bool) -> tuple[int | None, int]:
        """The first group that doesn't fit as a whole, and the room that is left for it."""
        for r in sorted(groups.groupBy(column).agg(F.count("*").alias("m")).collect(), key=lambda r: r[column], reverse=high):
            if r["m"] > room:
                return r[column], room
            room -= r["m"]
        return None, room

    last, room = fitting(marked, "level", most, True)
    if last is None:
        return marked.select("part")
    edge, _ = fitting(marked.where(F.col("level") == last), "cell", room, False)
    return marked.where((F.col("level") > last) | ((F.col("level") == last) & (F.col("cell") < edge))).select("part")


def build_lexicon(docs: DataFrame, path: str, most: int = WORDS) -> str:
    """Counts all parts, compiles the most frequent (``most`` at most, seen twice at least), and returns the folder."""
    folder = shared_dir(docs.sparkSession, "lexicon")
    counted = stored(docs.mapInArrow(_count_parts(path), "part binary, n bigint").groupBy("part").agg(F.sum("n").alias("n")).where("n > 1"), "parts")
    words = [bytes(r["part"]) for r in most_frequent(counted, most).select("part").collect()]
    Lexicon.build(words, rules(path)).save(folder)
    return folder


_TRIPS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _trips(path: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()) for ids, text in codec(path, folder).round_trip(byte_texts(b))]
            yield rows(_TRIPS, b.column("doc_id"), *(zip(*out, strict=True) if out else [[]] * 3))

    return run


def round_trip(docs: DataFrame, path: str, most: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded again.

    A null or empty text has no ids; rows stay one to one, whatever their doc_id;
    columns besides doc_id and text are not read.
    """
    tune(docs.sparkSession)
    docs = id_and_text(docs)
    folder = build_lexicon(docs, path, most)
    return docs.mapInArrow(_trips(path, folder), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
