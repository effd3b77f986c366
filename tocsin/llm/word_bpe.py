"""Splitting and encoding of texts for tokenizer files of the word-end BPE kind.

The normalizer and the splitting pattern of such a file never look across ASCII
white space, so a text's ids are the ids of its white-space-separated pieces in
order. Each distinct piece is encoded once per worker and remembered by a number; a batch's
ids are put together from the numbers of its pieces, by array operations.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from .common import own_memory

#: Printable ASCII and the Latin-1 letters: for these, the file's normalizer is str.lower().
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The splitting pattern of the file, for plain characters.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Pieces remembered by a worker; beyond it, the memory starts afresh.
MEMO = 1_000_000
#: Runs that are put together at once.
TOGETHER = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))


def parts_of(piece: str) -> list[str] | None:
    """The byte-letter parts of a piece that BPE encodes one by one; None: ask the library."""
    if not _PLAIN.fullmatch(piece) or "<|" in piece:
        return None
    low = piece.lower()
    if low.isascii():
        return _PARTS.findall(low)
    return [p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS) for p in _PARTS.findall(low)]


#: Of each byte of a plain piece without an apostrophe: 0 letter, 1 digit, 2 other; 3: no such byte.
_KIND = np.full(256, 3, np.uint8)
_KIND[33:127] = 2
_KIND[ord("'")] = 3
_KIND[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3]] = 0
_KIND[48:58] = 1


def cut_pieces(pieces: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of all pieces at once: their parts in lower case, a space after each, the number of parts of each piece, and which
    pieces aren't cut here, as they aren't plain or have an apostrophe; these have no parts.
    """
    x = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    kind = _KIND[x]
    kind[ends] = 4
    wide = (x >= 128) & (x < 192)  # the second byte of a letter of two: only after C3, and no sign of multiplication or division
    odd = kind == 3
    odd[1:] |= (wide[1:] & (x[:-1] != 0xC3)) | ((x[1:] == ord("|")) & (x[:-1] == ord("<")))
    odd |= wide & ((x == 0x97) | (x == 0xB7))
    first = np.concatenate([[0], ends[:-1] + 1])
    other = np.logical_or.reduceat(odd, first)
    low = x + ((((x >= 65) & (x < 91)) | (wide & (x < 0x9F))) * np.uint8(32)).astype(np.uint8)
    begins = kind != 4
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 1)
    if other.any():
        keep = ~np.repeat(other, ends - first + 1)
        low, begins, kind = low[keep], begins[keep], kind[keep]
    counts = np.zeros(len(pieces), np.int64)
    at = np.flatnonzero(begins)
    piece = np.cumsum(kind == 4) - (kind == 4)  # the place of each byte's piece among those that are cut
    counts[~other] = np.bincount(piece[at], minlength=int((~other).sum()))
    inner = at[kind[at - 1] != 4] if len(at) else at
    return np.insert(low, inner[inner > 0], ord(" ")).tobytes(), counts, other


class Numbers(dict):
    """Numbers of keys in the order in which they were first asked for; ``new`` has those not learned yet."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def of(self, keys, n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, n)


class Sequences:
    """Numbered sequences in one array."""

    def __init__(self, kind: str):
        self._flat, self._start, self._length = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, length: np.ndarray, order: np.ndarray | None = None) -> None:
        """Numbers more sequences, which lie one after the other in ``flat``; in ``order``, which of the new ones each is."""
        start = np.cumsum(length) - length + len(self._flat)
        if order is not None:
            back = np.argsort(order)
            start, length = start[back], length[back]
        self._flat = np.concatenate([self._flat, flat])
        self._start, self._length = np.concatenate([self._start, start]), np.concatenate([self._length, length])

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These sequences, one after the other, and their lengths."""
        length, out = self._length[which], [self._flat[:0]]
        for k in range(0, len(which), TOGETHER):
            n, start = length[k : k + TOGETHER], self._start[which[k : k + TOGETHER]]
            ends = np.cumsum(n)
            out.append(self._flat[np.repeat(start - ends + n, n) + np.arange(ends[-1])])
        return np.concatenate(out), length


def word_end(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"]["end_of_word_suffix"] or ""


class LibraryEncoder:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit bytes per text."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._memo = memo
        self._whole = Tokenizer.from_file(path)
        self._whole.no_truncation()
        self._whole.no_padding()
        self._parts = Tokenizer(self._whole.model)
        self._parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, self._ends = word_end(path), np.zeros(self._whole.get_vocab_size(), bool)
        self._ends[[k for t, k in self._whole.get_vocab().items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self._piece, self._part = Numbers(), Numbers()
        self._of_piece, self._of_part = Sequences("<u4"), Sequences("<u4")

    def _learn_parts(self) -> None:
        new, found, length = self._part.new, [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for k in range(0, len(new), 500):
            some = new[k : k + 500]
            ids = np.asarray(self._parts.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a part doesn't end with an id of a word's end")
            found.append(ids)
            length.append(np.diff(ends, prepend=0))
        self._of_part.add(np.concatenate(found), np.concatenate(length))
        new.clear()

    def _learn(self) -> None:
        """Makes the pieces known that were numbered, but not yet encoded."""
        new = self._piece.new
        if not new:
            return
        low, counts, other = cut_pieces(new)
        parts = (low.decode() if low.isascii() else low.decode("latin-1").translate(_LETTERS).replace(_LETTERS[32], " ")).split(" ")[:-1]
        order, counts, whole = np.flatnonzero(~other).tolist(), counts[~other].tolist(), []
        for k in np.flatnonzero(other).tolist():
            if (c := parts_of(new[k].decode())) is None:
                whole.append(k)
            else:
                parts += c
                counts.append(len(c))
                order.append(k)
        which = self._part.of(parts, len(parts))
        self._learn_parts()
        ids, length = self._of_part.of(which)
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts, dtype=np.int64)]
        asked = [np.asarray(e.ids, "<u4") for e in self._whole.encode_batch_fast([new[k].decode() for k in whole], add_special_tokens=False)]
        self._of_piece.add(np.concatenate([ids, *asked]), np.concatenate([np.diff(ends, prepend=0), [len(x) for x in asked]]).astype(np.int64), np.array(order + whole, np.int64))
        new.clear()

    def encode(self, docs: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if len(self._piece) > self._memo:
            self._forget()
        cut = [d.split() for d in docs]
        n = np.array([len(c) for c in cut], np.int64)
        which = self._piece.of(chain.from_iterable(cut), int(n.sum()))
        self._learn()
        ids, length = self._of_piece.of(which)
        at = (4 * np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(n)])]).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """This worker's encoder for a tokenizer file."""
    own_memory("encoders", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]
