"""Cutting and encoding of pieces at once."""

import random

from tokenizers import Tokenizer

from tocsin.llm import lexicon, queries, word_bpe


def test_encoder_cuts_pieces_at_once():
    """A batch's new pieces are cut together, with the parts that the pattern gives for each alone; only odd ones are cut apart."""
    rng = random.Random(5)
    letters = "aBzÀÖ×ÞßàöøÿŸ÷09'’.,!<|>_Å€漢\x01\x7f\x80İſK-"
    pieces = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))).encode() for _ in range(3000)} - {b""})
    pieces = [p for p in pieces if len(p.split()) == 1]
    low, counts, other = word_bpe.cut_pieces(pieces)
    parts = iter((low.decode("latin-1").translate(word_bpe._LETTERS).replace(word_bpe._LETTERS[32], " ")).split(" "))
    for p, n, o in zip(pieces, counts.tolist(), other.tolist(), strict=True):
        plain = word_bpe.parts_of(p.decode())
        assert o == (plain is None or b"'" in p) and (o or [next(parts) for _ in range(n)] == plain)
    assert 500 < other.sum() < len(pieces) - 200


def test_encoder_forgets_between_batches():
    """Ids are the library's when the memory starts afresh with each batch, over texts of plain, odd and no pieces."""
    path = queries.tokenizer(queries.WORD_BPE)
    texts = ["Don't, WE'LL 'S x<|endoftext|>y É×Ö 12a", "", " ", "plain words, plain words.", "漢 \x7f a\x01b"]
    encoder, library = word_bpe.LibraryEncoder(path, memo=1), Tokenizer.from_file(path)
    for _ in range(2):
        got = encoder.encode([t.encode() for t in texts])
        assert [memoryview(x).cast("I").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder._of_piece._length) == len({w for t in texts for w in t.encode().split()})


def test_codec_by_arrays(tmp_path, monkeypatch):
    """Ids and decoded texts are the library's, with special tokens, odd pieces and a memory that starts afresh with each batch."""
    path, folder = queries.tokenizer(queries.WORD_BPE), f"file://{tmp_path}"
    lexicon.Lexicon.build([b"plain", b"words"], lexicon.Rules(path)).save(folder)
    monkeypatch.setattr(lexicon, "MEMO", 1)
    texts = ["Don't, WE'LL 'S x<|endoftext|>y É×Ö 12a", "", " ", "plain words, plain words.", "漢 \x7f a\x01b"]
    codec, library = lexicon.Codec(path, folder), Tokenizer.from_file(path)
    for _ in range(2):
        ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
        got = [(memoryview(i).cast("I").tolist(), t.decode()) for i, t in codec.round_trip([t.encode() for t in texts])]
        assert got == [(i, library.decode(i, skip_special_tokens=False)) for i in ids]
        assert len(codec._of_piece._length) == len({w for t in texts for w in t.encode().split()})
