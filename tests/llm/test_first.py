"""PII, packing, quality rules, token files and media against plain versions."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.odd import ROWS, none, odd
from tocsin.llm import media, packing, pii, quality, queries, tokenfile

WORDS = queries.tokenizer(queries.WORD_BPE)


def all_texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(text):
    mail = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return {"email": mail, "ip": ip, "card": card, "phone": phone}


def test_pii_base_spans(spark, sf):
    rng = np.random.default_rng(5)
    odd_ones = ["".join(rng.choice(list("a1@. +-(%2345 0"), 60)) for _ in range(3000)] + ["".join(rng.choice(list("0123456789 -.+"), 80)) for _ in range(2000)]
    for t in [*all_texts(spark, sf).values(), *odd_ones, *(r[1] or "" for r in ROWS)]:
        want, got = base_spans(t), pii.find(t)
        assert {k: got[k] for k in want} == want, t
        for s in got.values():
            assert all(a < b for a, b in s) and all(x[1] <= y[0] for x, y in zip(s, s[1:], strict=False))


def added_spans(text):
    """The added kinds by plain patterns over the whole text."""
    take = lambda spans: [s for k, s in enumerate(spans) if not any(a < s[1] and s[0] < b for a, b in spans[:k])]
    street = []
    for cue in re.finditer("|".join(map(re.escape, pii.STREET_CUES)), text):
        left = re.search(r"[0-9]{1,5}[A-Za-z]? (?:[A-Z][\w'-]* ){0,3}$", text[: cue.start()])
        if left:
            street.append((left.start(), cue.end()))
    iban = []
    for m in re.finditer(r"(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))", text):
        start, end = m.span(1)
        while end - start >= 15:
            code = text[start:end].replace(" ", "")
            if 15 <= len(code) <= 34 and text[end - 1] != " " and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                iban.append((start, end))
                break
            end -= 1
    return {"address": street, "iban": take(iban)}


def test_pii_added_spans():
    rng = np.random.default_rng(6)
    words = ["12", "7B", "123456", "Elm", "Tree", "O'Neil-Smith", "street", "Street", "Street,", "of", "É", "A" * 90, "Lane", "Road", "_x", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432x", "at", "5C", "\n"]
    for _ in range(4000):
        t = rng.choice([" ", " ", " ", "  ", ""]).join(rng.choice(words, rng.integers(1, 9)))
        got, want = pii.find(t), added_spans(t)
        assert [got["address"], got["iban"]] == [want["address"], want["iban"]], t
    long = f"at 12 {'B' * 5000} {'C' * 5000} Street"
    assert pii.find(long)["address"] == [(3, len(long))]


def test_pii_rows(spark):
    got = {r.doc_id: r for r in pii.spans(odd(spark)).collect()}
    assert len(got) == len(ROWS) - 1 and pii.spans(none(spark)).count() == 0
    assert (got[0].n_email, got[0].spans, got[0].base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert got[7].n_email == 2 and got[7].n_ip == 3 and got[7].n_card == 1 and got[7].n_phone == 1 and "url:" in got[7].spans
    assert all(k in got[8].spans for k in ("secret:", "iban:", "address:"))
    red = {r.doc_id: r for r in pii.redact(odd(spark)).collect()}
    assert red[0].text is None and "[EMAIL]" in red[7].text and "bob" not in red[7].text and red[7].n_chars == len(red[7].text)
    assert set(pii.redact(odd(spark)).columns) == set(odd(spark).columns)


def library(docs):
    t = Tokenizer.from_file(WORDS)
    return {i: t.encode(x, add_special_tokens=False).ids for i, x in docs.items()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def check_packed(rows, want):
    at = {}
    for r in rows:
        ids = want[r.doc_id]
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and r.start == 4096 * r.piece and 0 < r.length <= 4096
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in at.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= 4096
    assert Counter(r.doc_id for r in rows) == Counter({i: -(-len(x) // 4096) for i, x in want.items()})
    return len(at)


def test_packing(spark, sf):
    want = {i: [*x, 1] for i, x in library(all_texts(spark, sf)).items()}
    n = check_packed(queries.op2_packing(spark, sf).collect(), want)
    # best-fit decreasing, one piece at a time
    room = []
    for length in sorted((len(x[k : k + 4096]) for x in want.values() for k in range(0, len(x), 4096)), reverse=True):
        fit = min((r for r in room if r >= length), default=None)
        if fit is None:
            room.append(4096 - length)
        else:
            room.remove(fit)
            room.append(fit - length)
    assert n == len(room)


def test_packing_odd(spark):
    rows = [r for r in ROWS if r[0] is not None and r[1] != "again three"]
    want = {i: [*x, 1] for i, x in library({r[0]: r[1] or "" for r in rows}).items()}
    check_packed(packing.pack(odd(spark).where("doc_id IS NOT NULL AND NOT text <=> 'again three'"), WORDS).collect(), want)
    assert packing.pack(odd(spark), WORDS).where("doc_id IS NULL").count() == 1 and packing.pack(none(spark), WORDS).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_runs(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, [8, 64, 100][seed % 3], 300).tolist(), reverse=True)
    room = []
    for n in lengths:
        fit = min((r for r in room if r >= n), default=None)
        if fit is not None:
            room.remove(fit)
        room.append((100 if fit is None else fit) - n)
    runs, bins = packing.best_fit_decreasing(dict(Counter(lengths)), 100)
    assert bins == len(room)
    placed = {}
    for n, c in Counter(lengths).items():
        for rank in range(c):
            first, bin0, per, fill = [r for r in runs[n] if r[0] <= rank][-1]
            placed.setdefault(bin0 + (rank - first) // per, []).append((fill + (rank - first) % per * n, n))
    for s in placed.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= 100
    assert len(placed) == bins


def brute_counts(t):
    w = re.findall("[^\x20\x09-\x0d]+", t)
    win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    times = Counter(win)
    marked = {j for k, x in enumerate(win) if times[x] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(marked)


def test_quality_counts(spark, sf):
    for t in [*all_texts(spark, sf).values(), *(r[1] or "" for r in ROWS), "a b c d e a b c d e a b c d e f", "x " * 50]:
        assert quality.counts(t)[:5] == brute_counts(t)


def test_quality_rules(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good = got[(got.quality == 1) & ~got.base_failed]
    assert good.kept.mean() > 0.99 and 1 - got[got.quality == 0].kept.mean() > 0.9
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in quality.judge(odd(spark), labels).collect()}
    assert out[0].base_failed and not out[0].kept and out[0].n_words == 0
    assert quality.judge(none(spark), labels).count() == 0 and quality.judge(odd(spark), labels.where("false")).count() == len(ROWS)


def test_quality_verdict(spark):
    """Each row's verdict is that of the first rule that holds for its counts, evaluated plainly."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.train(docs, labels)
    sides = {name: (up, down) for name, up, down in quality.RATES}
    rows = quality.judge(docs, labels).collect()
    for r in rows:
        def rate(name):
            up, down = sides[name]
            return r[up] / (max(r[down], 1) if down else 1)  # noqa: B023

        first = next((k for k, rule in enumerate(rules, 1) if all((rate(c.rate) >= c.at) == c.above for c in rule)), 0)
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert (r.rule, r.base_failed, r.kept) == (first, failed, not failed and not first)
    assert len(rules) > 1 and len({r.rule for r in rows}) == len(rules) + 1


def test_simple8b():
    rng = np.random.default_rng(1)
    for v in ([], [0], [2**64 - 1, 2**60, 2**59, 2**59 - 1, 0, 5], np.zeros(1000), rng.integers(0, 49408, 5000), rng.integers(0, 2, 3001), np.exp2(rng.uniform(0, 63, 4000)), np.concatenate([np.zeros(500), np.ones(130), rng.integers(0, 2**40, 9)])):
        v = np.array(v, np.uint64)
        words, escapes = tokenfile.encode_words(v)
        assert (tokenfile.decode_words(words, escapes)[: len(v)] == v).all() and len(tokenfile.decode_words(words, escapes)) == len(v)
    assert len(tokenfile.encode_words(np.zeros(480, np.uint64))[0]) == 2 and len(tokenfile.encode_words(np.full(400, 30000, np.uint64))[0]) == 100


def test_token_files(spark, sf, tmp_path):
    want, start = {i: [*x, 2] for i, x in library(all_texts(spark, sf)).items()}, 0
    for r in queries.op4_token_file(spark, sf).orderBy("doc_id").collect():
        ids = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    got = tokenfile.round_trip(odd(spark), WORDS).collect()
    assert len(got) == len(ROWS) and sum(r.doc_id is None for r in got) == 1
    want = library({k: r[1] or "" for k, r in enumerate(ROWS)})
    assert Counter(r.ids_crc32 for r in got) == Counter(crc([*x, 2]) for x in want.values())
    assert tokenfile.round_trip(none(spark), WORDS).count() == 0


def plain_feature(image):
    """Size and difference hash by areas that are cut into equal small cells and averaged."""
    h, w = image.shape
    fine = image.astype(float).repeat(8, 0).repeat(9, 1).reshape(8, h, 9, w).mean(axis=(1, 3))
    near = np.abs(fine - np.floor(fine) - 0.5) < 1e-6  # a mean of half a step may be rounded either way
    if near.any():
        fine = media.area_resize(image, 8, 9)
    tile = np.rint(fine)
    bits = "".join("1" if tile[y, x + 1] > tile[y, x] else "0" for y in range(8) for x in range(8))
    return f"{w}x{h}:{int(bits, 2):016x}"


def test_tiles(spark, tmp_path):
    """Each row's tile is in the file that it names, also of those that a limit leaves."""
    made = media.to_media(odd(spark)).withColumn("feature", F.lit(1)).withColumn("tile_file", F.lit("x"))
    had = {(r.doc_id, r.n_bytes): bytes(r.media) for r in made.collect()}
    got = media.features(made, f"file://{tmp_path}").limit(7).collect()
    assert len(got) == 7
    for r in got:
        tile = np.load(f"{tmp_path}/{r.tile_file}")[r.tile_index]
        assert (tile == np.rint(media.area_resize(media.decode(had[r.doc_id, r.n_bytes]), 8, 9))).all()


def test_broken_media(spark):
    """Null, empty, cut, unknown and empty-sized images have a problem and no feature; whole ones beside them are unharmed."""
    good = media.encode_pgm(np.arange(128, dtype=np.uint8).reshape(2, 64))
    bmp = media.encode_bmp(np.arange(128, dtype=np.uint8).reshape(2, 64))
    bad = [None, b"", b"x", b"P5", b"P5\n3", good[:-1], bmp[:60], bmp[:-1], b"P5\n0 5\n255\n", b"P7\nWIDTH 3\nENDHDR\n", b"BM" + b"\xff" * 60, b"P9 1 1 1 1"]
    rows = [(k, 0, bytearray(x) if x is not None else None) for k, x in enumerate([*bad, good, bmp, good])]
    got = {r.doc_id: r for r in media.features(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert len(got) == len(rows)
    for k in range(len(bad)):
        assert got[k].feature is None and got[k].payload_sha256 is None and got[k].tile_file is None and got[k].problem, k
    n = len(bad)
    assert got[n].feature == got[n + 1].feature == got[n + 2].feature and got[n].problem is None and got[n].payload_sha256 == got[n + 1].payload_sha256


def test_image_kinds():
    bits = np.array([[1, 0, 1, 1, 0, 0, 0, 1, 1], [0, 1, 0, 0, 1, 1, 1, 0, 1]], np.uint8)
    want = (1 - bits) * 255
    assert (media.decode(b"P1 9 2\n# x\n" + b"".join(b"%d" % x for x in bits.flat)) == want).all()
    assert (media.decode(b"P4 9 2\n" + np.packbits(bits, axis=1).tobytes()) == want).all()
    assert media.decode(b"P7\nWIDTH 2\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\nabcdefgh").tolist() == [[[97, 98, 99, 100], [101, 102, 103, 104]]]
    assert media.decode(b"P5 2 1 65535\n\x01\x02\x03\x04").tolist() == [[258, 772]]

    def bmp(w, h, depth, palette, body):
        at = 54 + len(palette)
        return b"BM" + struct.pack("<I2HI", at + len(body), 0, 0, at) + struct.pack("<I2i2H6I", 40, w, h, 1, depth, 0, len(body), 0, 0, len(palette) // 4, 0) + palette + body

    assert media.decode(bmp(3, 1, 1, bytes([0, 0, 0, 0, 255, 255, 255, 0]), b"\xa0\0\0\0")).tolist() == [[255, 0, 255]]
    assert media.decode(bmp(3, -2, 4, bytes([1, 1, 1, 0, 9, 9, 9, 0]), b"\x01\x10\0\0\x11\x00\0\0")).tolist() == [[1, 9, 9], [9, 9, 1]]
    assert media.decode(bmp(1, 1, 16, b"", struct.pack("<H", 31 << 10 | 16) + b"\0\0")).tolist() == [[[255, 0, 131]]]
    assert media.decode(bmp(1, 1, 24, b"", b"abc\0")).tolist() == [[[99, 98, 97]]]


def test_media(spark, sf):
    docs = all_texts(spark, sf)
    got = queries.op9_media(spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        image = np.frombuffer(p, np.uint8).reshape(-1, 64)
        assert r.feature == plain_feature(image) and r.problem is None
    out = {r.doc_id: r for r in media.features(media.to_media(odd(spark))).collect()}
    assert out[0].payload_bytes == 64 and out[5].feature == out[6].feature and media.features(media.to_media(none(spark))).count() == 0


def test_images():
    rng = np.random.default_rng(2)
    grey = rng.integers(0, 256, (7, 10), dtype=np.uint8)
    for raw in (media.encode_pgm(grey), media.encode_bmp(grey), b"P2 # note\n10 7\n255\n" + b" ".join(b"%d" % x for x in grey.flat)):
        assert (media.decode(raw) == grey).all()
    assert media.decode(b"P6\n1 1\n255\nabc").tolist() == [[[97, 98, 99]]]
    big = grey.astype(float).repeat(8, 0).repeat(9, 1)
    want = big.reshape(8, 7, 9, 10).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(grey, 8, 9), want)
