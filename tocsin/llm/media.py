"""Media columns: Netpbm and BMP images as numpy arrays, tiles and difference hashes.

Media are a column of a stored table. Features are computed from what is read back. An
image that can't be decoded has no features but a stated problem; nothing fails for it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import byte_texts, id_and_text, put_file, rows, shared_dir, tune

#: Samples in a row of a payload's image.
WIDTH = 64
#: Rows and columns of a tile: a difference hash compares neighbours in a row.
TILE = (8, 9)
#: Tiles in one NPY file, about.
STACK = 16_384


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary grey Netpbm file (P5) of a two-dimensional array of 8-bit samples."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A grey BMP file (8 bits, palette, bottom row first) of a two-dimensional array."""
    h, w = samples.shape
    line = -(-w // 4) * 4
    body = np.zeros((h, line), np.uint8)
    body[:, :w] = samples[::-1]
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256))
    at = 54 + len(palette)
    return b"BM" + struct.pack("<I2HI", at + body.size, 0, 0, at) + struct.pack("<I2i2H6I", 40, w, h, 1, 8, 0, body.size, 2835, 2835, 256, 0) + palette + body.tobytes()


def _netpbm_header(raw: bytes, n: int) -> tuple[list[int], int]:
    """The first n numbers after the magic, and the offset after them and one white-space character."""
    got: list[int] = []
    at = 2
    while len(got) < n:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a Netpbm header lacks a number")
        got.append(int(raw[at:end]))
        at = end
    return got, at + 1


def _samples(raw: bytes, at: int, shape: tuple[int, ...], top: int) -> np.ndarray:
    """Binary samples, of one byte or two by their highest value."""
    n, kind = int(np.prod(shape)), np.dtype(np.uint8 if top < 256 else ">u2")
    if len(raw) < at + n * kind.itemsize:
        raise ValueError("the image is cut off")
    return np.frombuffer(raw, kind, n, at).reshape(shape)


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P7 with samples of 1, 8 or 16 bits: height x width, or x its channels; a bit's 1 is black, 0."""
    kind = raw[:2]
    if kind == b"P7":
        head, end, _ = raw.partition(b"ENDHDR\n")
        values = dict(x.split(None, 1) for x in head.split(b"\n") if b" " in x and not x.startswith(b"#"))
        w, h, depth, top = (int(values[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        return _samples(raw, len(head) + len(end), (h, w, depth) if depth > 1 else (h, w), top)
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm or BMP image")
    bits = kind in (b"P1", b"P4")
    (w, h, *rest), at = _netpbm_header(raw, 2 if bits else 3)
    top = 1 if bits else rest[0]
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    if kind == b"P4":
        packed = _samples(raw, at, (h, -(-w // 8)), 1)
        return (1 - np.unpackbits(packed, axis=1)[:, :w]) * np.uint8(255)
    if kind in (b"P1", b"P2", b"P3"):
        body = b"\n".join(x.partition(b"#")[0] for x in raw[at - 1 :].split(b"\n"))
        words = [bytes((c,)) for c in body if c in b"01"] if kind == b"P1" else body.split()
        if len(words) < int(np.prod(shape)):
            raise ValueError("the image is cut off")
        flat = np.array(words[: int(np.prod(shape))], np.int64)
        return ((1 - flat) * 255 if kind == b"P1" else flat).astype(np.uint8 if top < 256 else np.uint16).reshape(shape)
    return _samples(raw, at, shape, top)


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 16 (5 bits a channel), 24 or 32 bits: height x width if grey, else x 3 (red, green, blue)."""
    if len(raw) < 54:
        raise ValueError("the image is cut off")
    at = struct.unpack_from("<I", raw, 10)[0]
    size, w, h, _, bits, packed = struct.unpack_from("<I2i2HI", raw, 14)
    if packed or bits not in (1, 4, 8, 16, 24, 32):
        raise ValueError(f"a BMP of {bits} bits, packed by {packed}")
    line = -(-w * bits // 32) * 4
    body = _samples(raw, at, (abs(h), line), 255)
    body = body[::-1] if h > 0 else body
    if bits <= 8:
        used = struct.unpack_from("<I", raw, 46)[0] or 1 << bits
        palette = np.zeros((1 << bits, 4), np.uint8)
        palette[: min(used, 1 << bits)] = _samples(raw, 14 + size, (used, 4), 255)[: 1 << bits]
        each = np.unpackbits(body, axis=1).reshape(abs(h), line * 8 // bits, bits)[:, :w]
        number = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        grey = (palette[:, :3] == palette[:, :1]).all()
        return palette[:, 0][number] if grey else palette[:, 2::-1][number]
    if bits == 16:
        pixel = np.ascontiguousarray(body[:, : 2 * w]).view("<u2")
        return np.stack([((pixel >> s & 31) * 255 // 31).astype(np.uint8) for s in (10, 5, 0)], axis=2)
    return body[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    """The samples of an image; ValueError says what is wrong with one that can't be decoded."""
    try:
        image = decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)
    except (KeyError, struct.error) as e:
        raise ValueError("the image's header is incomplete") from e
    if not image.size:
        raise ValueError("the image has no samples")
    return image


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, by the integral image read at fractional places."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(cells + 1) * n / cells
        k = np.minimum(x.astype(np.int64), n - 1)
        return k, x - k

    (r, fr), (c, fc) = at(h, height), at(w, width)
    across = total[r] + (total[r + 1] - total[r]) * fr[:, None]
    grid = across[:, c] + (across[:, c + 1] - across[:, c]) * fc
    return np.diff(np.diff(grid, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(tile: np.ndarray) -> int:
    """64 bits, row by row: 1 where a sample is darker than its right neighbour."""
    return int.from_bytes(np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes(), "big")


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def payload(raw: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of WIDTH."""
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _to_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = byte_texts(b)
        yield rows(_MEDIA, b.column("doc_id"), [len(x) for x in raw], [encode_pgm(np.frombuffer(payload(x), np.uint8).reshape(-1, WIDTH)) for x in raw])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's bytes as the samples of a grey Netpbm image.

    A null or empty text is an image of one row of zeros. Rows stay one to one, whatever
    their doc_id; equal texts have equal media; columns besides doc_id and text are not read.
    """
    tune(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_to_media, "doc_id bigint, n_bytes bigint, media binary")


_FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile_file", pa.string()), ("tile_index", pa.int64()), ("problem", pa.string()),
])


def _described(media: bytes | None) -> tuple[tuple, np.ndarray | None]:
    """An image's values from payload_bytes to feature, its problem last, and its tile."""
    if media is None:
        return (None,) * 6 + ("no image",), None
    stored_form = len(media), hashlib.sha256(media).hexdigest()
    try:
        image = decode(media)
    except ValueError as e:
        return (None, None, None, *stored_form, None, str(e)), None
    body = image.tobytes()
    tile = np.rint(area_resize(image if image.ndim == 2 else image.mean(axis=2), *TILE)).astype(image.dtype)
    feature = f"{image.shape[1]}x{image.shape[0]}:{difference_hash(tile):016x}"
    return (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-WIDTH:]), *stored_form, feature, None), tile


def _features(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, stack, k = TaskContext.get().partitionId(), [], [], 0

        def sent() -> pa.RecordBatch:
            """The rows held so far; their tiles' file comes first, so no row names a file that isn't there."""
            if stack:
                put_file(f"{folder}/{name}", iter([npy(np.stack(stack))]))
            return rows(_FEATURES, *(zip(*held, strict=True) if held else [[]] * len(_FEATURES)))

        for b in batches:
            name = f"tiles-{part:06d}-{k:04d}.npy"
            for i, n, media in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                (*values, problem), tile = _described(media)
                held.append((i, n, *values, None if tile is None else name, None if tile is None else len(stack), problem))
                if tile is not None:
                    stack.append(tile.astype(np.uint16))
            if len(held) >= STACK:
                yield sent()
                held, stack, k = [], [], k + 1
        yield sent()

    return run


def features(media: DataFrame, folder: str | None = None) -> DataFrame:
    """Decodes a media column, writes resized tiles as NPY stacks into ``folder``, and returns digests and hashes.

    One row per row of (doc_id, n_bytes, media): payload and media digests, feature
    (size and difference hash, equal for equal media), tile_file and tile_index. Of a null,
    cut, unknown or empty image, ``problem`` says what is wrong; its feature, payload and tile
    columns are null (of a null image, all but doc_id and n_bytes). Repeated rows have a tile
    each; other columns of ``media`` are not read.
    """
    tune(media.sparkSession)
    folder = folder or shared_dir(media.sparkSession, "tiles")
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile_file string, tile_index bigint, problem string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features(folder), schema)
