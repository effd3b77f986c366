"""What the operators of this subpackage share: folders, Arrow batches, checksums."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to a Python worker at once; long texts make even this many heavy.
BATCH_ROWS = 512
#: Bytes handed to a Python worker at once.
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that a run of very long texts fits in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder (as URI) that driver and executors share, below ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a temporary folder of this machine is set and used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tocsin-shared-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, urlparse(base).path, True)
    uri = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    make_dir(uri)
    return uri


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The path behind a URI of a mounted file system, else None."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def make_dir(uri: str) -> None:
    if (p := local_path(uri)) is not None:
        os.makedirs(p, exist_ok=True)
    else:
        fs, path = _fs(uri)
        fs.create_dir(path, recursive=True)


def put_file(uri: str, chunks: Iterator[bytes]) -> int:
    """Writes a file whole or not at all: a lost or repeated task leaves no half of it."""
    n, tmp = 0, f"{uri}.{uuid.uuid4().hex[:8]}.tmp"
    if (p := local_path(tmp)) is not None:
        with open(p, "wb") as f:
            for c in chunks:
                n += f.write(c)
        os.replace(p, local_path(uri))
        return n
    fs, path = _fs(tmp)
    with fs.open_output_stream(path) as f:
        for c in chunks:
            n += f.write(c)
    fs.move(path, _fs(uri)[1])
    return n


def fetched(uri: str) -> str:
    """A path to map into memory: the shared file itself, or this worker's copy of it."""
    if (p := local_path(uri)) is not None:
        return p
    copy = os.path.join(tempfile.gettempdir(), f"tocsin-{uuid.uuid5(uuid.NAMESPACE_URL, uri).hex}")
    if not os.path.exists(copy):
        fs, path = _fs(uri)
        part = f"{copy}.{uuid.uuid4().hex[:8]}"
        with fs.open_input_stream(path) as src, open(part, "wb") as dst:
            shutil.copyfileobj(src, dst, 1 << 22)
        os.replace(part, copy)
    return copy


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    uri = f"{shared_dir(spark, tag)}/table"
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


#: Rows of one key that a join may shuffle to one task, and the most keys with more that are joined apart.
HOT, HOT_KEYS = 20_000, 4_096


def spread_join(left: DataFrame, right: DataFrame, key: str, size: str, hot: int = HOT) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has each key once and in ``size`` how many rows of ``left`` have it.

    Rows of keys with more than ``hot`` rows, the ``HOT_KEYS`` largest of them, never enter the shuffle: their rows of
    ``right`` are broadcast, and their rows of ``left`` stay where they are. A key beyond those has less than a
    ``HOT_KEYS``-th of all rows. ``right`` is read once more to find them.
    """
    largest = [r[0] for r in right.where((F.col(size) > hot) & F.col(key).isNotNull()).select(key, size).orderBy(F.desc(size), key).limit(HOT_KEYS).collect()]
    right = right.drop(size)
    if not largest:
        return left.join(right, key)
    keys = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in largest], T.StructType([T.StructField(key, right.schema[key].dataType)])))
    few = F.broadcast(right.join(keys, key, "left_semi"))
    return left.join(keys, key, "left_anti").join(right, key).unionByName(left.join(few, key))


def id_and_text(df: DataFrame) -> DataFrame:
    """Only the two columns that the operators read; whatever else the table has may clash with nothing."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def hash_mod(col: str, n: int) -> Column:
    """crc32(column as text) mod n; null: null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def texts(batch: pa.RecordBatch) -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column("text").to_pylist()]


def byte_texts(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch as UTF-8; null is the empty text."""
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def widened(docs: DataFrame, name: str, kind: str, values: Callable[[list[str]], pa.Array]) -> DataFrame:
    """The same rows with one more column, computed from the texts (null: empty), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(name, values(texts(b)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


_OWNER: dict = {"name": None, "clear": None}


def own_memory(name: str, clear: Callable[[], None]) -> None:
    """Says whose memory this worker keeps from batch to batch; that of another operator goes."""
    if _OWNER["name"] != name:
        if _OWNER["clear"] is not None:
            _OWNER["clear"]()
        _OWNER.update(name=name, clear=clear)
