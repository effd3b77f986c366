"""A stream source that is read on executors, a partition for each block of a channel, and a sink of changes by batch."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.json
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from tocsin.sources.readers import CHANGELOG, applied

MESSAGE = "channel_name string, telegram_id bigint, text string, timestamp bigint"
_MESSAGE = pa.schema([("channel_name", pa.string()), ("telegram_id", pa.int64()), ("text", pa.string()), ("timestamp", pa.int64())])


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system behind a path or URI, and the path in it."""
    u = urlparse(uri)
    return (fs.LocalFileSystem(), u.path) if u.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def _names(uri: str) -> list[str]:
    on, path = opened(uri)
    return [x.base_name for x in on.get_file_info(fs.FileSelector(path, allow_not_found=True)) if not x.base_name.startswith(("_", "."))]


def write_blocks(messages: DataFrame, path: str, size: int = 1000) -> None:
    """Messages as JSON lines in ``path``/channel=.../block=..., a block being ``size`` numbers; a block is written once, whole."""
    blocks = messages.withColumns({"channel": F.col("channel_name"), "block": F.floor(F.col("telegram_id") / size)}).repartition("channel", "block")
    blocks.drop("channel_name").write.mode("append").partitionBy("channel", "block").json(path)


@dataclass
class Block(InputPartition):
    """One block of one channel."""

    channel: str
    block: int


class ChannelMessages(DataSource):
    """Messages of channels as a stream; options: path, progress (a folder of the query's own), limit (blocks of a channel in a batch).

    The driver lists folders only. A channel's offset is the block that comes next.
    """

    @classmethod
    def name(cls) -> str:
        return "channel_messages"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Channels(self.options["path"], self.options["progress"], int(self.options.get("limit", 1)))


class _Channels(DataSourceStreamReader):
    """Where the last planned batch ended is written down when a batch is planned, which is after Spark has logged its offsets.

    So after any failure it is where the next batch begins: a batch that was logged but not planned is planned again first.
    """

    def __init__(self, path: str, progress: str, limit: int):
        self.path, self.progress, self.limit = path, progress, limit

    def initialOffset(self) -> dict:
        return {}

    def _planned(self) -> dict:
        on, path = opened(f"{self.progress}/planned.json")
        if on.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with on.open_input_stream(path) as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:
        """At most ``limit`` blocks of each channel beyond the last planned batch."""
        end = self._planned()
        for folder in _names(self.path):
            channel = folder.removeprefix("channel=")
            new = sorted(b for b in (int(x.removeprefix("block=")) for x in _names(f"{self.path}/{folder}")) if b >= end.get(channel, 0))
            if new:
                end[channel] = new[: self.limit][-1] + 1
        return end

    def partitions(self, start: dict, end: dict) -> list[Block]:
        if behind := [c for c in start if end.get(c, 0) < start[c]]:
            raise ValueError(f"channels {behind} would be read again: the folder of the query's progress isn't the one that it was started with")
        on, path = opened(self.progress)
        on.create_dir(path, recursive=True)
        with on.open_output_stream(f"{path}/planned.tmp") as f:
            f.write(json.dumps(end).encode())
        on.move(f"{path}/planned.tmp", f"{path}/planned.json")
        there = {c: {int(x.removeprefix("block=")) for x in _names(f"{self.path}/channel={c}")} for c in end}
        return [Block(c, b) for c in sorted(end) for b in sorted(there[c]) if start.get(c, 0) <= b < end[c]]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        folder = f"{self.path}/channel={partition.channel}/block={partition.block}"
        on, path = opened(folder)
        options = pyarrow.json.ParseOptions(explicit_schema=pa.schema(list(_MESSAGE)[1:]), unexpected_field_behavior="ignore")
        for name in sorted(_names(folder)):
            with on.open_input_stream(f"{path}/{name}") as f:
                raw = f.read()
            if raw.strip():
                for b in pyarrow.json.read_json(pa.BufferReader(raw), parse_options=options).to_batches(1024):
                    yield pa.RecordBatch.from_arrays([pa.array([unquote(partition.channel)] * len(b), pa.string()), *(b.column(c) for c in _MESSAGE.names[1:])], schema=_MESSAGE)


@dataclass
class Written(WriterCommitMessage):
    """A task's file."""

    path: str


_CHANGE = pa.schema([("seq", pa.int64()), ("op", pa.string()), ("id", pa.string()), ("payload", pa.string())])


class ChangeSink(DataSource):
    """Changes (seq, op, id, payload) published by batch below the option ``path``: a batch's files appear at once, or not at all.

    A batch that comes again after a failure has the same number and isn't published twice. Tasks write where nobody
    reads; a commit moves their files into the batch's folder and gives it its name, an abort removes them.
    """

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return CHANGELOG

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Publisher(self.options["path"])


class _Publisher(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        on, path = opened(f"{self.path}/_staged")
        on.create_dir(path, recursive=True)
        name, writer = f"{path}/{uuid.uuid4().hex}.parquet", None
        some: list[tuple] = []

        def flush() -> None:
            nonlocal writer
            writer = writer or pyarrow.parquet.ParquetWriter(on.open_output_stream(name), _CHANGE)
            writer.write_table(pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), _CHANGE, strict=True)], schema=_CHANGE))
            some.clear()

        for r in iterator:
            some.append((r["seq"], r["op"], r["id"], r["payload"]))
            if len(some) >= 4096:
                flush()
        if some:
            flush()
        if writer is None:
            return Written("")
        writer.close()
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        on, path = opened(self.path)
        files, to = [m.path for m in messages if m is not None and m.path], f"{path}/changes/batch={batchId}"
        if on.get_file_info(to).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)
        on.create_dir(f"{path}/changes", recursive=True)
        on.create_dir(f"{path}/changes/_{batchId}", recursive=True)
        for f in files:
            on.move(f, f"{path}/changes/_{batchId}/{os.path.basename(f)}")
        on.move(f"{path}/changes/_{batchId}", to)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        on, _ = opened(self.path)
        for m in messages:
            if m is not None and m.path and on.get_file_info(m.path).type != fs.FileType.NotFound:
                on.delete_file(m.path)


def publishing(changes: DataFrame, path: str, checkpoint: str):
    """A writer of a stream of changes (seq, op, id, payload) into the sink, to be started."""
    changes.sparkSession.dataSource.register(ChangeSink)
    return changes.select("seq", "op", "id", "payload").writeStream.format("changes").option("path", path).option("checkpointLocation", checkpoint)


def compacted(spark: SparkSession, path: str) -> int | None:
    """Writes what all batches so far leave as a snapshot; the number of the last of them."""
    batches = sorted(int(x.removeprefix("batch=")) for x in _names(f"{path}/changes"))
    if not batches:
        return None
    rows = applied(published(spark, path)).select("seq", F.lit("new").alias("op"), "id", "payload")
    rows.write.mode("overwrite").parquet(f"{path}/_snapshot-{batches[-1]}")
    on, at = opened(path)
    if on.get_file_info(f"{at}/snapshots/{batches[-1]}").type == fs.FileType.NotFound:
        on.create_dir(f"{at}/snapshots", recursive=True)
        on.move(f"{at}/_snapshot-{batches[-1]}", f"{at}/snapshots/{batches[-1]}")
    return batches[-1]


def published(spark: SparkSession, path: str) -> DataFrame:
    """The changes that clients see: the newest snapshot's rows, each the last change of its id, and all later batches."""
    snapshot = max(map(int, _names(f"{path}/snapshots")), default=-1)
    later = [f"{path}/changes/{x}" for x in _names(f"{path}/changes") if int(x.removeprefix("batch=")) > snapshot]
    parts = [f"{path}/snapshots/{snapshot}"] * (snapshot >= 0) + later
    return spark.read.schema(CHANGELOG).parquet(*parts) if parts else spark.createDataFrame([], CHANGELOG)


def forget_commit(checkpoint: str) -> int:
    """Undoes the record that a stopped query's last batch is done, as if it had been killed just before; the batch's number."""
    _, path = opened(checkpoint)
    last = max(int(x) for x in os.listdir(f"{path}/commits") if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{path}/commits/{name}"):
            shutil.move(f"{path}/commits/{name}", f"{path}/undone-{name.strip('.')}-{uuid.uuid4().hex[:6]}")
    return last
