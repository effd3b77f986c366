"""From a stream of messages to incidents: each micro-batch is parsed against the gazetteer of its time.

A gazetteer is published in numbered versions, each whole before its number is known. A batch takes the newest number when
it is first tried, and writes the number down, so that a batch that is tried again after a failure is parsed against the
same version; its events are written over those of the first try. Events are a table by batch that other streams read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.operators import parse
from tocsin.plans.settings import TRACKED, Settings
from tocsin.sources.shared import scratch

VERSIONS = "version bigint"
BATCHES = "batch bigint, version bigint"


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by its schema; empty before its first row is written."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def newest(spark: SparkSession, folder: str) -> int | None:
    """The number of the gazetteer's newest version."""
    return _known(spark, f"{folder}/versions", VERSIONS).agg(F.max("version")).first()[0]


def publish_gazetteer(gazetteer: DataFrame, folder: str) -> int:
    """Writes a new version, then its number; running streams take it from their next batch on. One publisher at a time."""
    spark, version = gazetteer.sparkSession, (newest(gazetteer.sparkSession, folder) or 0) + 1
    gazetteer.write.mode("overwrite").parquet(f"{folder}/places/{version}")
    spark.createDataFrame([(version,)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return version


def version_of(spark: SparkSession, batch: int, gazetteer: str, folder: str) -> int:
    """The version that a batch is parsed against: the one written down, else the newest, which is then written down."""
    log = f"{folder}/batches/{batch}"
    if held := _known(spark, log, BATCHES).first():
        return held["version"]
    version = newest(spark, gazetteer)
    if version is None:
        raise ValueError(f"no gazetteer has been published in {gazetteer}")
    spark.createDataFrame([(batch, version)], BATCHES).coalesce(1).write.mode("overwrite").parquet(log)
    return version


def parse_stream(messages: DataFrame, gazetteer: str, folder: str, ambiguous: dict[str, str] | None = None, settings: Settings = Settings(), timeout: int = 600) -> DataFrame:
    """Parses what a stream of messages (id, channel_name, text, timestamp) has now, batch by batch; gives all events so far.

    ``folder`` holds the checkpoint, the events and which version each batch was parsed against; a later call goes on.
    Within a batch, names are resolved as in ``parse.parse``; what that stores is deleted with the batch.
    """
    spark = messages.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        version = version_of(session, number, gazetteer, folder)
        with scratch(session):
            places = session.read.parquet(f"{gazetteer}/places/{version}")
            events = parse.parse(batch, places, ambiguous, settings).withColumn("gazetteer_version", F.lit(version).cast("bigint"))
            events.write.mode("overwrite").parquet(f"{folder}/events/{number}")

    q = messages.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout):
            raise TimeoutError("the stream didn't end")
    finally:
        q.stop()
    return spark.read.parquet(f"{folder}/events/*")


def correlator_rows(events: DataFrame, scope: Column | None = None) -> DataFrame:
    """Published events of tracked weapons as rows for the correlator; ``scope`` says whose incidents they are, one for all if none."""
    tracked, _ = parse.routed(events, TRACKED)
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["lat"].alias("lat"), F.col(c)["lng"].alias("lng"), F.col(c)["canonical_name"].alias("name"))).alias(c)
    none = lambda kind: F.lit(None).cast(kind)
    optional = lambda c, kind: (F.col(c) if c in events.columns else none(kind)).alias(c)
    return tracked.select(
        (F.lit("all") if scope is None else scope).alias("scope"), "event_id", F.col("id").alias("message_id"), optional("reply_to", "bigint"), F.col("channel_name").alias("channel"), "timestamp", "event_type", "weapon_type", "weapon_count",
        "confidence", place("location"), place("via"), place("heading"), "is_correction", "is_followup", "count_delta", "phrase_intents", optional("continues_incident_id", "string"), optional("continuation_confidence", "double"),
    )


LATENESS = "batch bigint, newest bigint"


def split_late(rows: DataFrame, at: str, late: int, folder: str, timeout: int = 600) -> tuple[DataFrame, DataFrame]:
    """What a stream has now, as rows in time and rows too late, by batch; a later call goes on. Gives all of both so far.

    A batch's watermark is the newest time (column ``at``, seconds) of all batches before it, less ``late``. Rows behind it,
    which an operator with state would drop, get ``lateness``, by how many seconds they are. Each batch's newest time is
    written down once it is split, so a batch that is tried again is split in the same way.
    """
    spark, schema = rows.sparkSession, rows.schema

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        newest_before = _known(session, f"{folder}/newest", LATENESS).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        mark = F.lit(None).cast("bigint") if newest_before is None else F.lit(newest_before - late)
        behind = F.coalesce(F.col(at) < mark, F.lit(False))
        batch.where(~behind).write.mode("overwrite").parquet(f"{folder}/in-time/{number}")
        batch.where(behind).withColumn("lateness", mark - F.col(at)).write.mode("overwrite").parquet(f"{folder}/late/{number}")
        latest = batch.agg(F.max(at)).first()[0]
        if latest is not None and not _known(session, f"{folder}/newest", LATENESS).where(F.col("batch") == number).count():
            session.createDataFrame([(number, int(latest))], LATENESS).coalesce(1).write.mode("append").parquet(f"{folder}/newest")

    q = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout):
            raise TimeoutError("the stream didn't end")
    finally:
        q.stop()
    return spark.read.schema(schema).parquet(f"{folder}/in-time/*"), spark.read.schema(T.StructType([*schema.fields, T.StructField("lateness", T.LongType())])).parquet(f"{folder}/late/*")
