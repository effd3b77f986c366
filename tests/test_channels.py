"""The channel source's offsets, and the change sink's batches."""

import pytest
from pyspark.sql import Row

from tocsin.plans import queries
from tocsin.sources import channels, shared

SF = "/root/testdata/sf0.001"


def test_offsets(spark):
    folder = shared.shared_folder(spark, "test-channels")
    rows = [(c, k, f"t{k}", k) for c in ("a b", "z") for k in range(0, 60, 1 if c == "z" else 7)]
    channels.write_blocks(spark.createDataFrame(rows, channels.MESSAGE), f"{folder}/in", 10)
    reader = lambda: channels._Channels(f"{folder}/in", f"{folder}/progress", 2)
    names = {c for c in reader().latestOffset()}
    assert len(names) == 2 and set(reader().latestOffset().values()) == {2} and reader().initialOffset() == {}
    start, seen, batches = {}, [], 0
    while (end := reader().latestOffset()) != start:  # a new reader each time, as after a restart
        parts = reader().partitions(start, end)
        assert parts == reader().partitions(start, end) and len(parts) <= 4
        seen += [tuple(r.values()) for p in parts for b in reader().read(p) for r in b.to_pylist()]
        start, batches = end, batches + 1
    assert sorted(seen) == sorted(rows) and batches == 3 and reader().partitions(end, end) == []
    with pytest.raises(ValueError, match="again"):
        reader().partitions(end, {c: 1 for c in names})


def test_sink_commits_once(spark):
    folder = shared.shared_folder(spark, "test-sink")
    sink = channels._Publisher(folder)
    row = lambda k: Row(seq=k, op="new", id=f"i{k}", payload="{}")
    first, empty = sink.write(iter([row(k) for k in range(5000)])), sink.write(iter([]))
    assert channels.published(spark, folder).count() == 0 and channels.compacted(spark, folder) is None
    sink.commit([first, empty, None], 0)
    again = sink.write(iter([row(k) for k in range(5000)]))
    sink.commit([again], 0)
    gone = sink.write(iter([row(7000)]))
    sink.abort([gone, None], 1)
    assert channels.published(spark, folder).count() == 5000 and channels._names(f"{folder}/_staged") == []
    sink.commit([sink.write(iter([row(6000), Row(seq=6001, op="expire", id="i1", payload=None)]))], 1)
    assert channels.compacted(spark, folder) == 1 == channels.compacted(spark, folder)
    sink.commit([sink.write(iter([row(6002)]))], 2)
    got = channels.published(spark, folder).collect()
    assert len(got) == 5001 and "i1" not in {r.id for r in got} and {6000, 6002} <= {r.seq for r in got}


def test_a_repeated_batch_is_seen(spark, monkeypatch, tmp_path):
    """The query's repeated batches do reach the sink again: with a number of their own they would be there twice."""
    rows = queries._changes(spark, SF)
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: channels.publishing(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").trigger(availableNow=True).start()
    stream().awaitTermination(200)
    (tmp_path / "out/changes/batch=0").rename(tmp_path / "out/changes/batch=77")
    assert channels.forget_commit(f"{tmp_path}/c") == 0
    stream().awaitTermination(200)
    assert channels.published(spark, str(tmp_path / "out")).count() == 2 * rows.count()
