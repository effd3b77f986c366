"""Scans by slots against plain loops, and how their work is dealt."""

import random

from pyspark.sql import functions as F

from tocsin.operators import risk, scan


def test_scans(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), t, rng.choice([None, 1, 2, 3])) for t in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "id string, at bigint, v int").repartition(3)
    for unit in (1, 37, 10**6):
        last = {(r.id, r.at): (r.before, r.upto) for r in scan.last_before(scan.last_before(df, "id", "at", F.col("v"), "before", unit), "id", "at", F.col("v"), "upto", unit, inclusive=True).collect()}
        sums = {(r.id, r.at): r.v for r in scan.running_sums(df.withColumn("v", F.coalesce("v", F.lit(0))), "id", "at", ("v",), unit).collect()}
        assert len(last) == len(sums) == len(rows)
        for key in ("a", "b", None):
            before, total = None, 0
            for _, t, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
                total += v or 0
                assert last[key, t] == (before, v if v is not None else before) and sums[key, t] == total
                before = v if v is not None else before


def test_one_district_is_many_tasks(spark):
    """A single district's ticks are dealt over the partitions, and its levels are those of a loop."""
    rng = random.Random(2)
    times = sorted(rng.sample(range(0, 200_000_000), 3000))
    ticks = [("d", t, rng.choice([0, 0, 0, 1, 2])) for t in times]
    out = risk.cooled(spark.createDataFrame(ticks, "id string, at_ms bigint, rank int"))
    prev, ended, want = 0, None, {}
    for _, t, rank in ticks:
        ended = t if rank == 0 and prev else ended
        want[t] = {2: "red", 1: "orange"}.get(rank, "green" if ended is not None and t - ended < 300_000 else None)
        prev = rank
    had = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = out.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", had)
    assert {r.at_ms: r.level for r in rows} == want and len({r.part for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
