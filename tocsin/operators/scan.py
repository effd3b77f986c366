"""Running values over long histories, by slots: a prefix scan in three steps.

A key's history is cut into slots of a column that orders it. Each slot is summed up on its own, the few summaries are
carried from slot to slot, and rows are completed within their slot; so a key's history is as many tasks' work as it has
slots, and only summaries are ever put in order as a whole. Rows are shuffled once, by key and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLOT = "_slot"


def _cut(rows: DataFrame, key: str, at: str, unit: int) -> DataFrame:
    return rows.withColumn(_SLOT, F.floor(F.col(at) / unit).cast("bigint")).repartition(key, _SLOT)


def _carried(cut: DataFrame, key: str, summaries: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """Rows with what earlier slots of their key amount to."""
    slots = cut.groupBy(key, _SLOT).agg(*(c.alias(n) for n, c in summaries.items()))
    before = Window.partitionBy(key).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    of = slots.select(F.col(key).alias("_key"), F.col(_SLOT).alias("_of"), *(c.over(before).alias(n) for n, c in carry.items()))
    return cut.join(of, F.col(key).eqNullSafe(F.col("_key")) & (F.col(_SLOT) == F.col("_of"))).drop("_key", "_of")


def last_before(rows: DataFrame, key: str, at: str, value: Column, name: str, unit: int, ties: tuple[Column, ...] = (), inclusive: bool = False) -> DataFrame:
    """Rows with ``name``: the last value that isn't null of an earlier row of the key, or of this one if ``inclusive``."""
    cut = _cut(rows.withColumn("_value", value), key, at, unit)
    order = F.struct(at, *ties)
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), order))
    out = _carried(cut, key, {"_end": last}, {"_carry": F.last("_end", True)})
    within = Window.partitionBy(key, _SLOT).orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return out.withColumn(name, F.coalesce(F.last("_value", True).over(within), F.col("_carry"))).drop("_value", "_carry", _SLOT)


def running_sums(rows: DataFrame, key: str, at: str, columns: tuple[str, ...], unit: int) -> DataFrame:
    """Rows with each of ``columns`` summed over the key's rows up to this one; a key has one row at a time."""
    cut = _cut(rows, key, at, unit)
    out = _carried(cut, key, {f"_sum_{c}": F.sum(c) for c in columns}, {f"_carry_{c}": F.sum(f"_sum_{c}") for c in columns})
    within = Window.partitionBy(key, _SLOT).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    sums = {c: F.sum(c).over(within) + F.coalesce(f"_carry_{c}", F.lit(0)) for c in columns}
    return out.withColumns(sums).drop(_SLOT, *(f"_carry_{c}" for c in columns))
