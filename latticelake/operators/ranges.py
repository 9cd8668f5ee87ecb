"""Range joins: values and the intervals that hold them, for any table of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(low: Column, high: Column) -> Column:
    """Exponent of the least power of two, 1 at least, that is as long as the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1.0), (high - low).cast("double"))))).cast("int")


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def binned(ranges: DataFrame) -> DataFrame:
    """ranges (low, high, ...) with level and bin: each interval lies in at most two bins of its own length's level; empty and null ones in none."""
    level = ranges.where("low <= high").withColumn("level", _level(F.col("low"), F.col("high")))
    bins = F.array_distinct(F.array(_bin(F.col("low"), F.col("level")), _bin(F.col("high"), F.col("level"))))
    return level.select("*", F.explode(bins).alias("bin"))


def interval_join(rows: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """Each row with every interval (low, high inclusive, further columns) that holds its value; rows that none holds stay, with nulls.

    An equi-join on (level, bin): an interval is in two bins at most, a row in one bin of each
    level that the intervals have, some dozens at most; so neither long intervals nor popular
    values multiply rows. The names of the ranges' columns must not be among those of rows.
    """
    levels = sorted(r.level for r in ranges.where("low <= high").select(_level(F.col("low"), F.col("high")).alias("level")).distinct().collect())  # powers of two that lengths have
    placed = binned(ranges).withColumnsRenamed({"level": "_level", "bin": "_bin"})
    keyed = rows.withColumn("_row", F.monotonically_increasing_id()) if not levels else rows
    if not levels:
        return keyed.join(placed.drop("_level", "_bin"), F.lit(False), "left").drop("_row")
    probes = F.array(*(F.struct(F.lit(k).alias("_level"), _bin(F.col(value), F.lit(k)).alias("_bin")) for k in levels))
    found = rows.select("*", F.inline(probes)).join(placed, ["_level", "_bin"]).where(F.col(value).between(F.col("low"), F.col("high"))).drop("_level", "_bin")
    # rows without an interval are told by their value alone, so no row needs a key
    held = found.select(F.col(value).alias("_value")).distinct()
    lost = rows.join(held, rows[value] == held["_value"], "left_anti")
    return found.unionByName(lost, allowMissingColumns=True)


def overlapping(ranges: DataFrame, label: str) -> DataFrame:
    """(a, b): labels of intervals that share a value, a < b; disjoint tables give no row.

    Of two intervals that overlap, the one that starts later starts within the other one.
    """
    starts = ranges.where("low <= high").select(F.col(label).alias("b"), F.col("low").alias("start"))
    found = interval_join(starts, "start", ranges.select("low", "high", F.col(label).alias("a"))).where("a is not null and a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
