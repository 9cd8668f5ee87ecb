"""Pages of a sorted listing that is written once, in ranges with known numbers of rows."""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import discard, written


#: Rows of one file of a listing, as long as its ranges are smaller.
PER_FILE = 500_000


def write_listing(rows: DataFrame, by: list[str], path: str, per_part: int = 100_000) -> int:
    """Writes rows in order of the columns `by`, cut into ranges (column piece), and the numbers of rows of all ranges; returns the number of rows.

    `by` has to end in a key, so that the order is one. Nulls come first. A file holds the ranges
    of many rows, one after the other, in a folder of its own (column part): the number of files
    follows the number of rows, not the length of a page. rows are computed once.
    """
    own = written(rows, "unsorted")
    n = own.count()
    most = max(per_part, PER_FILE)
    sorted_rows = own.repartitionByRange(-(-max(n, 1) // most), *by).sortWithinPartitions(*by)
    # the low 33 bits are the row's place in its file
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = sorted_rows.withColumns({"piece": F.floor(place / per_part).cast("int"), "part": F.spark_partition_id()})
    parts.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    counts = own.sparkSession.read.schema(parts.schema).parquet(f"{path}/rows").groupBy("part", "piece").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    own.sparkSession.createDataFrame([(parts.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    discard(own)
    return n


def read_page(spark: SparkSession, path: str, by: list[str], page: int, size: int) -> DataFrame:
    """The rows of one page, in order: only the files that the page lies in are opened, and only their ranges of it are sorted.

    The counts of files, one for each, go to the driver, and those of the ranges of the files that the page lies in.
    """
    counts = spark.read.schema("part int, piece int, n long").parquet(f"{path}/counts")
    start = page * size

    def cut(rows: list, before: int) -> tuple[list, int]:
        """The keys of the (key, n) that the page lies in, and the rows before the first of them."""
        ends = [before + x for x in accumulate(n for _, n in rows)]
        first, last = bisect_right(ends, start), bisect_right(ends, start + size - 1)
        return [k for k, _ in rows[first:last + 1]], ends[first - 1] if first else before

    files, before = cut(sorted((r.part, r.n) for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect()), 0)
    own, before = cut(sorted(((r.part, r.piece), r.n) for r in counts.where(F.col("part").isin(files) if files else F.lit(False)).collect()), before)
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first().value))
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    inside = F.lit(False)
    files = sorted({f for f, _ in own})
    for f in files:
        parts = [p for x, p in own if x == f]
        inside = inside | ((F.col("part") == f) & F.col("piece").between(min(parts), max(parts)))
    return rows.where(F.col("part").isin(files) if files else F.lit(False)).where(inside).orderBy(*by).offset(start - before if own else 0).limit(size).drop("piece", "part")
