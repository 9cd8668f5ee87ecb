"""A repository in buckets: joins on its keys need no shuffle, and changes rewrite the buckets that they touch.

Each table lies in folders of its bucket number, `b=<number>`, with one file in Spark's own bucket
layout; the bucket of a key is that of Spark's hash partitioning. A whole new version of the
repository is written beside the old one, and the pointer file `current` is switched at the end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import make_dir, remove, written


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key, as Spark's hash partitioning has it."""
    return F.pmod(F.hash(key), F.lit(buckets))


def key_column(columns: list[str]) -> str | None:
    """Runs go by their checksum, structures' tables by the structure."""
    return next((k for k in ("checksum", "struct_id") if k in columns), None)


class Store:
    """An open version of a bucketed repository: `tables` has its tables by name.

    Tables without a key have one bucket. The tables are entries of the session's catalog, as
    Spark keeps bucket layouts only there; `close` removes them, the files stay.
    """

    def __init__(self, spark: SparkSession, root: str, version: str, layout: dict):
        self.spark, self.root, self.version, self.layout = spark, root, version, layout
        self.names = {n: f"lake_{uuid.uuid4().hex}" for n in layout["tables"]}
        for name, entry in layout["tables"].items():
            schema = StructType.fromJson(entry["schema"])
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            key = entry["key"]
            buckets = f"clustered by (`{key}`) sorted by (`{key}`) into {layout['buckets']} buckets" if key else ""
            spark.sql(f"create table {self.names[name]} ({columns}, b int) using parquet partitioned by (b) {buckets} location '{self.path(name)}'")
            spark.catalog.recoverPartitions(self.names[name])

    def path(self, name: str) -> str:
        return f"{self.root}/{self.version}/{name}"

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {n: self.spark.table(t).drop("b") for n, t in self.names.items()}

    def close(self) -> None:
        for t in self.names.values():
            self.spark.sql(f"drop table if exists {t}")

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of a table that hold any of keys (a column of that name); as many numbers as there are buckets at most."""
        key = self.layout["tables"][name]["key"]
        return sorted(r.b for r in keys.select(bucket_of(F.col(key), self.layout["buckets"]).alias("b")).distinct().collect())

    def rewrite(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Puts change(rows) in the place of a table's rows in the buckets of keys; returns these buckets.

        change must keep rows in their buckets. No other file is read or written. The new rows
        are complete before the first old file goes, and a rewrite that dies can be run again if
        change gives the same from its own result.
        """
        table, key, n = self.names[name], self.layout["tables"][name]["key"], self.layout["buckets"]
        own = self.touched(name, keys)
        if not own:
            return own
        old = self.spark.table(table)
        new = written(change(old.where(F.col("b").isin(own)).drop("b")).select(*(f"`{c}`" for c in old.columns if c != "b")), "rewrite")
        _write(new, self.path(name), key, n)
        left = {r.b for r in new.select(bucket_of(F.col(key), n).alias("b")).distinct().collect()}
        if not left <= set(own):
            raise ValueError("a change may not move rows into other buckets")
        for b in set(own) - left:
            remove(self.spark, f"{self.path(name)}/b={b}")
            self.spark.sql(f"alter table {table} drop if exists partition (b = {b})")
        self.spark.sql(f"refresh table {table}")
        return own


def _write(rows: DataFrame, path: str, key: str | None, buckets: int) -> None:
    """Replaces the buckets that rows have any of, each by one sorted file with its bucket number in the name."""
    spark, name = rows.sparkSession, f"lake_{uuid.uuid4().hex}"
    placed = rows.withColumn("b", bucket_of(F.col(key), buckets) if key else F.lit(0))
    placed = placed.repartition(buckets, key) if key else placed.coalesce(1)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    make_dir(spark, path)
    clustered = f"clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets" if key else ""
    spark.sql(f"create table {name} ({columns}) using parquet options ('partitionOverwriteMode' 'dynamic') partitioned by (b) {clustered} location '{path}'")
    try:
        spark.catalog.recoverPartitions(name)
        placed.write.mode("overwrite").insertInto(name)
    finally:
        spark.sql(f"drop table {name}")


def save(tables: dict[str, DataFrame], root: str, buckets: int = 64) -> str:
    """Writes a new version of the repository at root and makes it the current one; returns its name.

    Readers see the old version until all tables are there: the pointer is a small file, put in place by one rename.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    layout = {"buckets": buckets, "tables": {n: {"key": key_column(t.columns), "schema": json.loads(t.schema.json())} for n, t in tables.items()}}
    for name, t in tables.items():
        _write(t, f"{root}/{version}/{name}", layout["tables"][name]["key"], buckets)
    _point(spark, root, json.dumps({"version": version, "layout": layout}))
    return version


def _point(spark: SparkSession, root: str, text: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, current = hadoop.Path(f"{root}/current-{uuid.uuid4().hex}"), hadoop.Path(f"{root}/current")
    context = hadoop.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    system = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    option = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, current, option)


def open_store(spark: SparkSession, root: str) -> Store:
    """The current version of the repository at root."""
    said = json.loads(spark.read.text(f"{root}/current", wholetext=True).first().value)
    return Store(spark, root, said["version"], said["layout"])


def purge(store: Store, keys: DataFrame) -> dict[str, list[int]]:
    """Removes runs (checksum) from every table with a key, structures' tables through the runs' structures; returns the buckets rewritten by table.

    Structures go last, as they tell which atoms belong to the runs: a purge that dies can be run again.
    """
    keys, out = written(keys.select("checksum").distinct(), "keys"), {}
    for name in sorted(store.layout["tables"], key=lambda n: n == "structures"):
        kind = store.layout["tables"][name]["key"]
        own = ["checksum" in store.tables[name].columns, kind]
        if kind == "checksum":
            out[name] = store.rewrite(name, keys, lambda t: t.join(keys, "checksum", "left_anti"))
        elif own[0]:
            continue
        elif kind == "struct_id" and "structures" in store.layout["tables"]:
            gone = written(store.tables["structures"].join(keys, "checksum", "left_semi").select("struct_id"), "gone")
            out[name] = store.rewrite(name, gone, lambda t, gone=gone: t.join(gone, "struct_id", "left_anti"))
    return out


def replace_topics(store: Store, keys: DataFrame, cid: int, values: list[str]) -> list[int]:
    """The values of one facet of the given runs are exchanged (see facets.replace_topics), in the buckets of these runs alone."""
    from ..operators import facets as FA

    topics = store.tables["topics"]
    return store.rewrite("tags", keys, lambda t: FA.replace_topics(t, topics, keys, cid, values))


def append_topics(store: Store, keys: DataFrame, cid: int, values: list[str]) -> list[int]:
    """The given runs get further values of a multiple facet, in the buckets of these runs alone."""
    from ..operators import facets as FA

    topics = store.tables["topics"]
    return store.rewrite("tags", keys, lambda t: FA.append_topics(t, topics, keys, cid, values))


def set_sizes(store: Store, changed: DataFrame) -> list[int]:
    """Puts rows (checksum and the columns to change) in the place of those of the table `sizes`, as datasets grow or shrink."""
    others = [c for c in changed.columns if c != "checksum"]

    def change(t: DataFrame) -> DataFrame:
        new = changed.select("checksum", F.struct(*others).alias("new_values"))
        return t.join(new, "checksum", "left").select(*(F.coalesce(F.col(f"new_values.{c}"), F.col(f"`{c}`")).alias(c) if c in others else F.col(f"`{c}`") for c in t.columns))

    return store.rewrite("sizes", changed, change)
