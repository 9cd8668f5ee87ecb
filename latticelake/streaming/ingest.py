"""Incremental ingest: a stream of run rows appended to the repository, known keys rejected.

A streamed repository is a folder of three tables: `runs`, by parts of the key and by batch;
`rejected`, by batch; and `commits`, a row for each batch that is whole. A batch that is replayed
after a failure replaces what it left behind, and one that is whole is not handled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..tables import exists, remove, written

EXISTS = "This calculation already exists!"


def known_keys(spark, path: str) -> DataFrame:
    """(checksum) of the repository at path; empty where there is none yet."""
    try:
        return spark.read.parquet(path).select("checksum")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "checksum string")


def split_batch(batch: DataFrame, known: DataFrame) -> DataFrame:
    """batch with the column error: null for the first row of each unknown key, else EXISTS."""
    # by content, so that a replay keeps the same one of different rows with one key
    first = F.row_number().over(Window.partitionBy("checksum").orderBy(F.to_json(F.struct(*batch.columns)))) == 1
    marked = batch.withColumn("first", first).join(known.distinct().withColumn("known", F.lit(True)), "checksum", "left")
    return marked.withColumn("error", F.when(F.col("known").isNotNull() | ~F.col("first"), F.lit(EXISTS))).select(*batch.columns, "error")


def append_new(batch: DataFrame, path: str, rejected: str | None = None) -> tuple[int, int]:
    """Appends the runs of a batch whose checksum isn't there yet, and the keys of the others with their error to `rejected`; returns how many of either.

    The batch is read once: both parts come from one checked table in the shared folder.
    """
    checked = written(split_batch(batch, known_keys(batch.sparkSession, path)), "batch")
    count = {r.ok: r.n for r in checked.groupBy(F.col("error").isNull().alias("ok")).agg(F.count("*").alias("n")).collect()}
    if count.get(True):
        checked.where("error is null").drop("error").write.mode("append").parquet(path)
    if count.get(False) and rejected:
        checked.where("error is not null").select("checksum", "error").write.mode("append").parquet(rejected)
    return count.get(True, 0), count.get(False, 0)


#: Keys of a batch that are few enough to be looked up one by one, through the Bloom filters of the files.
FEW = 10
NO_KEY = "This calculation has no key!"
COMMITS = "kept long, rejected long, batch string"


def key_part(checksum: Column, digits: int = 2) -> Column:
    """The part of the repository that a key belongs to: one of 16 to the power of digits."""
    return F.concat(F.lit("p"), F.substring(F.md5(checksum), 1, digits))


def _table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table at path, empty where there is none yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def repository(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The runs (schema, part, batch) of all whole batches; batches under way and those that failed are not seen."""
    whole = StructType([*schema.fields, StructField("part", StringType()), StructField("batch", StringType())])
    return _table(spark, f"{root}/runs", whole).join(_table(spark, f"{root}/commits", COMMITS).select("batch"), "batch", "left_semi").select(*whole.names)


def rejected_runs(spark: SparkSession, root: str) -> DataFrame:
    """(checksum, error, batch) of the rows that whole batches refused."""
    return _table(spark, f"{root}/rejected", "checksum string, error string, batch string").join(_table(spark, f"{root}/commits", COMMITS).select("batch"), "batch", "left_semi").select("checksum", "error", "batch")


def known_parts(batch: DataFrame, root: str, schema: StructType) -> DataFrame:
    """(checksum) of the repository's keys in the parts that the batch (checksum, part) touches; no other part is opened."""
    spark = batch.sparkSession
    parts = [r.part for r in batch.select("part").distinct().collect()]  # as many as there are parts at most
    known = repository(spark, root, schema).where(F.col("part").isin(parts)).select("checksum")
    keys = [r.checksum for r in batch.select("checksum").distinct().limit(FEW + 1).collect()]
    return known.where(F.col("checksum").isin(keys)) if len(keys) <= FEW else known


def ingest_batch(batch: DataFrame, root: str, batch_id: int, source: str = "stream", digits: int = 2) -> tuple[int, int]:
    """Appends a batch of runs to the repository at root exactly once; returns how many rows it kept and rejected.

    The batch is known by source and batch_id. Its rows are written first, then what it rejects,
    then its commit; a failure in between leaves nothing that readers see, and the replay first
    removes what is there of the batch. One writer at a time. Rows without a key are rejected.
    """
    spark, name = batch.sparkSession, f"{source}-{batch_id}"
    done = _table(spark, f"{root}/commits", COMMITS).where(F.col("batch") == name).first()
    if done:
        return done.kept, done.rejected
    for path in (f"{root}/runs/*/batch={name}", f"{root}/rejected/batch={name}"):
        remove(spark, path)
    rows = written(batch.withColumn("part", key_part(F.col("checksum"), digits)), "batch")
    keyed = rows.where("checksum is not null")
    checked = split_batch(keyed, known_parts(keyed, root, batch.schema)).unionByName(rows.where("checksum is null").withColumn("error", F.lit(NO_KEY)))
    checked = written(checked, "checked")
    count = {r.ok: r.n for r in checked.groupBy(F.col("error").isNull().alias("ok")).agg(F.count("*").alias("n")).collect()}
    kept, lost = count.get(True, 0), count.get(False, 0)
    _write(checked.where("error is null").drop("error"), f"{root}/runs", name, ["part"])
    _write(checked.where("error is not null").select("checksum", "error"), f"{root}/rejected", name, [])
    spark.createDataFrame([(kept, lost)], "kept long, rejected long").coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/batch={name}")
    return kept, lost


def _write(rows: DataFrame, path: str, batch: str, by: list[str]) -> None:
    """Rows of one batch, one file for each part, with a Bloom filter over the keys."""
    rows = rows.withColumn("batch", F.lit(batch))
    rows = rows.repartition(*by) if by else rows
    rows.write.mode("append").partitionBy(*by, "batch").option("parquet.bloom.filter.enabled#checksum", "true").parquet(path)


def ingest(runs: DataFrame, root: str, checkpoint: str, source: str = "stream") -> StreamingQuery:
    """Starts a query that ingests what is available of a streaming DataFrame of run rows, each batch exactly once, then ends."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, root, batch_id, source)

    return runs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
