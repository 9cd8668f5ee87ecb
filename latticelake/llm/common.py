"""Shared helpers: Arrow batches of texts, and the tables written to the cluster's shared folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, shared_dir, written

__all__ = ["chunks", "discard", "id_and_text", "shared_dir", "small_batches", "texts_of", "written"]


def small_batches(spark: SparkSession, records: int = 512) -> None:
    """Arrow batches of at most so many rows, as rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, b"" for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most_bytes: int = 300_000):
    """(from, to) ranges of texts of about most_bytes together; a longer text is alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most_bytes:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, under fixed names, whatever else there is."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
