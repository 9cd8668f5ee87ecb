"""Prefix doubling in full: every byte position, its rank, and the rank at an offset.

`repeats.without_repeats` cuts the positions down first; this is the plain form, for corpora whose
positions may be sorted several times (17 bytes and more each). README has its measured figures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, id_and_text, small_batches, texts_of, written

#: Bytes that the first rank stands for: they are the rank, as a number.
FIRST = 8


def _positions(docs: DataFrame) -> DataFrame:
    """(doc_id, i, rank) of every place with FIRST bytes from it on; ranks have the order of these bytes."""

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in chunks(texts):
                for k in range(lo, hi):
                    raw = np.frombuffer(texts[k], dtype=np.uint8)
                    if len(raw) < FIRST:
                        continue
                    rank = np.zeros(len(raw) - FIRST + 1, dtype=np.uint64)
                    for j in range(FIRST):
                        rank = rank << np.uint64(8) | raw[j:len(raw) - FIRST + 1 + j]
                    rank ^= np.uint64(1 << 63)
                    for a in range(0, len(rank), 50_000):
                        own = rank[a:a + 50_000]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(own), k))), pa.array(np.arange(a, a + len(own), dtype=np.int32)), pa.array(own.view(np.int64))], names=["doc_id", "i", "rank"])

    return docs.mapInArrow(run, "doc_id long, i int, rank long")


def later_starts(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, i): starts of strings of `length` bytes (8 or more) that also start earlier (smaller doc_id, or the same one and a smaller place).

    Each round joins a position's rank with the rank at an offset, the width known so far; Spark
    sorts the distinct pairs and numbers those that more than one position has, and positions with
    a pair of their own leave. The last offset makes the width `length`. doc_id is unique and not
    null; null and empty texts have no positions.
    """
    small_batches(docs.sparkSession)
    known, width = written(_positions(id_and_text(docs, id_col, text_col).where("doc_id is not null")), "ranks"), FIRST
    while width < length:
        step = min(width, length - width)
        ahead = known.select("doc_id", (F.col("i") - step).alias("i"), F.col("rank").alias("other"))
        pairs = written(known.join(ahead, ["doc_id", "i"]), "pairs")
        shared = pairs.groupBy("rank", "other").agg(F.count("*").alias("n")).where("n > 1").select("rank", "other")
        numbered = written(shared.orderBy("rank", "other").withColumn("next", F.monotonically_increasing_id()), "numbers")
        again = written(pairs.join(numbered, ["rank", "other"]).select("doc_id", "i", F.col("next").alias("rank")), "ranks")
        discard(known, pairs, numbered)
        known, width = again, width + step
    place = F.struct("doc_id", "i")
    first = known.groupBy("rank").agg(F.min(place).alias("first"))
    return known.join(first, "rank").where(F.struct("doc_id", "i") > F.col("first")).select("doc_id", "i")
