"""Streamed batches exactly once, whatever dies in between."""

import pytest
from pyspark.sql import functions as F

from latticelake.streaming import ingest as IN

SCHEMA = "checksum string, v int"


def state(spark, root, schema):
    return (sorted((r.checksum, r.v) for r in IN.repository(spark, root, schema).collect()), sorted((str(r.checksum), r.error) for r in IN.rejected_runs(spark, root).collect()))


def rows(spark, low, high, v):
    return spark.createDataFrame([(f"C{i}", v) for i in range(low, high)], SCHEMA)


@pytest.mark.parametrize("dies", ["runs", "rejected", "commits"])
def test_a_batch_that_dies_is_replayed(spark, tmp_path, monkeypatch, dies):
    """The stream dies before the named table is written; the replay leaves what an undisturbed run leaves."""
    source, states = str(tmp_path / "in"), []
    rows(spark, 0, 60, 1).coalesce(1).write.json(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    plain = str(tmp_path / "plain"), str(tmp_path / "c0")
    broken = str(tmp_path / "broken"), str(tmp_path / "c1")
    for root, checkpoint in (plain, broken):
        IN.ingest(stream, root, checkpoint).awaitTermination()
    rows(spark, 40, 100, 2).unionByName(rows(spark, 99, 100, 1)).unionByName(spark.createDataFrame([(None, 3)], SCHEMA)).coalesce(1).write.mode("append").json(source)
    IN.ingest(stream, *plain).awaitTermination()
    write = IN._write

    def dying(df, path, *more):
        if path.endswith(dies):
            raise RuntimeError("killed")
        write(df, path, *more)
        if dies == "commits" and path.endswith("rejected"):
            raise RuntimeError("killed")

    monkeypatch.setattr(IN, "_write", dying)
    with pytest.raises(Exception, match="killed"):
        IN.ingest(stream, *broken).awaitTermination()
    schema = stream.schema
    assert state(spark, broken[0], schema)[0] == [(f"C{i}", 1) for i in sorted(range(60), key=lambda i: f"C{i}")]  # the dead batch isn't seen
    monkeypatch.setattr(IN, "_write", write)
    IN.ingest(stream, *broken).awaitTermination()
    states = [state(spark, r, schema) for r, _ in (plain, broken)]
    assert states[0] == states[1] and len(states[0][0]) == 100 and ("C99", 1) in states[0][0] and len(states[0][1]) == 22
    again = spark.createDataFrame([("C1000", 1)], SCHEMA)
    assert IN.ingest_batch(again, broken[0], 0) == (60, 0) and state(spark, broken[0], schema) == states[0]  # a whole batch isn't handled again


def test_only_touched_parts_are_read(spark, tmp_path):
    root = str(tmp_path / "repo")
    IN.ingest_batch(rows(spark, 0, 2000, 1), root, 0)
    batch = rows(spark, 0, 3, 1).withColumn("part", IN.key_part(F.col("checksum")))
    known = IN.known_parts(batch, root, rows(spark, 0, 1, 1).schema)
    parts = {r.part for r in batch.collect()}
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and all(p in plan for p in parts)
    assert "PushedFilters: [In(checksum" in plan or "Or(" in plan  # few keys go to the files' Bloom filters
    assert known.count() == 3 and known.distinct().count() == 3
