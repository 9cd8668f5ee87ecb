"""How many Python workers a task needs."""

from pyspark.sql import functions as F

from latticelake.llm import quality


def test_references_need_one_worker_a_task(spark, sf, monkeypatch):
    """Texts are measured and summed in one Python step, with the sums of judge()."""
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    plain = quality.references(quality.profiles(docs))
    monkeypatch.setattr(quality, "written", lambda df, name: seen.append(df) or df)
    quality.keep_good(docs)
    assert seen[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("MapInArrow") == 1
    assert sorted(map(tuple, seen[0].collect())) == sorted(map(tuple, plain.collect()))
    none = docs.where("false").select(F.col("lang"), F.col("text"))
    assert none.mapInArrow(quality._summed_texts, quality.SUMS).isEmpty()
