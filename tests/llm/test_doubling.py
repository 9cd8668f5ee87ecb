"""Prefix doubling in full against brute force, and against the operator that cuts positions down first."""

import random

from pyspark.sql import functions as F

from latticelake.llm import doubling, repeats


def test_later_starts(spark):
    g = random.Random(2)
    parts = ["".join(g.choice("abé ") for _ in range(g.choice([5, 30, 60, 150]))) for _ in range(12)]
    rows = [(i, "".join(g.choice(parts) for _ in range(g.randint(0, 6)))) for i in range(40)] + [(100, None), (101, ""), (102, "x" * 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (8, 50, 100):
        seen, want = {}, set()
        for d, t in rows:
            raw = (t or "").encode()
            for i in range(len(raw) - length + 1):
                if raw[i:i + length] in seen:
                    want.add((d, i))
                seen.setdefault(raw[i:i + length], (d, i))
        assert {tuple(r) for r in doubling.later_starts(docs, length).collect()} == want
    covered = doubling.later_starts(docs, 100).select("doc_id", F.explode(F.sequence(F.col("i"), F.col("i") + 99)).alias("b")).distinct().groupBy("doc_id").count()
    told = {r.doc_id: r.n_removed for r in repeats.without_repeats(docs, length=100).collect() if r.n_removed}
    assert {r.doc_id: r["count"] for r in covered.collect()} == told
