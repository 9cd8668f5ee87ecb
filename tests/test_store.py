"""Buckets: joins without a shuffle, rewrites that leave other files alone, and the switch of versions."""

import os
import re

import pytest
from pyspark.sql import functions as F

from latticelake.operators import facets as FA
from latticelake.operators import maintain as MT
from latticelake.operators import runs as R
from latticelake.plans.registry import Tables
from latticelake.sources import store as ST


@pytest.fixture
def built(spark, sf, tmp_path):
    t = Tables(spark, sf)
    tables = {"electrons": t.b_electrons, "spacegroups": t.b_spacegroups, "energies": t.b_energies, "structures": t.b_structures, "atoms": t.b_atoms, "lattices": t.b_lattices, "tags": t.b_tags, "topics": t.b_topics,
              "sizes": t.b_metadata.select("checksum", "download_size", F.lit(0).alias("siblings_count"))}
    ST.save(tables, str(tmp_path / "lake"), buckets=16)
    store = ST.open_store(spark, str(tmp_path / "lake"))
    yield store, tables, str(tmp_path / "lake")
    store.close()


def files(store, name):
    return {int(re.search(r"b=(\d+)", d)[1]): sorted(x for x in names if x.endswith(".parquet")) for d, _, names in os.walk(store.path(name).removeprefix("file://")) if "b=" in d and any(x.endswith(".parquet") for x in names)}


def rows(df):
    return sorted(df.collect(), key=repr)


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_tables_come_back(built):
    store, tables, _ = built
    for name, t in tables.items():
        assert rows(store.tables[name].select(*t.columns)) == rows(t)
        assert name == "topics" or all(len(x) == 1 for x in files(store, name).values())


def test_joins_need_no_exchange(spark, built):
    store, _, _ = built
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = store.tables
        joins = {"J1": R.join_properties(t["electrons"], t["spacegroups"], t["energies"]), "F2": R.range_filter(t["energies"], {"electrons": t["electrons"]}, [("electrons", "gap", 1, 6)]), "S11": t["lattices"].join(t["atoms"], "struct_id"),
                 "grouped": t["atoms"].groupBy("struct_id").count()}
        assert {k: exchanges(v) for k, v in joins.items()} == dict.fromkeys(joins, 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rewrites_leave_other_files_alone(spark, built):
    store, tables, _ = built
    keys = spark.createDataFrame([(r.checksum,) for r in tables["electrons"].orderBy("checksum").limit(3).collect()], "checksum string")
    before = {n: files(store, n) for n in tables}
    done = {"tags": ST.append_topics(store, keys, 2, ["Sr"])}
    assert rows(store.tables["tags"]) == rows(FA.append_topics(tables["tags"], tables["topics"], keys, 2, ["Sr"]))
    now = spark.createDataFrame(store.tables["tags"].collect(), tables["tags"].schema)
    assert ST.replace_topics(store, keys, 22, ["1"]) == done["tags"]
    assert rows(store.tables["tags"]) == rows(FA.replace_topics(now, tables["topics"], keys, 22, ["1"]))
    done["sizes"] = ST.set_sizes(store, keys.select("checksum", F.lit(7).cast("long").alias("download_size")))
    assert store.tables["sizes"].where("download_size = 7").count() == 3
    for name, own in done.items():
        after = files(store, name)
        assert 0 < len(own) < 16 and all(after[b] == before[name][b] for b in after if b not in own) and all(after[b] != before[name][b] for b in own)


def test_purge_of_few_runs(spark, built):
    store, tables, root = built
    keys = spark.createDataFrame([(r.checksum,) for r in tables["electrons"].orderBy("checksum").limit(2).collect()], "checksum string")
    want, before = MT.purge({n: t for n, t in tables.items() if n != "topics"}, keys), {n: files(store, n) for n in tables}
    done = ST.purge(store, keys)
    for name, t in want.items():
        assert rows(store.tables[name].select(*t.columns)) == rows(t)
        after = files(store, name)
        assert all(after.get(b) == x for b, x in before[name].items() if b not in done[name])
    assert ST.purge(store, keys)["atoms"] == []  # nothing is left to do
    again = ST.open_store(spark, root)
    assert rows(again.tables["atoms"]) == rows(want["atoms"])
    again.close()


def test_an_emptied_bucket_goes(spark, tmp_path):
    t = spark.createDataFrame([(f"C{i}", i) for i in range(40)], "checksum string, v int")
    ST.save({"runs": t}, str(tmp_path / "lake"), buckets=8)
    store = ST.open_store(spark, str(tmp_path / "lake"))
    bucket = ST.bucket_of(F.col("checksum"), 8)
    some = t.where(bucket == t.select(bucket.alias("b")).first().b)
    ST.purge(store, some.select("checksum"))
    assert rows(store.tables["runs"]) == rows(t.exceptAll(some)) and len(files(store, "runs")) == 7
    store.close()


def test_versions_switch_at_the_end(spark, tmp_path, monkeypatch):
    root, t = str(tmp_path / "lake"), spark.createDataFrame([("a", 1), ("b", 2)], "checksum string, v int")
    ST.save({"runs": t}, root, buckets=2)
    monkeypatch.setattr(ST, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        ST.save({"runs": t.where("v = 1")}, root, buckets=2)
    monkeypatch.undo()
    store = ST.open_store(spark, root)
    assert store.tables["runs"].count() == 2
    ST.save({"runs": t.where("v = 1")}, root, buckets=4)
    other = ST.open_store(spark, root)
    assert other.tables["runs"].count() == 1 and store.tables["runs"].count() == 2  # open readers keep their version
    store.close(), other.close()
