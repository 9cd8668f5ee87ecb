"""Closure by doubling, pages of a listing, range joins, kept counts, apps that fail, and bibliography from JSON."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from latticelake import plugins as P
from latticelake.operators import facets as FA
from latticelake.operators import maintain as MT
from latticelake.operators import paging as PG
from latticelake.operators import ranges as RG
from latticelake.sources import files as SF

EDGES = "parent_checksum string, children_checksum string"


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(MT, "written", lambda df, name, f=MT.written: rounds.append(name) or f(df, name))
    n = 700
    got = MT.ancestors(spark.createDataFrame([(f"d{i}", f"d{i + 1}") for i in range(n)], EDGES))
    assert got.count() == n * (n + 1) // 2 and got.where("int(substring(node, 2)) - int(substring(ancestor, 2)) <> distance").count() == 0
    assert len(rounds) <= 12


def test_least_distances_of_a_graph(spark):
    g = random.Random(1)
    edges = [(f"d{a}", f"d{b}") for a, b in {tuple(sorted(g.sample(range(60), 2))) for _ in range(110)}]
    up, want = collections.defaultdict(set), set()
    for a, b in edges:
        up[b].add(a)
    for node in list(up):
        seen, level, d = {node}, up[node], 1
        while level:
            want |= {(node, a, d) for a in level}
            seen |= level
            level, d = {x for a in level for x in up[a]} - seen, d + 1
    assert {tuple(r) for r in MT.ancestors(spark.createDataFrame(edges + edges[:3] + [(None, "d1")], EDGES)).collect()} == want
    with pytest.raises(ValueError, match="itself"):
        MT.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], EDGES))
    assert MT.ancestors(spark.createDataFrame([], EDGES)).count() == 0


def test_a_page_opens_one_part(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 97).alias("name"), F.col("id").cast("string").alias("checksum"))
    path, by = str(tmp_path / "listing"), ["name", "checksum"]
    assert PG.write_listing(rows, by, path, per_part=500) == 5000
    for page, size in ((0, 50), (33, 50), (99, 50), (7, 600), (100, 50), (3, 5000)):
        got = PG.read_page(spark, path, by, page, size)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in rows.orderBy(*by).offset(page * size).limit(size).collect()]
    one = PG.read_page(spark, path, by, 33, 50)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    parts = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert parts.count("=") + parts.count("IN") <= 2
    PG.write_listing(rows.where("false"), by, path)
    assert PG.read_page(spark, path, by, 0, 50).count() == 0


def test_range_join(spark):
    g = random.Random(2)
    ranges = [(a, a + g.choice([0, 1, 5, 40, 700]), f"r{i}") for i, a in enumerate(g.sample(range(-500, 1500), 60))] + [(5, 4, "empty"), (None, 7, "open")]
    values = [g.randrange(-600, 2500) for _ in range(300)] + [None, 3]
    got = RG.interval_join(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int"), "v", spark.createDataFrame(ranges, "low int, high int, label string"))
    want = collections.Counter()
    for i, v in enumerate(values):
        own = [r for r in ranges if v is not None and r[0] is not None and r[0] <= v <= r[1]]
        want.update((v, i, *r) for r in own or [(None, None, None)])
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert RG.interval_join(spark.createDataFrame([(1, 1)], "v int, i int"), "v", spark.createDataFrame([], "low int, high int, label string")).collect()[0].label is None
    pairs = {tuple(sorted((a[2], b[2]))) for a in ranges[:60] for b in ranges[:60] if a is not b and a[0] <= b[1] and b[0] <= a[1]}
    assert {tuple(r) for r in RG.overlapping(spark.createDataFrame(ranges, "low int, high int, label string"), "label").collect()} == pairs


def test_kept_counts_after_any_changes(spark):
    g = random.Random(3)
    tags = {(f"c{g.randrange(40)}", g.randrange(8)) for _ in range(120)}
    df = lambda rows: spark.createDataFrame(sorted(rows), "checksum string, tid int")
    counts = FA.topic_counts(df(tags))
    for _ in range(4):
        keys = {f"c{g.randrange(40)}" for _ in range(6)}
        old = {t for t in tags if t[0] in keys}
        new = {(k, g.randrange(8)) for k in keys for _ in range(2)} if g.random() < 0.7 else set()
        tags = tags - old | new
        counts = FA.changed_counts(counts, df(old), df(new))
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in FA.topic_counts(df(tags)).collect()}


def test_apps_that_fail_cost_their_own_row(spark):
    runs = spark.createDataFrame([(f"c{i}", i, [i, i + 1]) for i in range(12)] + [("n", None, None)], "checksum string, v int, steps array<int>")

    def odd(run):
        if run["v"] == 3:
            raise KeyError("missing")
        if run["v"] == 4:
            time.sleep(30)
        if run["v"] == 5:
            raise SystemExit(2)
        return None if run["v"] == 6 else sum(run["steps"])

    start = time.time()
    apps = {"odd": P.IsolatedApp({"v": ""}, odd, seconds=0.5), "never": P.IsolatedApp({"missing": "x"}, odd)}
    got = {r.checksum: (r.data, r.error) for r in P.run_isolated(runs, apps).collect()}
    assert set(got) == {f"c{i}" for i in range(12)} and time.time() - start < 25
    assert all(got[f"c{i}"] == (str(2 * i + 1), None) for i in range(12) if i not in (3, 4, 5, 6))
    assert [got[f"c{i}"][1].split("\n ")[1] for i in (3, 4, 5)] == ["KeyError: 'missing'", "TimeoutError: took more than 0.5 s", "SystemExit: 2"] and got["c6"][1].startswith("No appdata")
    dry = P.run_isolated(runs, apps, dry_run=True).collect()
    assert len(dry) == 12 and {(r.data, r.error) for r in dry} == {(None, None)}


def test_articles_from_json(spark):
    els = ['{"els2paperids": {"Ti": ["p1", "p2", "p1"], "O": ["p1"]}, "paperids2bib": {"p1": ["A and B and A", "Tïtle", "2001", "J. 1"]}}', '{"els2paperids": {"Sr": ["p1"]}, "paperids2bib": {"p2": ["C", "T2", "2002", "J. 2"], "p3": ["D", "none", "2003", "J"]}}', None]
    meta = ['{"p2": ["f.pdf", "10.1/2", "E, F, E", "Own", "Journal", "2010"]}', "{}"]
    df = lambda x: spark.createDataFrame([(t,) for t in x], "text string")
    got = {r.paper: r for r in SF.load_articles_json(df(els), df(meta), spark.createDataFrame([("p2", ["Zr", "Ti", "Zr"])], "paper string, elements array<string>")).collect()}
    assert set(got) == {"p1", "p2"}
    assert (got["p1"].standard, got["p1"].authors, got["p1"].title, got["p1"].year, got["p1"].doi, got["p1"].location) == ("O / Sr / Ti", ["A", "B"], "Ttle", "2001", None, "data/NONCE")
    assert (got["p2"].standard, got["p2"].authors, got["p2"].title, got["p2"].pubdata, got["p2"].doi, got["p2"].location) == ("Ti / Zr", ["E", "F"], "Own", "Journal", "10.1/2", "f.pdf")


def test_setups_of_logs(spark):
    files = spark.createDataFrame([("a/x.cryst.out", "l"), ("a/x.d12", "i"), ("a/x.gui", "g"), ("a/y.out", "l"), ("a/fort.87", "bad grid\nmore"), ("b/y.out", "l"), ("b/z.d12", "i"), ("b/fort.87", "")], "path string, text string")
    assert {r.path: (r.related, r.warning) for r in SF.attach_setups(files).collect()} == {"a/x.cryst.out": (["a/x.cryst.out", "a/x.d12", "a/x.gui"], "bad grid"), "a/y.out": (["a/y.out"], "bad grid"), "b/y.out": (["b/y.out"], None)}


def test_files_of_a_listing_follow_its_rows(spark, tmp_path, monkeypatch):
    """short ranges lie many to a file, and pages across files are whole."""
    import glob

    rows = spark.range(5000).select((F.col("id") * 7919 % 97).alias("name"), F.col("id").cast("string").alias("checksum"))
    path, by = str(tmp_path / "listing"), ["name", "checksum"]
    PG.write_listing(rows, by, path, per_part=40)
    assert len(glob.glob(f"{path}/rows/*/*.parquet")) == 1
    monkeypatch.setattr(PG, "PER_FILE", 1500)
    PG.write_listing(rows, by, path, per_part=40)
    assert 1 < len(glob.glob(f"{path}/rows/*/*.parquet")) <= 4
    for page, size in ((0, 50), (29, 50), (0, 5000), (2, 1400)):
        assert [tuple(r) for r in PG.read_page(spark, path, by, page, size).collect()] == [tuple(r) for r in rows.orderBy(*by).offset(page * size).limit(size).collect()]
