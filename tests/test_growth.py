"""Steps whose data must grow no faster than their input: shuffles are counted in plans, results compared with plain ones."""

import math
import random

from pyspark.sql import functions as F

from latticelake.functions import scalars as S
from latticelake.operators import geometry as G
from latticelake.plans import registry, repository  # noqa: F401  the second one registers further queries
from latticelake.plans.bindings import table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_neighbours_go_by_structure(spark, sf):
    """atoms and cells are dealt by structure once, images and bins are not shuffled."""
    for name in ("j7_neighbours", "a13_octahedra"):
        text = plan(registry.QUERIES[name](spark, sf))
        assert "hashpartitioning(struct_id" in text and ", bx" not in "".join(x for x in text.splitlines() if "Exchange" in x)


def test_neighbours_of_a_big_cell(spark):
    g = random.Random(3)
    rows = [(1, i, g.choice((22, 8)), *(g.uniform(-30, 30) for _ in "xyz")) for i in range(400)] + [(2, 1, 22, 0.0, 0.0, 0.0), (2, 2, 8, 2.5, 0.0, 0.0), (3, 1, 8, 0.0, 0.0, 0.0), (4, 1, 22, None, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "struct_id long, atom_idx int, number int, x double, y double, z double")
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] == 22 and None not in a and None not in b and math.dist(a[3:], b[3:]) <= 6}
    assert {(r.struct_id, r.center, r.ligand) for r in G.neighbours(atoms, [22], [8, 22], most=6).collect()} == want and len(want) > 20


def test_atoms_are_the_views_atoms(spark, sf):
    from latticelake.plans.bindings import _bound, with_views

    sql = spark.sql(_bound(with_views("select * from b_atoms", "spark"), ["lineitem"]), t_lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    own = table(spark, sf, "b_atoms")
    assert own.columns == sql.columns and own.exceptAll(sql).isEmpty() and sql.exceptAll(own).isEmpty()


def test_values_are_computed_once(spark):
    """the formula is parsed once a row, not once for each trial."""
    df = spark.createDataFrame([("Sr7Ti8O24",), (None,), ("H",)], "formula string")
    out = df.select(G.vacancy_defect(S.parse_formula(F.col("formula"))).alias("x"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2
    assert [r.x and tuple(r.x) for r in out.collect()] == [(8, "Sr", 1), None, None]


def test_labels_are_cleaned_once(spark):
    """each label of a structure is cleaned once, not once for each element."""
    out = spark.createDataFrame([(["Ti1", "O", "o2", "X"],), ([],), (None,)], "s array<string>").select(S.standard_formula(F.col("s")).alias("x"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
    assert [r.x for r in out.collect()] == ["TiO2", "", None]


def test_layers_need_no_index(spark, sf):
    """atoms are shuffled once for their layers, and not numbered."""
    text = plan(registry.QUERIES["w4_slab_layers"](spark, sf))
    assert "row_number" not in text and text.count("Exchange hashpartitioning") <= 2


def test_tags_by_broadcast_topics(spark, sf):
    """F8: topics are broadcast, so the rows of a frequent topic don't meet in one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(table(spark, sf, "b_tags"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in text


def test_lists_of_papers_are_bounded(spark, sf):
    """no row holds all papers of an element."""
    papers = repository._papers(registry.Tables(spark, sf))
    assert papers.agg(F.max(F.size("papers"))).first()[0] <= 1000


def test_only_corners_are_turned(spark):
    """an octahedron found in a cell on its side is turned upright."""
    from latticelake.operators import tilting as TI

    cells = spark.createDataFrame([(1, 9.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0)], "struct_id long, " + ", ".join(f"a{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)))
    found = spark.createDataFrame([(1, 1, [(2.0, 0.0, 0.0)], None), (2, None, None, "none")], "struct_id long, center int, corners array<struct<x:double,y:double,z:double>>, error string")
    got = {r.struct_id: r for r in TI.upright_corners(found, cells).collect()}
    assert [tuple(c) for c in got[1].corners] == [(0.0, 0.0, 2.0)] and got[2].error == "none"


def test_tags_are_grouped_after_they_are_dealt(spark, sf):
    """No task keeps the keys of its part of a file; tags are dealt by run once, and topics need no runs."""
    text = plan(table(spark, sf, "b_tags"))
    assert "HashAggregate(keys=[checksum" not in text and text.count("hashpartitioning(checksum") == 1
    assert "checksum" not in plan(table(spark, sf, "b_topics"))


def test_distinct_tags(spark):
    """Pairs once, also without a run or a number."""
    from latticelake.operators import facets as FA

    rows = [("a", 1), ("a", 1), ("a", None), ("a", None), ("b", 1), (None, 2), (None, 2)]
    out = FA.distinct_tags(spark.createDataFrame(rows, "checksum string, tid int"))
    assert "HashAggregate" not in plan(out) and sorted(map(tuple, out.collect()), key=str) == sorted(set(rows), key=str)


def test_cell_drift_is_sorted_for(spark):
    """the ends of a run are one value each; steps without a number don't count."""
    cells = spark.createDataFrame([(i, 1.0 + i, *[0.0] * 3, 2.0, *[0.0] * 3, 3.0) for i in range(4)], "struct_id long, " + ", ".join(f"a{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)))
    steps = spark.createDataFrame([(0, "a", 0), (1, "a", 2), (2, "a", 1), (3, "a", None), (0, "b", None)], "struct_id long, checksum string, step int")
    out = G.cell_drift(steps, cells)
    assert "max_by" not in plan(out) and {r.checksum: (r.da, r.dv) for r in out.collect()} == {"a": (1.0, 6.0), "b": (None, None)}


def test_star_lattices_join_nothing(spark, sf):
    """cells and their parameters come from one row."""
    from latticelake.operators import star as ST

    t = registry.Tables(spark, sf)
    runs = ST.nested(t.b_structures, t.b_lattices, t.b_atoms).select("checksum", "steps", F.lit(None).cast("double").alias("energy"))
    cells = ST.star_schema(runs)["lattices"]
    assert plan(cells).count("Join") == plan(runs).count("Join") and cells.columns[:7] == ["struct_id", "a", "b", "c", "alpha", "beta", "gamma"] and len(cells.columns) == 16


def test_only_final_structures_atoms_are_numbered(spark, sf):
    """atoms of other structures go before they are dealt and numbered."""
    text = plan(repository._runs(registry.Tables(spark, sf)))
    assert "% 2) = 1" in text.split("Window", 1)[1]


def test_paths_are_read_once_a_stretch():
    """lines reach the reader in stretches of one file, also null and empty lines."""
    import pyarrow as pa

    from latticelake.sources import files as SF

    batches = [pa.RecordBatch.from_arrays([pa.array(p), pa.array(x)], names=["path", "line"]) for p, x in ((["a", "a", "b"], ["1", None, ""]), (["b"], ["2"]), ([], []))]
    batches[2] = batches[2].cast(batches[0].schema)
    assert list(SF._stretches(batches)) == [("a", ["1", None]), ("b", [""]), ("b", ["2"])]


def test_axes_only_of_cells_with_octahedra(spark):
    """F2 (round 4): g10_tilting_angles: axes are worked out after cells without octahedra have left, and cells are read once."""
    from latticelake.operators import tilting as TI

    place = "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D, 'z', {z}D)" for x, y, z in ((2, 0, 0), (-2, 0, 0), (0, 2, 0), (0, -2, 0), (0, 0, 2), (0, 0, -2))) + ")"
    octahedra = spark.range(2000).selectExpr("id as struct_id", "if(id = 7, 1, null) as center", f"if(id = 7, {place}, null) as corners", "if(id = 7, null, 'none') as error")
    lattices = spark.range(2000).selectExpr("id as struct_id", "id % 2 + 4D as a11", "0D as a12", "0D as a13", "0D as a21", "id % 2 + 4D as a22", "0D as a23", "0D as a31", "0D as a32", "id % 2 + 5D as a33")
    out = TI.tilting_angles(TI.upright_corners(octahedra, lattices))
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, line in enumerate(lines) if "Join LeftSemi" in line]
    assert len(joins) == 1 and all(i < joins[0] for i, line in enumerate(lines) if "pmod" in line)
    got = {r.struct_id: r for r in out.collect()}
    assert len(got) == 2000 and got[7].error is None and (got[7].alpha, got[7].beta, got[7].gamma) == (0, 0, 0) and sum(r.error == "none" for r in got.values()) == 1999
