"""Known values of column functions, file handling, datasets and ingest."""

import pytest
from pyspark.sql import functions as F

from latticelake.functions import scalars as S
from latticelake.operators import geometry as G
from latticelake.operators import maintain as MT
from latticelake.operators import runs as R
from latticelake.operators import spectra as SP
from latticelake.reference_data import RADII, SYMBOLS, elements
from latticelake.sources import files as SF
from latticelake.streaming.ingest import append_new


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_formulas(spark):
    assert value(spark, S.html_formula(F.lit("SrTiO3-d"))) == "SrTiO<sub>3-d</sub>"
    assert value(spark, S.html_formula(F.lit("C11H22O5NS2"))) == "C<sub>11</sub>H<sub>22</sub>O<sub>5</sub>NS<sub>2</sub>"
    assert value(spark, S.standard_formula(F.array(*map(F.lit, "H O C H H C H H H".split())))) == "C2H6O"
    assert value(spark, S.standard_formula(F.array(*map(F.lit, ["Lu", "o2", "X"])))) == "OLu"
    assert value(spark, S.reduced_formula(S.parse_formula(F.lit("Si16")))) == "Si16"
    assert value(spark, S.reduced_formula(S.parse_formula(F.lit("Sr4Ti4O12")))) == "SrTiO3"
    assert value(spark, S.chemical_symbols(F.lit("SrTiO3: x"))) == ["Sr", "Ti", "O"]


def test_scalars(spark):
    assert value(spark, S.url_is_valid(F.lit("ftp://test.test.test.test:8080/test?test=test#test/test")))
    assert not value(spark, S.url_is_valid(F.lit("not a url")))
    assert value(spark, S.human_size(F.lit(512 * 1024 * 1024 * 1020))) == "510.0GB"
    for v, want in (([0.0, 0.0], [0, 0]), ([-5.0, 5.0], [-1, 1]), ([float("-inf"), float("inf")], [-1, 1])):
        assert value(spark, S.direction(F.array(*map(F.lit, v)))) == want
    assert value(spark, S.crystal_system(F.lit(221))) == "cubic" and value(spark, S.point_group(F.lit(221))) == "O<sub>h</sub>"
    assert value(spark, S.crystal_system(F.lit(8))) == "monoclinic" and value(spark, S.point_group(F.lit(8))) == "C<sub>s</sub>"
    assert value(spark, S.space_group_label(F.lit(221), F.lit("Pm-3m"))) == "221 &mdash; Pm-3m"
    assert value(spark, S.duration_hours(F.lit("1d2h30m"))) == 26.5
    shells = lambda *x: F.array(*(F.struct(F.lit(t).alias("type"), F.lit(n).alias("size")) for t, n in x))
    assert value(spark, S.basis_label(shells(("S", 3), ("S", 3), ("P", 1)), shells(("d", 2)))) == "[d<sup>2</sup>](s<sup>3</sup>)<sup>2</sup>p<sup>1</sup>"
    pairs = [F.array(*map(F.lit, x)) for x in (["Ni", "O", "Ni", "Ni", "Fe"], [6.0, 0.0, 5.0, 6.0, 1.0], [1.0, 0.0, 1.0, 1.0, 0.0])]
    assert value(spark, S.hubbard_label(*pairs, F.lit(2))) == "GGA+U(std.) Fe:1.0/0.0 Ni1:5.0/1.0 Ni:6.0/1.0"
    assert value(spark, S.hubbard_label(F.array(F.lit("Ni"), F.lit("O")), F.array(F.lit(6.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == "Ni:6.0/1.0"
    assert [value(spark, S.periodic_group(F.lit(z))) for z in (1, 2, 3, 5, 11, 18, 26, 57, 58, 72, 86, 92)] == [1, 18, 1, 13, 1, 18, 8, 3, 3, 4, 18, 3]
    assert value(spark, S.layer_group(F.lit(25), F.lit(False))) == 24 and value(spark, S.layer_group(F.lit(6), F.lit(True))) == 4


def test_convergence_order(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([10000.0, 1000.0, 100.0, 99.0])], "run_id int, step int, value double")
    assert [r.magnitude for r in R.convergence_order(df).orderBy("step").collect()] == [3, 2, 0]


def test_gaps_and_classes(spark):
    rows = [(1, [[-2.0, -1.0], [1.0, 2.0]], [0.0, 1.0]), (2, [[-1.0, 0.5], [1.0, 2.0]], [0.0, 0.0]), (3, [[-2.0, 2.0], [1.0, 2.0]], [0.0, 1.0]), (4, [[-2.0, -1.0], [1.0, 2.0], [-1.0, 1.0]], [0.0, 1.0]), (5, [[-2.0, -1.0]], [0.0, 1.0])]
    df = spark.createDataFrame(rows, "run_id int, stripes array<array<double>>, abscissa array<double>")
    assert [(r.gap, r.direct) for r in SP.band_gap(df).orderBy("run_id").collect()] == [(2.0, False), (0.5, True), (0.0, None), (2.0, False), (None, None)]
    assert [r.c for r in df.orderBy("run_id").select(SP.is_conductor(F.col("stripes")).alias("c")).collect()] == [False, True, True, False, False]
    radii = dict(zip(SYMBOLS, RADII, strict=True))
    assert value(spark, G.is_perovskite(S.parse_formula(F.lit("SrTiO3")), radii)) and not value(spark, G.is_perovskite(S.parse_formula(F.lit("C2H6O")), radii))
    assert value(spark, G.vacancy_defect(S.parse_formula(F.lit("Sr8Ti8O23")))).asDict() == {"gcd": 8, "element": "O", "added": 1}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.out").write_text("     Program PWSCF v.5.0 starts on 1\n     Current dimensions of program PWSCF are:\n!    total energy              =     -10.0 Ry\n     Exchange-correlation      =  PBE (1 4)\n     PWSCF        :     1.00s CPU      2m WALL\n")
    (tmp_path / "a" / "x.in").write_text("&control")
    (tmp_path / "a" / "_skip.out").write_text("nothing")
    found = SF.scan_files(spark, str(tmp_path), True, ["_"])
    assert found.count() == 2
    logs = found.where("path like '%.out'").select("path", F.col("content").cast("string").alias("text"))
    assert logs.select(SF.detect_format(F.col("text")).alias("f")).first().f == "pwscf"
    run = SF.parse_runs(logs).first()
    assert (run.finished, run.H, run.error, run.hours) == (2, "PBE", None, 0.03) and abs(run.energy + 136.05693) < 1e-6
    assert SF.attach_inputs(found).first().input.endswith("x.in")


def test_datasets(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "parent_checksum string, children_checksum string")
    assert {tuple(r) for r in MT.ancestors(edges).collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 1)}
    sizes = spark.createDataFrame([(x, 10) for x in "abcd"], "checksum string, download_size long")
    keys = spark.createDataFrame([("d",)], "checksum string")
    runs, tags = sizes.withColumn("nested_depth", F.lit(0)), spark.createDataFrame([("d", 2, "Sr"), ("d", 1, "x"), ("b", 1, "title")], "checksum string, cid int, topic string")
    after = MT.augment(runs, edges, tags, "b", keys)
    assert after["calcsets"].count() == 4 and {r.checksum: (r.download_size, r.nested_depth) for r in after["runs"].collect()} == {"a": (20, 2), "b": (20, 1), "c": (10, 0), "d": (10, 0)}
    assert {(r.cid, r.topic) for r in after["raw_tags"].where("checksum = 'b'").collect()} == {(2, "Sr"), (1, "title")}
    for parent, own in (("b", "a"), ("b", "b"), ("c", "d"), ("b", "c")):
        with pytest.raises(ValueError):
            MT.augment(runs, edges, tags, parent, spark.createDataFrame([(own,)], "checksum string"))


def test_ingest_and_round_trips(spark, tmp_path):
    batch = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "checksum string, v int")
    paths = str(tmp_path / "repo"), str(tmp_path / "rejected")
    assert append_new(batch, *paths) == (2, 1) and append_new(batch, *paths) == (0, 3)
    assert {tuple(r) for r in spark.read.parquet(paths[1]).collect()} == {(k, "This calculation already exists!") for k in "xy"} and spark.read.parquet(paths[0]).count() == 2
    atoms = spark.createDataFrame([(1, 1, 8, 0.5, 1.0, 1.5)], "struct_id int, atom_idx int, number int, x double, y double, z double")
    cell = spark.createDataFrame([(1, 2.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 6.0)], "struct_id int, " + ", ".join(f"a{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)))
    assert tuple(G.fractional(atoms, cell).select("fx", "fy", "fz").first()) == (0.25, 0.25, 0.25)
    assert "O O" in G.to_cif(atoms, cell, elements(spark)).first().cif
