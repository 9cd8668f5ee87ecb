"""Classification, slabs, impurities, tilting, splines, parsed logs, plug-ins and the star schema."""

import math

import numpy as np
from pyspark.sql import functions as F

from latticelake import plugins as P
from latticelake.operators import classify as C
from latticelake.operators import geometry as G
from latticelake.operators import maintain as MT
from latticelake.operators import spectra as SP
from latticelake.operators import star as ST
from latticelake.operators import tilting as T
from latticelake.sources import files as SF

CUBE = [[3.9, 0.0, 0.0], [0.0, 3.9, 0.0], [0.0, 0.0, 3.9]]
STO = [("Sr", 0, 0, 0), ("Ti", 0.5, 0.5, 0.5), ("O", 0.5, 0.5, 0), ("O", 0.5, 0, 0.5), ("O", 0, 0.5, 0.5)]


def sites(rows, scale=3.9):
    return [(s, float(x * scale), float(y * scale), float(z * scale), None, None) for s, x, y, z in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "checksum string, atoms array<struct<symbol:string,x:double,y:double,z:double,charge:double,magmom:double>>, cell array<array<double>>, energy double, finished int, xc_types array<int>, ng int, sg string")


def test_classify(spark):
    big = [(s, x + i, y + j, z + k) for s, x, y, z in STO for i in range(2) for j in range(2) for k in range(2)]
    vacancy = [a for n, a in enumerate(big) if n != len(big) - 1]
    wide = [[30.0, 0.0, 0.0], [0.0, 30.0, 0.0], [0.0, 0.0, 30.0]]
    double = [[2 * x for x in v] for v in CUBE]
    slab = [("Ti", 0, 0, 1.0), ("O", 1, 1, 1.0), ("Sr", 0, 0, 4.0), ("O", 1, 1, 4.0), ("Ti", 0, 0, 7.0), ("O", 1, 1, 7.0)]
    rows = [("sto", sites(STO), CUBE, -1.0, 2, [2], 221, "Pm-3m"), ("vac", sites(vacancy), double, -1.0, 2, [2], 221, "Pm-3m"), ("atom", sites([("Si", 0, 0, 0)]), wide, -1.0, 2, [1], 1, "P1"),
            ("eth", sites([(s, i, 0, 0) for i, s in enumerate("HOCHHCHHH")], 1.0), wide, -1.0, 2, None, 1, "P1"), ("slab", sites(slab, 1.0), [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 40.0]], -1.0, 2, [2], 99, "P4mm"),
            ("bad", sites(STO), CUBE, -1.0, 2, [9], 221, "Pm-3m"), ("none", [], CUBE, -1.0, 2, [2], 221, "Pm-3m"), ("open", sites(STO), CUBE, None, 1, None, None, None)]
    got = {r.checksum: r for r in C.classify(frame(spark, rows), skip_unfinished=True).collect()}
    sto = got["sto"]
    assert (sto.standard, sto.nelem, sto.natom, sto.periodicity, sto.tags, sto.spg, sto.symmetry, sto.pg, sto.calctypes, sto.expanded, sto.lack, sto.error) == (
        "SrTiO3", 3, 5, 3, [4], "221 &mdash; Pm-3m", "cubic", "O<sub>h</sub>", [1], 1, None, None)
    assert (got["vac"].standard, got["vac"].vac, got["vac"].tags, got["vac"].techs, got["vac"].lack) == ("SrTiO3-d", 12.5, [4, 2], ["vacancy defect: void space"], "O")
    assert (got["atom"].periodicity, got["atom"].standard) == (5, "Si") and (got["eth"].standard, got["eth"].tags, got["eth"].periodicity) == ("C2H6O", [1], 4)
    assert (got["slab"].periodicity, got["slab"].layers, got["slab"].termination, got["slab"].standard, got["slab"].symmetry, got["slab"].techs) == (2, 3, "TiO", "SrTiO slab", "2d-square", ["vacuum 40A"])
    assert got["bad"].error == "Unknown xc type" and got["none"].error.startswith("Valid") and got["open"].error.startswith("data") and got["open"].H_types == [0] and got["open"].etype == 0
    with_own = C.with_classifier(35, lambda d: d.withColumn("standard", F.lit("own")))
    assert {r.standard for r in C.classify(frame(spark, rows[:1]), classifiers=with_own).collect()} == {"own"}


def test_impurities_and_slabs():
    told = C.hosts_and_impurities(["Sr", "Ti", "Fe", "O"], [8, 7, 1, 24])
    assert told == {"elements": ["Sr", "Ti", "O"], "contents": [8, 8, 24], "impurities": ["Fe"], "lack": None, "failed": False}
    assert C.hosts_and_impurities(["Sr", "Ba", "Ti", "O"], [4, 4, 8, 24])["impurities"] == [] and C.hosts_and_impurities(["Sr", "Ti", "O"], [8, 8, 23])["lack"] == "O"
    heights = [0, 0, 2, 2, 4, 4, 6, 6, 8, 8, 10.0]
    told = C.slab(["Mg", "O", "H"], [5, 5, 1], ["Mg", "O"] * 5 + ["H"], heights)
    assert told == {"layers": 5, "adsorbent": "H", "termination": "MgO", "standard": "MgO slab"}
    assert C.slab(["Mg", "O"], [2, 2], ["Mg", "O"] * 2, [0, 0, 2, 2])["adsorbent"] is None


def test_tilting(spark):
    x, a, c = 0.255, 5.511, 7.796
    half = lambda rows: [*rows, *((s, u + 0.5, v + 0.5, w + 0.5) for s, u, v, w in rows)]
    rows = half([("Sr", 0, 0.5, 0.25), ("Sr", 0.5, 0, 0.25), ("Ti", 0, 0, 0), ("Ti", 0, 0, 0.5), ("O", 0, 0, 0.25), ("O", 0, 0, 0.75), ("O", x, x + 0.5, 0), ("O", -x, 0.5 - x, 0), ("O", 0.5 - x, x, 0), ("O", x + 0.5, -x, 0)])
    number = {"Sr": 38, "Ti": 22, "O": 8}
    atoms = spark.createDataFrame([(1, i + 1, number[s], u % 1 * a, v % 1 * a, w % 1 * c) for i, (s, u, v, w) in enumerate(rows)], "struct_id long, atom_idx int, number int, x double, y double, z double")
    cell = spark.createDataFrame([(1, a, 0.0, 0.0, 0.0, a, 0.0, 0.0, 0.0, c)], "struct_id long, " + ", ".join(f"a{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)))
    structures = spark.createDataFrame([(1, 3), (2, 3)], "struct_id long, periodicity int")
    corners = G.corners(atoms, cell, structures, [22], [8])
    got = T.tilting_angles(corners).collect()
    assert [(r.struct_id, r.alpha, r.beta, r.gamma) for r in got if r.error is None] == [(1, 0.0, 0.0, 1.15)] and [r.struct_id for r in got if r.error] == [2]


def test_turned_octahedron():
    """Corners turned by a small angle around z give that angle."""
    for degrees in (3.0, 10.0, 21.0):
        t = math.radians(degrees)
        turn = np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
        at = np.array([[2.0, 0, 0], [-2, 0, 0], [0, 2, 0], [0, -2, 0], [0, 0, 2.3], [0, 0, -2.3]]) @ turn.T
        assert np.allclose(T.euler_angles(at[None]), [[0, 0, degrees]], atol=0.02) and np.allclose(T.euler_angles(at[None, :5]), [[0, 0, degrees]], atol=0.02)


def test_any_rotation_is_found():
    """Octahedra, stretched and with noise, turned by Z, Y, Z: every angle comes back, folded; a least-squares fit of noise keeps it small."""
    g = np.random.default_rng(3)
    z = lambda t: np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    y = lambda t: np.array([[math.cos(t), 0, math.sin(t)], [0, 1, 0], [-math.sin(t), 0, math.cos(t)]])
    fold = lambda a: abs(a - 45 * round(a / 45))
    for _ in range(200):
        a, b, c = g.uniform(-180, 180), g.uniform(2, 20), g.uniform(-180, 180)
        shape = np.array([[2.0, 0, 0], [-2, 0, 0], [0, 2.1, 0], [0, -2.1, 0], [0, 0, 2.3], [0, 0, -2.3]]) + g.normal(0, 1e-4, (6, 3))
        at = g.permutation(shape) @ (z(math.radians(a)) @ y(math.radians(b)) @ z(math.radians(c))).T + g.normal(0, 5, 3)
        want = [fold(a), b, fold(c)]
        if max(want) < 22.3:
            assert np.allclose(T.euler_angles(at[None])[0], want, atol=0.1)


def test_cells_in_any_orientation(spark):
    g = np.random.default_rng(8)
    turn = np.linalg.qr(g.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    cell, own = np.diag([5.5, 5.5, 7.8]), g.normal(size=(4, 3))
    atoms = spark.createDataFrame([(1, i, 8, *map(float, x)) for i, x in enumerate(own @ turn.T)], "struct_id long, atom_idx int, number int, x double, y double, z double")
    lattice = spark.createDataFrame([(1, *map(float, (cell @ turn.T).ravel()))], "struct_id long, " + ", ".join(f"a{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)))
    placed, cells = T.upright(atoms, lattice)
    got = np.array([[r.x, r.y, r.z] for r in placed.orderBy("atom_idx").collect()])
    assert np.allclose(np.linalg.norm(got[:, None] - got, axis=2), np.linalg.norm(own[:, None] - own, axis=2)) and np.allclose(got[:, 2], own[:, 2])
    assert np.allclose([cells.first()[f"a3{j}"] for j in (1, 2, 3)], [0, 0, 7.8])


def test_each_face_of_a_slab_is_matched():
    """A foreign layer on one face goes; the other face is compared too, though the first one matched nothing."""
    layer = lambda z, *s: [(x, z + 0.01 * k) for k, x in enumerate(s)]
    atoms = [*layer(0, "Cu", "Cu"), *layer(2, "Au"), *layer(4, "Mg", "O"), *layer(6, "Mg", "O"), *layer(8, "Mg", "O")]
    told = C.slab(["Cu", "Au", "Mg", "O"], [2, 1, 3, 3], *map(list, zip(*atoms, strict=True)))
    assert told == {"layers": 3, "adsorbent": "Cu2Au", "termination": "MgO", "standard": "MgO slab"}


def test_spectra(spark):
    f = SP.NaturalSpline(np.arange(1.0, 6), np.array([0.0, 1, 0, 1, 0]))
    assert np.allclose(f([1.5, 4.5]), 0.76785714) and np.allclose(f([1.5, 4.5], 1), [1.17857143, -1.17857143]) and np.allclose(f([1.5, 4.5], 2), -2.14285714)
    assert np.allclose(f([0.0, 6.0]), [f([1.0], 1)[0] * -1, f([5.0], 1)[0]])
    bands = spark.createDataFrame([(1, [0.0, 1.0, 2.0], [[0.0, 1.0, 0.0]])], "run_id long, abscissa array<double>, stripes array<array<double>>")
    got = SP.spline_bands(bands).collect()
    assert len(got) == 31 and got[15].y == 1.0
    dos = lambda x, d: spark.range(1).select(SP.gap_of_dos(F.array(*map(F.lit, x)), F.array(*map(F.lit, d))).alias("x")).first().x
    assert dos([-2.0, -1.0, 0.5, 1.0], [1.0, 1.0, 0.0, 1.0]).gap == 2.0 and dos([-1.0, 0.5], [1.0, 1.0]).gap == 0.0 and dos([-1.0, 0.5], [1.0, 0.0]).error.startswith("no values")
    assert dos([-1.0, 0.5, 1.0], [1.0, 0.0, 1.0]).error.startswith("not enough")
    runs = spark.createDataFrame([(1, [0.0, 1.0], [[1.0, 0.0], [0.0, 1.0]], ["A", "B"])], "run_id long, eigenvalues array<double>, impacts array<array<double>>, kinds array<string>")
    part, whole = SP.partial_dos(runs).groupBy("i").agg(F.sum("dos").alias("d")), SP.smeared_dos(runs)
    assert part.join(whole, "i").where("energy >= 0 and abs(d - dos) > 0.0015").count() == 0 and SP.smeared_dos(runs, kernel="cauchy").count() == whole.count()


LOG = """     Program PWSCF v.5.0.1 starts on 1Jan2014

     celldm(1)=   7.000000  celldm(2)=   0.000000  celldm(3)=   0.000000
     crystal axes: (cart. coord. in units of alat)
               a(1) = (   1.000000   0.000000   0.000000 )
               a(2) = (   0.000000   1.000000   0.000000 )
               a(3) = (   0.000000   0.000000   1.000000 )

     site n.     atom                  positions (alat units)
         1           Sr  tau(   1) = (   0.0000000   0.0000000   0.0000000  )
         2           Ti1 tau(   2) = (   0.5000000   0.5000000   0.5000000  )

     Exchange-correlation      =  SLA  PW   PBX  PBC ( 1  4  3  4 0 0)
ATOMIC_POSITIONS (crystal)
Sr       0.000000000   0.000000000   0.000000000
Ti       0.500000000   0.500000000   0.250000000

     End of self-consistent calculation

          k = 0.0000 0.0000 0.0000 (  1000 PWs)   bands (ev):

    -1.0000   5.0000

          k =-0.5000-0.5000 0.0000 (  1000 PWs)   bands (ev):

    -0.5000   6.0000

     highest occupied, lowest unoccupied level (ev):     1.0000    5.0000

!    total energy              =     -10.00000000 Ry
     PWSCF        :   1m 1.00s CPU        2m WALL

     This run was terminated on:  10:00:00
"""


def test_log_line_by_line(spark, tmp_path):
    """Lines in any order of rows, a file in several blocks, a bad log, and a folder read by lines: the rows that whole texts give."""
    texts = {"a.out": LOG, "b.out": "nothing", "c.out": LOG.replace("7.000000", "x"), "d.out": LOG + LOG.replace("Sr  tau", "Ba  tau").replace("-1.0000   5.0000", "-3.0000   4.0000"), "e.out": LOG.split("0.5000000   0.5000000   0.5000000")[0], "f.out": ""}
    want = sorted(map(str, SF.parse_runs(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()))
    rows = [(p, 1000 * (i > 20), i, line or None) for p, t in texts.items() for i, line in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(sorted(rows, key=lambda r: hash(str(r))), "path string, start long, n long, line string")
    assert sorted(map(str, SF.parse_lines(lines).collect())) == want
    for p, t in texts.items():
        (tmp_path / p).write_text(t)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        read = SF.log_lines(spark, str(tmp_path))
        assert read.groupBy("path").agg(F.countDistinct("start").alias("n")).where("n > 1").count() > 0
        got = SF.parse_lines(read.withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(str, got)) == [x for x in want if "f.out" not in x]


def test_an_ordinary_log_needs_no_numpy(monkeypatch):
    """F1 (round 4): src6_parse_lines: calls of NumPy for single small matrices took longer than reading the lines."""
    want = SF.parse_log("a.out", LOG)
    g = np.random.default_rng(3)
    for cell in [*g.normal(size=(20, 3, 3)), [[4.0, 0, 0], [0, 4, 0], [0, 0, 1e-7]]]:
        cell, points = np.asarray(cell).tolist(), g.normal(size=(5, 3))
        at = points @ np.linalg.inv(cell).T
        assert np.allclose(SF._inverse(cell), np.linalg.inv(cell), rtol=1e-9)
        assert np.allclose(SF._walk(points.tolist(), cell), np.cumsum(np.linalg.norm(at + np.vstack([np.zeros(3), at[:-1]]), axis=1)), rtol=1e-9)
    for text, three in ((" (   1.0   -2.5   0.25 )", [1.0, -2.5, 0.25]), ("1.0-2.0 3", [1.0, -2.0, 3.0]), ("1.5e2 2 3.", [150.0, 2.0, 3.0]), (".5 1 2 3", [5.0, 1.0, 2.0]), ("( 1 2", [1.0, 2.0])):
        assert SF._three(text) == three
    flat = LOG.replace("0.0000000   1.000000   0.000000 )", "0").replace("0.000000   1.000000   0.000000", "2.000000   0.000000   0.000000")
    assert SF.parse_log("a.out", flat)["error"] == "LinAlgError: Singular matrix"
    monkeypatch.setattr(np.linalg, "inv", None)
    assert SF.parse_log("a.out", LOG) == want and want["error"] is None and want["bands"]["abscissa"][0] == 0


def test_log(spark):
    files = spark.createDataFrame([("a.out", LOG), ("b.out", "nothing"), ("c.out", LOG.replace("7.000000", "x"))], "path string, text string")
    got = {r.path: r for r in SF.parse_runs(files).collect()}
    run, alat = got["a.out"], 7 * SF.BOHR
    assert (run.version, run.H, run.xc_types, run.finished, run.natom, run.hours, run.k, run.error) == ("5.0.1", "PBE", [2], 2, 2, 0.03, "2 pts/BZ", None)
    assert abs(run.cell[0][0] - alat) < 1e-9 and abs(run.atoms[1].z - alat / 4) < 1e-9 and run.atoms[1].symbol == "Ti"
    assert run.bands.stripes == [[-2.0, -1.5], [4.0, 5.0]] and run.kpoints[1] == [-0.5, -0.5, 0.0] and abs(run.bands.abscissa[1] - math.sqrt(0.5) / alat) < 1e-9
    assert got["b.out"].error == "no version found" and got["c.out"].error is not None
    both = files.unionByName(spark.createDataFrame([("d.txt", "free text")], "path string, text string")).withColumn("text", F.regexp_replace("text", "Program PWSCF", "     Current dimensions of program PWSCF\n     Program PWSCF"))
    parsed = P.parse_files(both)
    assert {r.path: r.error for r in parsed.where("format is null").collect()} == {"b.out": "was read", "d.txt": "was read"} and P.parse_files(both, only=[]).count() == 4


def test_apps(spark):
    runs = frame(spark, [("a", sites(STO), CUBE, -1.0, 2, [2], 221, "Pm-3m"), ("b", sites([("Si", 0, 0, 0)]), CUBE, -1.0, 2, [1], 1, "P1")])
    apps = {"count": P.App({"sg": "Pm"}, lambda d: F.size("atoms")), "bulk": P.App({"xc_types": "!1"}, lambda d: F.lit(None), lambda d: F.lit("no data")), "all": P.App({}, lambda d: F.col("energy")), "absent": P.App({"nope": "x"}, lambda d: F.lit(1))}
    assert {tuple(r) for r in P.run_apps(runs, apps).collect()} == {("a", "count", "5", None), ("a", "bulk", None, "no data"), ("a", "all", "-1.0", None), ("b", "all", "-1.0", None)}
    assert {tuple(r)[:2] for r in P.run_apps(runs, apps, dry_run=True).collect()} == {("a", "count"), ("a", "bulk"), ("a", "all"), ("b", "all")}


def test_star_schema_round_trip(spark):
    rows = frame(spark, [("a", sites(STO), CUBE, -1.0, 2, [2], 221, "Pm-3m")])
    runs = C.classify(rows).withColumn("steps", F.array(F.struct("cell", "atoms"), F.struct("cell", "atoms")))
    t = ST.star_schema(runs)
    assert t["structures"].where("final").count() == 1 and t["atoms"].count() == 10 and t["lattices"].first().a == 3.9 and t["struct_ratios"].first().chemical_formula == "SrTiO3" and t["electrons"].count() == 0
    assert {(r.cid, r.topic) for r in t["raw_tags"].collect()} >= {(1, "SrTiO3"), (2, "Ti"), (8, "4"), (6, "1")}
    back = ST.nested(t["structures"], t["lattices"], t["atoms"]).first()
    assert [[(a.symbol, a.x) for a in s.atoms] for s in back.steps] == [[(s, x) for s, x, *_ in sites(STO)]] * 2


def test_dataset_refusals(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "parent_checksum string, children_checksum string")
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "checksum string, download_size long")
    got = {r.checksum: (r.download_size, r.siblings_count, r.refused) for r in MT.purge_dataset(sizes, edges, spark.createDataFrame([("c",)], "checksum string")).collect()}
    assert got == {"a": (0, 1, False), "b": (0, 0, True)}
    new = MT.merge(spark.createDataFrame([("T", "a"), ("T", "b")], "dataset string, checksum string"), spark.createDataFrame([("a", 2, "Sr"), ("b", 2, "Sr"), ("a", 1, "x")], "checksum string, cid int, topic string"), sizes.withColumn("nested_depth", F.lit(1)))
    run = new["runs"].first()
    assert (run.title, run.download_size, run.nested_depth, run.siblings_count) == ("T", 20, 2, 2) and new["calcsets"].count() == 2 and {(r.cid, r.topic) for r in new["raw_tags"].collect()} == {(2, "Sr"), (1, "T")}
