"""Run keys against a key put together by hand, and functionals that logs may print."""

import base64
import hashlib

from pyspark.sql import functions as F

from latticelake.functions.functionals import xc_lookup
from latticelake.functions.keys import run_keys


def test_run_key(spark):
    runs = spark.createDataFrame([("a", -12.5, "P", "in", [1, 3]), ("b", None, None, None, [1])], "checksum string, energy double, prog string, given string, codes array<int>")
    structures = spark.createDataFrame([(1, "a", 0)], "struct_id long, checksum string, step int")
    lattices = spark.createDataFrame([(1, 2.0, 0.0, 0.0, 0.0, 3.0, -0.0, 0.0, 0.0, 4.0)], "struct_id long, " + ", ".join(f"a{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)))
    atoms = spark.createDataFrame([(1, 2, 8, 0.5, -0.25, 1.0), (1, 1, 12, 0.0, 0.0, -0.0)], "struct_id long, atom_idx int, number int, x double, y double, z double")
    key = lambda s: base64.b32encode(hashlib.sha224(s.encode()).digest()).decode().split("=")[0] + "CI"
    shape = "2.000000 0.000000 0.000000 0.000000 3.000000 0.000000 0.000000 0.000000 4.000000 12 0.000000 0.000000 0.000000 8 0.500000 0.250000 1.000000 "
    got = {r.checksum: r.key for r in run_keys(runs, structures, lattices, atoms).collect()}
    assert got == {"a": key(shape + "\n-12.5\nP\nin\n10"), "b": key("\nNone\n\nNone\n2")}
    assert len(got["a"]) == 47


def test_functionals(spark):
    texts = ["PBE0", "B3LP VWN B3LP B3LP (1)", "sla+pw+rw86+pbc+vv10", "Mine", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", xc_lookup(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x and (r.x.name, r.x.types) for r in rows] == [("PBE0", [2, 4]), ("B3LYP", [2, 4]), ("rVV10", [2, 7]), ("mine", []), ("", []), None]


def test_key_of_a_site_without_an_element(spark):
    """structures come as flat numbers; a site without an element is written None, as before."""
    from latticelake.functions.keys import shape_of

    cell = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1e7]
    assert shape_of([*cell, None, 1.0, -2.0, 0.0000005, 8.0, 0.5, 0.25, -1.0], 2) == "".join(f"{abs(x):3.6f} " for x in cell) + "None 1.000000 2.000000 " + f"{0.0000005:3.6f} " + "8 0.500000 0.250000 1.000000 "
    assert shape_of([*cell, 8.0, 0.5, 0.25, -1.0], 1).endswith(" 8 0.500000 0.250000 1.000000 ")
