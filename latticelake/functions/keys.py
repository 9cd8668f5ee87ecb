"""Content keys of runs."""

from __future__ import annotations

import base64
import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_of(numbers: list[float | None], sites: int) -> str:
    """A structure, given as the nine numbers of its cell and four of each site (element, x, y, z), as text.

    Numbers lose their sign, so that minus zeros don't matter.
    """
    atoms = numbers[9:]
    if None in atoms[::4]:  # a site without an element
        return "%3.6f " * 9 % tuple(map(abs, numbers[:9])) + "".join(f"{n if n is None else int(n)} %3.6f %3.6f %3.6f " % (abs(x), abs(y), abs(z)) for n, x, y, z in zip(*(atoms[k::4] for k in range(4)), strict=True))
    signed = tuple(map(abs, numbers))
    return ("%3.6f " * 9 + "%d %3.6f %3.6f %3.6f " * sites) % signed


def key_of(shape: str, energy: float | None, prog: str, given: str | None, signature: int) -> str:
    """47 characters from the text of all structures, the energy, the program, its input and the kinds of calculation; an energy of 0 counts as it is."""
    if energy is not None and not math.isnan(energy):
        energy = round(energy, 11 - int(math.log10(abs(energy)))) if energy else energy
    else:
        energy = None
    text = "\n".join((shape, str(energy), prog, str(given), str(signature)))
    return base64.b32encode(hashlib.sha224(text.encode("ascii", "replace")).digest()).decode().rstrip("=") + "CI"


def run_keys(runs: DataFrame, structures: DataFrame, lattices: DataFrame, atoms: DataFrame) -> DataFrame:
    """(checksum, key) of runs (checksum, energy, prog, given, codes); structures follow by step, atoms by index.

    Runs without structures have a key of the rest; codes are those of the kinds of calculation.
    """
    site = lambda a: F.array(a["number"].cast("double"), a["x"].cast("double"), a["y"].cast("double"), a["z"].cast("double"))
    sites = atoms.groupBy("struct_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("atom_idx", "number", "x", "y", "z"))), site)).alias("sites"))
    cell = F.array(*(F.col(f"a{i}{j}").cast("double") for i in (1, 2, 3) for j in (1, 2, 3))).alias("cell")
    whole = structures.join(lattices.select("struct_id", cell), "struct_id").join(sites, "struct_id", "left")
    # flat numbers, as sites as rows are several times as large in the shuffle and in Python
    told = F.struct("step", F.concat("cell", F.coalesce("sites", F.expr("cast(array() as array<double>)"))).alias("numbers"))
    whole = whole.groupBy("checksum").agg(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["numbers"]).alias("s"))

    def run(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            keys = [(checksum, key_of("".join(shape_of(x, (len(x) - 9) // 4) for x in s or ()), e, p, g, n)) for checksum, e, p, g, n, s in rows]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)], names=["checksum", "key"])

    signature = F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + F.pow(F.lit(2), c).cast("long")).alias("signature")
    rows = runs.select(F.col("checksum").cast("string").alias("checksum"), F.col("energy").cast("double").alias("energy"), F.coalesce("prog", F.lit("")).alias("prog"), "given", signature)
    return rows.join(whole, "checksum", "left").select("checksum", "energy", "prog", "given", "signature", "s").mapInArrow(run, "checksum string, key string")
