"""Nested run rows as the tables of a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..reference_data import FACETS, SYMBOLS
from .facets import make_tags
from .geometry import cell_parameters


def struct_id(checksum: Column, step: Column) -> Column:
    """Key of a structure: the same run and step have the same key everywhere."""
    return F.md5(F.concat_ws(":", checksum, step.cast("string")))


def star_schema(runs: DataFrame) -> dict[str, DataFrame]:
    """The property tables of run rows with the columns that classify() gives, and steps, an array of structures (cell, atoms).

    Runs without steps have no structures. Tables whose columns the rows lack are left out.
    """
    has = set(runs.columns)
    steps = runs.select("checksum", F.posexplode("steps").alias("step", "s"), F.size("steps").alias("n")).withColumn("struct_id", struct_id(F.col("checksum"), F.col("step")))
    out = {"structures": steps.select("struct_id", "checksum", "step", (F.col("step") == F.col("n") - 1).alias("final"))}
    cells = steps.select("struct_id", *(F.col("s.cell")[i][j].alias(f"a{i + 1}{j + 1}") for i in range(3) for j in range(3)))
    out["lattices"] = cell_parameters(cells, *(c for c in cells.columns if c != "struct_id")).drop("volume")
    number = F.create_map(*(F.lit(x) for i, s in enumerate(["X", *SYMBOLS]) for x in (s, i)))
    atoms = steps.select("struct_id", F.posexplode("s.atoms").alias("atom_idx", "a"))
    out["atoms"] = atoms.select("struct_id", (F.col("atom_idx") + 1).alias("atom_idx"), F.try_element_at(number, F.col("a.symbol")).alias("number"), "a.x", "a.y", "a.z", "a.charge", "a.magmom")

    direct = F.when(F.col("bandgaptype") == 2, 1).when(F.col("bandgaptype") == 3, -1)
    columns = {
        "energies": {"energy": "total", "convergence": "convergence"}, "electrons": {"bandgap": "gap"}, "spacegroups": {"ng": "n"}, "basissets": {"ansatz": "kind", "bs": "content"}, "recipintegs": {"k": "kgrid"},
        "struct_ratios": {"standard": "chemical_formula", "expanded": "formula_units", "nelem": "nelem", "dims": "dimensions"}, "struct_optimisation": {"tresholds": "tresholds", "ncycles": "ncycles"},
        "metadata": {"location": "location", "finished": "finished", "input": "raw_input", "duration": "modeling_time", "standard": "chemical_formula", "download_size": "download_size", "filenames": "filenames", "prog": "codeversion", "framework": "codefamily", "H": "pottype"},
    }
    for name, own in columns.items():
        found = [F.col(c).alias(to) for c, to in own.items() if c in has]
        if found:
            out[name] = runs.select("checksum", *found)
    if "electrons" in out:
        electronic = runs.where(F.col("bands").isNotNull() | F.col("dos").isNotNull())
        out["electrons"] = electronic.select("checksum", F.col("bandgap").alias("gap"), direct.alias("is_direct"))
        out["spectra"] = electronic.select("checksum", F.lit("ELECTRON").alias("kind"), F.to_json("dos").alias("dos"), F.to_json("bands").alias("bands"), F.lit(None).cast("string").alias("eigenvalues"))
        if "modes" in has:
            none = F.lit(None).cast("string")
            out["spectra"] = out["spectra"].unionByName(runs.where("modes is not null").select("checksum", F.lit("PHONON").alias("kind"), none.alias("dos"), none.alias("bands"), F.to_json("modes").alias("eigenvalues")))
    if "struct_optimisation" in out:
        out["struct_optimisation"] = out["struct_optimisation"].where("tresholds is not null")
    info = [c for c in (f[2] for f in FACETS) if c in has]
    out["grid"] = runs.select("checksum", F.to_json(F.struct(*info)).alias("info"))
    out["raw_tags"] = make_tags(runs, FACETS)
    return out


def structures_of(structures: DataFrame, lattices: DataFrame, atoms: DataFrame) -> DataFrame:
    """(checksum, step, s): a row for each of structures that has a cell and atoms, as a struct of cell and atoms."""
    symbol = F.element_at(F.array(*(F.lit(s) for s in ["X", *SYMBOLS])), F.col("number") + 1)
    site = F.struct(symbol.alias("symbol"), "x", "y", "z", F.col("charge").cast("double").alias("charge"), F.lit(None).cast("double").alias("magmom"))
    sites = atoms.groupBy("struct_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("atom_idx", site.alias("a")))), lambda x: x["a"]).alias("atoms"))
    cell = F.array(*(F.array(*(f"a{i}{j}" for j in (1, 2, 3))) for i in (1, 2, 3)))
    return structures.join(lattices, "struct_id").join(sites, "struct_id").select("checksum", "step", F.struct(cell.alias("cell"), "atoms").alias("s"))


def nested(structures: DataFrame, lattices: DataFrame, atoms: DataFrame) -> DataFrame:
    """(checksum, steps): the structures of each run in order, as star_schema() takes them."""
    whole = structures_of(structures, lattices, atoms)
    return whole.groupBy("checksum").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "s"))), lambda x: x["s"]).alias("steps"))
