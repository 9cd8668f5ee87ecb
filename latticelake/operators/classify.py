"""Classification of runs: one row per run with its atoms nested, so no step shuffles anything.

A classifier is a function from a DataFrame to a DataFrame; classify() applies them in order and
then derives codes and labels. A run that can't be classified keeps its row, with an error.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..reference_data import FACETS, RADII, SITE_A, SITE_B, SITE_C, SYMBOLS
from . import geometry as G
from . import spectra as SP

#: What classify() reads of a run; columns that aren't there count as null.
RUN = (
    "checksum string, atoms array<struct<symbol:string,x:double,y:double,z:double,charge:double,magmom:double>>, cell array<array<double>>, pbc array<boolean>, finished int, energy double,"
    " xc_types array<int>, ansatz int, framework int, basis array<struct<element:string,label:string>>, n_steps int, spin boolean, modes map<string,array<double>>, degeneracy map<string,int>, dielectric boolean,"
    " elastic boolean, dfp_magnitude double, dfp_disps int, bands struct<abscissa:array<double>,stripes:array<array<double>>>, dos struct<x:array<double>,total:array<double>>, ng int, sg string, location string")
#: A single atom is alone if its cell holds so many volumes a radius; vacuum an atom above which a cell is no bulk; a slab's cell is so much longer than wide.
ALONE, VACUUM, LONG = 100.0, 12.0, 3.9
#: Share at most of an impurity; share below which a C site lacks atoms.
IMPURITY, LACK = 1 / 16, 0.6

Classifier = Callable[[DataFrame], DataFrame]


def _texts(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _add_tag(runs: DataFrame, when: Column, tag: int) -> DataFrame:
    return runs.withColumn("tags", F.when(F.coalesce(when, F.lit(False)), F.array_append("tags", F.lit(tag))).otherwise(F.col("tags")))


def prepared(runs: DataFrame) -> DataFrame:
    """runs with all columns of RUN, the formula's elements and contents, the cell's lengths and angles, and empty results."""
    has = set(runs.columns)
    runs = runs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in T.StructType.fromDDL(RUN) if f.name not in has})
    symbols = F.transform("atoms", lambda a: a["symbol"])
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    c = F.col("cell")
    angle = lambda i, j: F.degrees(F.acos(F.try_divide(dot(c[i], c[j]), norm(c[i]) * norm(c[j]))))
    det = lambda m: (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))
    runs = runs.withColumn("formula", S.standard_formula(symbols))
    pairs = S.parse_formula(F.col("formula"))
    return runs.select(
        "*", F.transform(pairs, lambda p: p["element"]).alias("elements"), F.transform(pairs, lambda p: p["count"]).alias("contents"), F.size("atoms").alias("natom"), F.array(norm(c[0]), norm(c[1]), norm(c[2])).alias("lengths"),
        F.array(angle(1, 2), angle(0, 2), angle(0, 1)).alias("angles"), F.abs(det(c)).alias("dims"), _empty("int").alias("tags"), _empty("string").alias("techs"), _empty("string").alias("warns"), _empty("string").alias("impurities"),
        _empty("string").alias("bs"), F.lit(None).cast("string").alias("lack"), F.lit(None).cast("int").alias("expanded"), F.lit(None).cast("string").alias("standard"), F.lit(None).cast("double").alias("vac"),
        F.lit(None).cast("int").alias("layers"), F.lit(None).cast("string").alias("adsorbent"), F.lit(None).cast("string").alias("termination"), F.lit(None).cast("string").alias("error"))


def dimensions(runs: DataFrame) -> DataFrame:
    """periodicity: with much vacuum an atom, a 3-periodic run is a slab in a long cell, or a molecule."""
    radius = S.fixed_map(zip(SYMBOLS, RADII, strict=True))
    filled = F.aggregate("atoms", F.lit(0.0), lambda s, a: s + 4 / 3 * math.pi * F.pow(F.coalesce(F.try_element_at(radius, a["symbol"]), F.lit(0.2)), 3))
    vacuum = F.try_divide(F.col("dims") - filled, F.col("natom"))
    longest, shortest = (F.array_position("lengths", f("lengths")) for f in (F.array_max, F.array_min))
    middle = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: (i != longest) & (i != shortest))[0]
    slab = (vacuum > VACUUM) & (F.element_at("lengths", middle) * LONG < F.array_max("lengths"))
    periods = F.size(F.filter(F.coalesce("pbc", F.array(*[F.lit(True)] * 3)), lambda x: x))
    runs = runs.withColumn("is_slab", (periods == 3) & slab).withColumn("periodicity", F.when(F.col("is_slab"), 2).when((periods == 3) & (vacuum > 4 * VACUUM), 0).otherwise(periods))
    note = F.concat(F.lit("vacuum "), F.bround(F.array_max("lengths")).cast("int").cast("string"), F.lit("A"))
    return runs.withColumn("techs", F.when(F.col("is_slab"), F.array_append("techs", note)).otherwise(F.col("techs"))).drop("is_slab")


def xc_types(runs: DataFrame) -> DataFrame:
    """An unknown type of functional is an error."""
    return runs.withColumn("error", F.when(F.col("error").isNull() & ~S.xc_is_valid(F.col("xc_types")), F.lit("Unknown xc type")).otherwise(F.col("error")))


def basis_sets(runs: DataFrame) -> DataFrame:
    """bs: distinct element:label pairs as first seen; ghosts and numbered elements are left out."""
    named = F.filter("basis", lambda b: (b["element"] != "X") & ~b["element"].rlike("[0-9]"))
    return runs.withColumn("bs", F.when(F.coalesce(F.col("ansatz"), F.lit(0)) != 1, F.coalesce(F.array_distinct(F.transform(named, lambda b: F.concat_ws(":", b["element"], b["label"]))), F.col("bs"))).otherwise(F.col("bs")))


def hosts_and_impurities(elements: list[str], contents: list[int]) -> dict:
    """What a perovskite's composition says: impurities joined to the host of their site, and the C-site element that lacks atoms.

    With several hosts of a site nothing changes; an impurity without a host is an error.
    """
    total, n = sum(contents), len(elements)
    order = sorted(range(n), key=lambda k: contents[k])
    minor = {k for k, after in zip(order, order[1:], strict=False) if contents[k] <= IMPURITY * total and 2 * contents[k] <= contents[after]}
    major = [k for k in order[:-1] if k not in minor]
    site_a = [k for k in major if elements[k] in SITE_A]
    site_b = [k for k in major if elements[k] in SITE_B and elements[k] not in SITE_A]
    same = {"elements": elements, "contents": contents, "impurities": [], "lack": None, "failed": False}
    if len(site_a) > 1 or len(site_b) > 1:
        return same
    counts = list(contents)
    for k in order:
        if k in minor:
            host = site_a if elements[k] in SITE_A else site_b if elements[k] in SITE_B else None
            if host == []:
                return same | {"failed": True}
            if host:
                counts[host[0]] += contents[k]
    left = [k for k in range(n) if k not in minor]
    lack, all_left = None, sum(counts[k] for k in left)
    for k in (k for k in range(n) if elements[k] in SITE_C):
        if k in minor:
            return same | {"failed": True}
        if counts[k] / all_left < LACK:
            lack = elements[k]
            break
    return {"elements": [elements[k] for k in left], "contents": [counts[k] for k in left], "lack": lack, "failed": False,
            "impurities": [elements[k] + (str(contents[k]) if contents[k] > 1 else "") for k in order if k in minor]}


def perovskites(runs: DataFrame) -> DataFrame:
    """Tag 4; three-periodic ones give up their impurities."""
    pairs = F.arrays_zip(F.col("elements").alias("element"), F.col("contents").alias("count"))
    runs = _add_tag(runs.withColumn("perovskite", G.is_perovskite(pairs, dict(zip(SYMBOLS, RADII, strict=True)))), F.col("perovskite"), 4)
    bronze = (F.size("elements") == 2) & F.col("elements")[0].isin("W", "Re")

    @F.pandas_udf("elements array<string>, contents array<int>, impurities array<string>, lack string, failed boolean")
    def told(elements: pd.Series, contents: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("elements", "contents", "impurities", "lack", "failed"))
        return pd.DataFrame([none if e is None else hosts_and_impurities(list(e), [int(x) for x in c]) for e, c in zip(elements, contents, strict=True)], columns=list(none), dtype=object)

    bulk = F.col("perovskite") & ~bronze & (F.col("periodicity") == 3)
    # nondeterministic only to keep the optimizer from moving it into other expressions
    runs = runs.withColumn("told", told.asNondeterministic()(F.when(bulk, F.col("elements")), F.when(bulk, F.col("contents"))))
    for c in ("elements", "contents", "impurities", "lack"):
        runs = runs.withColumn(c, F.coalesce(F.col(f"told.{c}"), F.col(c)))
    return runs.withColumn("error", F.coalesce("error", F.when(F.col("told.failed"), F.lit("Fatal error during classification: an impurity has no host")))).drop("told", "perovskite")


def defects(runs: DataFrame) -> DataFrame:
    """Tag 2, standard and vac, where one or two atoms more of an element make the formula divisible."""
    pairs = F.arrays_zip(F.col("elements").alias("element"), F.col("contents").alias("count"))
    fit = (F.size("elements") > 1) & ~F.col("periodicity").isin(0, 1, 2)
    plain = S.counts_gcd(F.col("contents"))
    runs = runs.withColumn("expanded", F.when(fit, plain).otherwise(F.col("expanded")))
    large = fit & (F.aggregate("contents", F.lit(0), lambda a, x: a + x) / F.col("expanded") >= 15)
    runs = runs.withColumn("best", F.when(large, G.vacancy_defect(pairs, F.col("lack"))))
    share = F.col("best.added") * 100.0 / F.col("best.gcd")
    found = F.col("best").isNotNull() & (share <= 25)
    more = F.transform(pairs, lambda p: F.struct(p["element"].alias("element"), ((p["count"] + F.when(p["element"] == F.col("best.element"), F.col("best.added")).otherwise(F.lit(0))) / F.col("best.gcd")).cast("int").alias("count")))
    part = lambda p: F.concat(p["element"], F.when(p["count"] > 1, p["count"].cast("string")).when(p["element"] == F.col("best.element"), F.lit("1")).otherwise(F.lit("")), F.when(p["element"] == F.col("best.element"), F.lit("-d")).otherwise(F.lit("")))
    runs = runs.withColumn("standard", F.when(found, F.array_join(F.transform(more, part), "")).otherwise(F.col("standard"))).withColumn("vac", F.when(found, F.round(share, 2)))
    runs = runs.withColumn("contents", F.when(found, F.transform(more, lambda p: (p["count"] * F.col("best.gcd")).cast("int"))).otherwise(F.col("contents"))).withColumn("expanded", F.when(found, F.col("best.gcd")).otherwise(F.col("expanded")))
    return _add_tag(runs, F.col("vac").isNotNull(), 2).drop("best")


def isolated_and_organic(runs: DataFrame) -> DataFrame:
    """periodicity -1 of a single atom in much space; tag 1 of molecules with carbon and hydrogen, whose formulas aren't divided."""
    radius = S.fixed_map(zip(SYMBOLS, RADII, strict=True))
    pairs = F.arrays_zip(F.col("elements").alias("element"), F.col("contents").alias("count"))
    alone = G.is_isolated(pairs, F.col("periodicity"), F.col("dims"), F.try_element_at(radius, F.get("elements", F.lit(0))), ALONE)
    runs = runs.withColumn("periodicity", F.when(alone, -1).otherwise(F.col("periodicity"))).withColumn("organic", G.is_organic(pairs, F.col("periodicity")))
    return _add_tag(runs.withColumn("expanded", F.when(F.col("organic"), 1).otherwise(F.col("expanded"))), F.col("organic"), 1).drop("organic")


def _counted(counts: dict[str, int], elements: list[str]) -> tuple[str, int]:
    """A formula divided by the greatest common divisor, in the run's order of elements, and the divisor."""
    g = reduce(math.gcd, counts.values())
    names = [e for e in elements if e in counts] + [e for e in counts if e not in elements]
    return "".join(e + (str(counts[e] // g) if counts[e] // g > 1 else "") for e in names), g


def slab(elements: list[str], contents: list[int], symbols: list[str], heights: list[float], gap: float = 0.7) -> dict:
    """layers, adsorbent, termination and standard of a slab.

    Elements rare in the whole run are adsorbed wherever they stand in an outer layer. What is left
    of a layer is matched with the layers that lie further in: seen from either face, all layers
    before the first match are adsorbed. Each face is matched for itself. Nothing is adsorbed in
    slabs of three layers and less, or if everything were.
    """
    layers: list[Counter] = []
    before = None
    for z, s in sorted((z, s) for z, s in zip(heights, symbols, strict=True) if s != "X"):
        if before is None or z - before > gap:
            layers.append(Counter())
        layers[-1][s] += 1
        before = z
    n, total = len(layers), sum(contents)
    share = {e: c / total for e, c in zip(elements, contents, strict=True)}
    cores = [Counter({s: k for s, k in x.items() if share.get(s, 0) > (0.15 if s == "H" else 0.1)}) for x in layers]
    # depth: layers between a layer and its face, the same from both sides
    matched = {i for i in range(n) for j in range(n) if min(i, n - 1 - i) < min(j, n - 1 - j) and cores[i] and _alike(cores[i], layers[j])}
    gone, left = Counter(), list(layers)
    if n > 3:
        for face in (range(n // 2), range(n - 1, n // 2 - 1, -1)):
            first = next((k for k, i in enumerate(face) if i in matched), len(face) - 1)
            for i in face[:first + 1]:
                left[i] = cores[i] if i in matched else Counter()
                gone += layers[i] - left[i]
        if not (gone and sorted(gone) == sorted(elements) and sorted(gone.values()) == sorted(contents)):
            layers = [x for x in left if x]
        else:
            gone = Counter()
    out = {"layers": len(layers), "adsorbent": None, "termination": None, "standard": None}
    if gone:
        text, g = _counted(gone, elements)
        out["adsorbent"] = (str(g) if g > 1 else "") + text
    if len(layers) > 1 and layers[0] == layers[-1]:
        out["termination"] = _counted(layers[0], elements)[0]
    names = list(dict.fromkeys(s for x in layers for s in x))
    out["standard"] = "".join([e for e in elements if e in names] + [s for s in names if s not in elements]) + " slab"
    return out


def _alike(a: dict, b: dict) -> bool:
    """Equal layers, or layers of the same elements whose mean counts are at most 1.5 apart (any, if it is one element)."""
    return dict(a) == dict(b) or (set(a) == set(b) and (len(a) == 1 or abs(sum(a.values()) - sum(b.values())) / len(a) <= 1.5))


def surfaces(runs: DataFrame) -> DataFrame:
    """layers, adsorbent, termination and tag 3 of 2-periodic runs, along their longest cell vector."""

    @F.pandas_udf("layers int, adsorbent string, termination string, standard string")
    def told(elements: pd.Series, contents: pd.Series, symbols: pd.Series, heights: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("layers", "adsorbent", "termination", "standard"))
        rows = zip(elements, contents, symbols, heights, strict=True)
        return pd.DataFrame([none if s is None else slab(list(e), [int(x) for x in c], list(s), list(z)) for e, c, s, z in rows], columns=list(none), dtype=object).astype({"layers": "Int32"})

    flat = F.col("periodicity") == 2
    # the last one of equally long vectors
    axis = F.array_max(F.transform("lengths", lambda x, i: F.struct(x.alias("length"), i.alias("axis"))))["axis"]
    height = F.transform("atoms", lambda a: F.when(axis == 0, a["x"]).when(axis == 1, a["y"]).otherwise(a["z"]))
    # nondeterministic only to keep the optimizer from moving it into other expressions
    runs = runs.withColumn("told", told.asNondeterministic()(F.when(flat, F.col("elements")), F.when(flat, F.col("contents")), F.when(flat, F.transform("atoms", lambda a: a["symbol"])), F.when(flat, height)))
    for c in ("layers", "adsorbent", "termination"):
        runs = runs.withColumn(c, F.when(flat, F.col(f"told.{c}")))
    runs = runs.withColumn("standard", F.when(flat, F.col("told.standard")).otherwise(F.col("standard"))).withColumn("expanded", F.when(flat, 1).otherwise(F.col("expanded")))
    return _add_tag(runs.drop("told"), F.col("adsorbent").isNotNull(), 3)


#: The classifiers by their place in the order.
CLASSIFIERS: list[tuple[int, Classifier]] = [(1, dimensions), (4, xc_types), (5, basis_sets), (10, perovskites), (20, defects), (30, isolated_and_organic), (40, surfaces)]


def with_classifier(place: int, classifier: Classifier, known: list[tuple[int, Classifier]] = CLASSIFIERS) -> list[tuple[int, Classifier]]:
    """The classifiers with one more, after those of the same place."""
    return sorted([*known, (place, classifier)], key=lambda x: x[0])


def ratios(runs: DataFrame) -> DataFrame:
    """standard where no classifier gave one: the formula over its greatest common divisor, or over what a classifier demands."""
    by = F.when(F.size("elements") == 1, 1).otherwise(F.coalesce("expanded", S.counts_gcd(F.col("contents"))))
    runs = runs.withColumn("expanded", F.when(F.col("standard").isNull(), by).otherwise(F.col("expanded")))
    pairs = F.arrays_zip(F.transform("contents", lambda c: F.floor(c / F.col("expanded")).cast("int")).alias("count"), F.col("elements").alias("element"))
    return runs.withColumn("standard", F.coalesce("standard", S.formula_text(pairs))).withColumn("nelem", F.least(F.size("elements"), F.lit(13)))


def codes(runs: DataFrame) -> DataFrame:
    """calctypes, optgeom, spin, techs of a vacancy, cell parameters, labels of symmetry and phonons."""
    some = lambda field: F.exists("atoms", lambda a: F.coalesce(a[field], F.lit(0.0)) != 0)
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    optimised = F.coalesce(F.col("n_steps") > 1, F.lit(False))
    flags = {4: some("charge"), 5: some("magmom"), 6: filled("modes"), 7: filled("degeneracy"), 8: F.coalesce("dielectric", F.lit(False)), 9: F.coalesce("elastic", F.lit(False)), 3: optimised,
             2: F.col("dos").isNotNull() | F.col("bands").isNotNull(), 1: F.coalesce(F.col("energy") != 0, F.lit(False))}
    oblique = F.exists("angles", lambda a: F.abs(a - 90) > 0.005)
    group = S.layer_group(F.col("ng"), oblique)
    flat = F.col("periodicity") == 2
    ghost = F.when(F.exists("atoms", lambda a: a["symbol"] == "X"), F.lit("vacancy defect: ghost")).otherwise(F.lit("vacancy defect: void space"))
    runs = runs.withColumn("techs", F.when(F.col("vac").isNotNull(), F.array_append("techs", ghost)).otherwise(F.col("techs")))
    runs = runs.withColumn("dg", F.when(flat, group)).withColumn("symmetry", F.when(flat, S.layer_system(group)).otherwise(S.crystal_system(F.col("ng"))))
    runs = runs.withColumn("warns", F.when(flat & F.col("ng").isNotNull() & group.isNull(), F.array_append("warns", F.lit("No layer group belongs to the space group!"))).otherwise(F.col("warns")))
    phonons = phonon_summary(F.col("modes"), F.col("degeneracy"), F.col("dfp_magnitude"), F.col("dfp_disps"))
    return runs.select(
        *(c for c in runs.columns if c not in ("spin", "periodicity", "dfp_magnitude", "dfp_disps")), S.calctypes(flags).alias("calctypes"), optimised.alias("optgeom"), S.spin_code(F.coalesce("spin", F.lit(False))).alias("spin"),
        S.periodicity_code(F.col("periodicity")).alias("periodicity"), *(F.round(F.col("lengths")[i], 3).alias(f"lat{x}") for i, x in enumerate("abc")), *(F.round(F.col("angles")[i], 2).alias(f"lat{x}") for i, x in enumerate(("alpha", "beta", "gamma"))),
        S.space_group_label(F.col("ng"), F.col("sg")).alias("spg"), S.point_group(F.col("ng")).alias("pg"), phonons["dfp_magnitude"].alias("dfp_magnitude"), phonons["dfp_disps"].alias("dfp_disps"), phonons["n_ph_k"].alias("n_ph_k"))


def phonon_summary(modes: Column, degeneracy: Column, magnitude: Column, displacements: Column) -> Column:
    """(dfp_magnitude, dfp_disps, n_ph_k): displacement to three decimals, number of displacements, and of k-points (1 if only modes are known)."""
    n = F.when(F.size(modes) > 0, F.when(F.size(degeneracy) > 0, F.size(degeneracy)).otherwise(F.lit(1)))
    return F.struct(F.when(magnitude != 0, F.round(magnitude, 3)).alias("dfp_magnitude"), F.when(displacements != 0, displacements).alias("dfp_disps"), n.alias("n_ph_k"))


def electronic(runs: DataFrame) -> DataFrame:
    """etype, bandgap and bandgaptype by bands first, then by the density of states."""
    bands, dos = SP.gap_of_bands(F.col("bands.stripes"), F.col("bands.abscissa")), SP.gap_of_dos(F.col("dos.x"), F.col("dos.total"))
    runs = runs.withColumn("conducts", SP.is_conductor(F.col("bands.stripes"))).withColumn("by_bands", F.when(F.col("bands").isNotNull(), bands)).withColumn("by_dos", F.when(F.col("dos").isNotNull(), dos))
    runs = runs.withColumn("told", SP.electronic_type(F.col("conducts"), F.col("by_bands.gap"), F.col("by_bands.direct"), F.col("by_dos.gap")))
    apart = F.abs(F.col("told.gap") - F.col("by_dos.gap")) > 0.2
    note = lambda when, text: F.array_compact(F.array(F.when(when, text)))
    warns = F.concat("warns", note(~F.coalesce("conducts", F.lit(False)), F.col("by_bands.error")), note(F.lit(True), F.col("by_dos.error")), note(F.col("bands").isNotNull() & apart, F.lit("Gaps of DOS and bands differ considerably, that of the bands counts.")))
    return runs.withColumn("warns", warns).select(*(c for c in runs.columns if c not in ("conducts", "by_bands", "by_dos", "told", "warns")), "warns", "told.etype", F.col("told.gap").alias("bandgap"), "told.bandgaptype")


def with_defaults(runs: DataFrame) -> DataFrame:
    """Facets that every run has: empty ones are 0 where they are enumerated, else none."""
    from ..reference_data import ENUMS
    from .runs import fill_defaults

    kinds = dict(runs.dtypes)
    wanted = {}
    for cid, _, source, _, multiple, optional, _, _, _, topic in FACETS:
        if topic and not optional and source in kinds:
            value = 0 if cid in ENUMS else "none"
            wanted[source] = [value] if multiple else value
    return fill_defaults(runs, wanted)


def classify(runs: DataFrame, skip_unfinished: bool = False, skip_no_energy: bool = False, classifiers: list[tuple[int, Classifier]] = CLASSIFIERS) -> DataFrame:
    """runs (see RUN) with all that classification tells; runs outside the active filter, and failed ones, have an error."""
    runs = prepared(runs)
    outside = (F.lit(skip_unfinished) & F.coalesce(F.col("finished") == 1, F.lit(False))) | (F.lit(skip_no_energy) & F.coalesce(F.col("energy") == 0, F.lit(True)))
    runs = runs.withColumn("error", F.when(outside, F.lit("data do not satisfy the active filter")).when(F.coalesce(F.size("atoms"), F.lit(0)) <= 0, F.lit("Valid structure is not present!")))
    for _, step in sorted(classifiers, key=lambda x: x[0]):
        runs = step(runs)
    runs = electronic(codes(ratios(runs))).withColumnRenamed("xc_types", "H_types")
    return with_defaults(runs)
