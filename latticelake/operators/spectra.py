"""Bands and densities of states, on nested arrays of one row per run."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smeared_dos(runs: DataFrame, sigma: float = 0.2, pitch: float | None = None, kernel: str = "normal") -> DataFrame:
    """(run_id, i, energy, dos): sums of kernels from ten sigma below the eigenvalues to ten above, in steps of pitch (None: 200 steps between the eigenvalues).

    kernel is normal or cauchy. A run without eigenvalues has no rows.
    """

    def run(batches):
        for b in batches:
            for run_id, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = _grid(np.array(values), sigma, pitch)
                for k in range(0, len(at), 4096):
                    part = at[k:k + 4096]
                    dos = _kernels(np.array(values)[None, :] - part[:, None], sigma, kernel).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([run_id] * len(part), pa.int64()), pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array(part), pa.array(dos)], names=["run_id", "i", "energy", "dos"])

    rows = runs.where(F.size("eigenvalues") > 0).select(F.col("run_id").cast("long").alias("run_id"), F.col("eigenvalues").cast("array<double>").alias("eigenvalues"))
    return rows.mapInArrow(run, "run_id long, i int, energy double, dos double").select("run_id", "i", (F.round("energy", 3) + 0.0).alias("energy"), F.round("dos", 3).alias("dos"))


def _grid(values: np.ndarray, sigma: float, pitch: float | None) -> np.ndarray:
    low, high = values.min(), values.max()
    step = pitch if pitch is not None else (high - low) / 200
    step = step if step > 0 else 1.0
    return (low - 10 * sigma) + np.arange(int(np.floor((high - low + 20 * sigma) / step)) + 1) * step


def _kernels(x: np.ndarray, sigma: float, kernel: str) -> np.ndarray:
    if kernel == "cauchy":
        return sigma / math.pi / (x**2 + sigma**2)
    return np.exp(-((x / sigma) ** 2) / 2) / (sigma * math.sqrt(2 * math.pi))


def partial_dos(runs: DataFrame, sigma: float = 0.2, pitch: float | None = None, kernel: str = "normal") -> DataFrame:
    """(run_id, kind, i, energy, dos) of runs (run_id, eigenvalues, impacts, kinds): the total kernel sum times each atom's impact, summed by kind of atom.

    eigenvalues ascend, impacts has a row of one number an atom for each of them, kinds names the
    atoms. Between eigenvalues impacts are interpolated; below the first they are 0, above the
    last they stay.
    """

    def run(batches):
        for b in batches:
            for run_id, values, impacts, kinds in zip(*(c.to_pylist() for c in b.columns), strict=True):
                e, m = np.array(values), np.array(impacts)
                at = _grid(e, sigma, pitch)
                total = _kernels(e[None, :] - at[:, None], sigma, kernel).sum(axis=1)
                share = np.stack([np.interp(at, e, m[:, k], left=0.0) for k in range(m.shape[1])])
                for kind in dict.fromkeys(kinds):
                    own = share[[k for k, x in enumerate(kinds) if x == kind]].sum(axis=0) * total
                    yield pa.RecordBatch.from_arrays([pa.array([run_id] * len(at), pa.int64()), pa.array([kind] * len(at)), pa.array(np.arange(len(at), dtype=np.int32)), pa.array(at), pa.array(own)], names=["run_id", "kind", "i", "energy", "dos"])

    rows = runs.where(F.size("eigenvalues") > 0).select(F.col("run_id").cast("long").alias("run_id"), F.col("eigenvalues").cast("array<double>").alias("eigenvalues"), F.col("impacts").cast("array<array<double>>").alias("impacts"), "kinds")
    return rows.mapInArrow(run, "run_id long, kind string, i int, energy double, dos double").select("run_id", "kind", "i", (F.round("energy", 3) + 0.0).alias("energy"), F.round("dos", 3).alias("dos"))


def bands_of(points: DataFrame) -> DataFrame:
    """(run_id, stripes) of (run_id, band, k, energy)."""
    per = points.groupBy("run_id", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "energy"))), lambda x: x["energy"]).alias("stripe"))
    return per.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "stripe"))), lambda x: x["stripe"]).alias("stripes"))


def is_conductor(stripes: Column) -> Column:
    """Whether a band spans 0, of those before the first band that lies above 0."""
    above = F.transform(stripes, lambda s: F.array_min(s) > 0)
    first = F.array_position(above, True)
    return F.exists(F.when(first > 0, F.slice(stripes, F.lit(1), first.cast("int") - 1)).otherwise(stripes), lambda s: (F.array_min(s) < 0) & (F.array_max(s) > 0))


def gap_of_bands(stripes: Column, abscissa: Column, most: float = 50.0) -> Column:
    """(gap, direct, error): between the first band n >= 1 above 0 and the band below it.

    direct tells whether both ends stand at one value of abscissa; it is null where the bands
    overlap, whose gap is 0. A gap above most, or no band above 0, is an error.
    """
    n = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(stripes) - 1)), lambda i: (i < F.size(stripes)) & (F.array_min(F.try_element_at(stripes, i + 1)) > 0)), F.lit(0))
    up, down = F.try_element_at(stripes, n + 1), F.try_element_at(stripes, n)
    gap = F.array_min(up) - F.array_max(down)
    at = lambda band, v: F.try_element_at(abscissa, F.array_position(band, v).cast("int"))
    error = F.when(n.isNull(), F.lit("no bands above zero found")).when(gap > most, F.lit("unphysical band gap"))
    return F.struct(F.when(error.isNull(), F.greatest(gap, F.lit(0.0))).alias("gap"), F.when(error.isNull() & (gap > 0), at(up, F.array_min(up)) == at(down, F.array_max(down))).alias("direct"), error.alias("error"))


def band_gap(bands: DataFrame) -> DataFrame:
    """(run_id, gap, direct, error) of bands (run_id, stripes, abscissa); the gap to four decimals."""
    return bands.select("run_id", gap_of_bands(F.col("stripes"), F.col("abscissa")).alias("x")).select("run_id", F.round("x.gap", 4).alias("gap"), "x.direct", "x.error")


def gap_of_dos(x: Column, total: Column, most: float = 50.0) -> Column:
    """(gap, error) around 0 of a density of states: 0 where there is density at the first x above 0 (not the first point), else the distance of the nearest points with density on either side.

    No density to the right, or none to the left but at the first point, is an error, as is a gap above most.
    """
    rows = F.transform(F.arrays_zip(x.alias("x"), total.alias("d")), lambda r, i: F.struct(r["x"].alias("x"), r["d"].alias("d"), i.alias("i")))
    first = F.get(F.filter(rows, lambda r: (r["x"] > 0) & (r["i"] > 0)), F.lit(0))
    dense = F.filter(rows, lambda r: r["d"] != 0)
    right = F.get(F.filter(dense, lambda r: r["i"] >= first["i"]), F.lit(0))
    left = F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("struct<x:double,d:double,i:int>")), dense), lambda r: r.isNull() | ((r["i"] < first["i"]) & (r["i"] > 0))), -1)
    gap = F.when(first["d"] > 0, F.lit(0.0)).otherwise(right["x"] - left["x"])
    error = F.when(first.isNull() | (gap.isNull() & right.isNull()), F.lit("no values above zero found")).when(gap.isNull(), F.lit("not enough eigenvalues to determine the gap")).when(gap > most, F.lit("unphysical band gap"))
    return F.struct(F.when(error.isNull(), gap).alias("gap"), error.alias("error"))


def electronic_type(conductor: Column, gap: Column, direct: Column, dos_gap: Column | None = None) -> Column:
    """(etype, gap, bandgaptype): bands first; conductors 2, 0, 1, overlapping bands 1, 0, 1, else direct 2 or indirect 3. Without bands the gap of the density of states, whose type stays open."""
    dos_gap = F.lit(None).cast("double") if dos_gap is None else F.round(dos_gap, 2)
    row = lambda e, g, t: F.struct(e.alias("etype"), g.cast("double").alias("gap"), t.alias("bandgaptype"))
    by_bands = row(F.lit(1), F.round(gap, 2), F.when(gap == 0, F.lit(1)).when(direct, F.lit(2)).otherwise(F.lit(3)))
    by_dos = row(F.when(dos_gap == 0, F.lit(2)).otherwise(F.lit(1)), dos_gap, F.when(dos_gap == 0, F.lit(1)).otherwise(F.lit(0)))
    return F.when(conductor, row(F.lit(2), F.lit(0.0), F.lit(1))).when(gap.isNotNull(), by_bands).when(dos_gap.isNotNull(), by_dos).otherwise(row(F.lit(0), F.lit(None), F.lit(0)))


def spline_bands(bands: DataFrame, most_points: int = 20) -> DataFrame:
    """(run_id, band, i, x, y): natural cubic splines through the points of (run_id, abscissa, stripes), three decimals.

    Of more than most_points points about every tenth part is used. The step is the span over the
    number of points and over 10 (fewer than ten points) or 1.5.
    """

    def run(batches):
        for b in batches:
            for run_id, x, stripes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keep = slice(None, None, len(x) // 10) if len(x) > most_points else slice(None)
                at = np.array(x, float)[keep]
                step = (at.max() - at.min()) / len(x) / (10 if len(at) < 10 else 1.5)
                new = np.arange(at.min(), at.max() + step / 2, step) if step > 0 else at[:1]
                for band, y in enumerate(stripes):
                    found = NaturalSpline(at, np.array(y, float)[keep])(new) if len(at) > 1 else np.array(y[:1], float)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([run_id] * len(new), pa.int64()), pa.array(np.full(len(new), band, np.int32)), pa.array(np.arange(len(new), dtype=np.int32)), pa.array(new), pa.array(found)], names=["run_id", "band", "i", "x", "y"])

    rows = bands.where(F.size("abscissa") > 0).select(F.col("run_id").cast("long").alias("run_id"), "abscissa", "stripes")
    return rows.mapInArrow(run, "run_id long, band int, i int, x double, y double").select("run_id", "band", "i", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


class NaturalSpline:
    """Cubic spline whose curvature ends at 0; outside its points it goes on as a straight line."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, n = x, y, len(x)
        h, slope = np.diff(x), np.diff(y) / np.diff(x)
        self.curve = np.zeros(n)
        if n > 2:
            system = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
            self.curve[1:-1] = np.linalg.solve(system, 6 * np.diff(slope))

    def __call__(self, at: np.ndarray, degree: int = 0) -> np.ndarray:
        """Values, slopes (degree 1) or curvatures (2)."""
        at = np.asarray(at, float)
        inside = np.clip(at, self.x[0], self.x[-1])
        i = np.clip(np.searchsorted(self.x, inside, side="right") - 1, 0, len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        a, b = (self.x[i + 1] - inside) / h, (inside - self.x[i]) / h
        k, m = self.curve[i], self.curve[i + 1]
        slope = (self.y[i + 1] - self.y[i]) / h + h / 6 * (m * (3 * b**2 - 1) - k * (3 * a**2 - 1))
        if degree == 1:
            return slope
        if degree == 2:
            return np.where(at == inside, a * k + b * m, 0.0)
        return a * self.y[i] + b * self.y[i + 1] + h**2 / 6 * ((a**3 - a) * k + (b**3 - b) * m) + slope * (at - inside)


def band_path(kpoints: DataFrame, mode: str = "sum") -> DataFrame:
    """(run_id, k_idx, d): cumulative length of the path over ordered vectors; each step adds (mode sum) or subtracts (difference) the vector before."""
    w = Window.partitionBy("run_id").orderBy("k_idx")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    sign = 1 if mode == "sum" else -1
    step = F.sqrt(sum((F.pow(F.col(c) + sign * before(c), 2) for c in ("kx", "ky", "kz")), F.lit(0.0)))
    first = F.lag("kx").over(w).isNull()
    return kpoints.withColumn("s", F.when(first, F.lit(0.0)).otherwise(step)).select("run_id", "k_idx", F.round(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("d"))


def phonon_cartesian(vectors: Column, cell: list[Column]) -> Column:
    """Each triple of an eigenvector times the cell (three array columns), three decimals."""
    return F.transform(vectors, lambda v: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.round(sum((v[i] * cell[i][j] for i in range(3)), F.lit(0.0)), 3)))


def spectra_points(spectra: DataFrame) -> DataFrame:
    """(run_id, series, i, x, y) of precomputed spectra (run_id, x, values: map of series to numbers, the total among them)."""
    rows = spectra.select("run_id", "x", F.explode("values").alias("series", "v"))
    return rows.select("run_id", "series", F.posexplode(F.arrays_zip("x", "v")).alias("i", "p")).select("run_id", "series", "i", F.col("p.x").alias("x"), F.col("p.v").alias("y"))


def tick_label(name: Column) -> Column:
    """Name of a point of a band path, as HTML."""
    return F.when(name == "GAMMA", F.lit("&#915;")).otherwise(name)


def phonon_listing(phonons: DataFrame) -> DataFrame:
    """(run_id, kpoint, mode, frequency, irrep, ir, raman) of (run_id, modes, irreps: maps by k-point, ir_active, raman_active).

    A missing irrep is ?; IR and Raman activity belong to the k-point 0 0 0 and are null elsewhere.
    """
    rows = phonons.select("run_id", "irreps", "ir_active", "raman_active", F.explode("modes").alias("kpoint", "freqs")).select("*", F.posexplode("freqs").alias("mode", "frequency"))
    at = lambda c: F.get(c, F.col("mode"))
    center = lambda c: F.when(F.col("kpoint") == "0 0 0", at(c))
    irrep = F.coalesce(at(F.try_element_at("irreps", F.col("kpoint"))), F.lit("?"))
    return rows.select("run_id", "kpoint", "mode", "frequency", irrep.alias("irrep"), center(F.col("ir_active")).alias("ir"), center(F.col("raman_active")).alias("raman"))
