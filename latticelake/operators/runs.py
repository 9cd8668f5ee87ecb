"""Selection, joins and aggregates over runs and their property tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decode_enum, decode_enums
from ..reference_data import ENUMS, FACETS
from .facets import all_tags


def quality_filter(runs: DataFrame, skip_unfinished: bool = True, skip_no_energy: bool = True) -> DataFrame:
    """Without runs that aren't finished (code 1) or have no energy (null or 0)."""
    if skip_unfinished:
        runs = runs.where(F.coalesce(F.col("finished"), F.lit(0)) != 1)
    if skip_no_energy:
        runs = runs.where(F.col("total").isNotNull() & (F.col("total") != 0))
    return runs


def range_filter(runs: DataFrame, tables: dict[str, DataFrame], ranges: list[tuple[str, str, float, float]]) -> DataFrame:
    """Runs whose (table, column) values lie in all inclusive ranges; lattice columns are those of the final structure."""
    for name, column, low, high in ranges:
        own = tables[name]
        if name == "lattices":
            own = own.join(tables["structures"].where("final").select("struct_id", "checksum"), "struct_id")
        runs = runs.join(own.where(F.col(column).between(low, high)).select("checksum"), "checksum", "left_semi")
    return runs


def key_page(runs: DataFrame, keys: DataFrame, page: int, size: int) -> DataFrame:
    """The rows of one page of an explicit key list; the list is cut before the lookup."""
    return runs.join(keys.orderBy("checksum").offset(page * size).limit(size), "checksum", "left_semi")


def app_scope(runs: DataFrame, target: dict[str, str]) -> Column:
    """Whether an app is permitted for a run: every present value contains its target (or, with a leading !, doesn't), and one is present.

    Of an array an entry has to equal the target. Columns that runs don't have are not present.
    """
    if not target:
        return F.lit(True)
    kinds, ok, some = dict(runs.dtypes), F.lit(True), F.lit(False)
    for key, want in target.items():
        if key in kinds:
            value, text = F.col(key), want.removeprefix("!")
            hit = F.array_contains(value.cast("array<string>"), text) if kinds[key].startswith("array") else value.cast("string").contains(text)
            ok = ok & F.coalesce(~hit if want.startswith("!") else hit, F.lit(True))
            some = some | value.isNotNull()
    return ok & some


def join_properties(runs: DataFrame, *tables: DataFrame) -> DataFrame:
    """Inner joins on the key: a run without a row in some table goes."""
    for t in tables:
        runs = runs.join(t, "checksum")
    return runs


def ground_state(runs: DataFrame) -> DataFrame:
    """All runs of least energy for their formula and number of units, ties kept.

    The least energy per group is combined before the shuffle and joined back, so that a popular
    formula is no task's burden.
    """
    known = runs.where(F.col("total").isNotNull() & ~F.isnan("total"))
    least = known.groupBy("chemical_formula", "formula_units").agg(F.min("total").alias("least"))
    return known.join(least, ["chemical_formula", "formula_units"]).where(F.col("total") == F.col("least")).drop("least")


def band_gap_listing(energies: DataFrame, ratios: DataFrame, electrons: DataFrame, metadata: DataFrame) -> DataFrame:
    """Ground-state runs with a gap, by gap and key."""
    ground = ground_state(energies.join(ratios, "checksum"))
    gaps = electrons.where("gap > 0").select("checksum", "gap")
    return ground.join(gaps, "checksum").join(metadata.select("checksum", "location"), "checksum").select("checksum", "chemical_formula", "formula_units", "total", "gap", "location").orderBy("gap", "checksum")


#: Formatted columns of the table view, by name.
GRID = {
    "formula": lambda k: F.regexp_replace("chemical_formula", r"[0-9.\-][0-9.\-d]*", "<sub>$0</sub>"), "energy": lambda k: F.when(F.col("total").isNotNull(), F.format_string("%6.5f", "total")),
    "volume": lambda k: F.when(F.col("periodicity").isin(2, 3), F.format_string("%4.2f", "dims")), "file": lambda k: F.element_at(F.split("location", "/"), -1), "gap": lambda k: F.col("gap").cast("string")}


def grid_rows(runs: DataFrame, columns: list[str] = ("formula", "energy", "file", "gap")) -> DataFrame:
    """Formatted table view of the named columns (those of GRID, or codes of enumerated facets by their source); missing values as a dash."""
    cids = {f[2]: f[0] for f in FACETS}
    kinds = dict(runs.dtypes)
    out = []
    for c in columns:
        if c in GRID:
            value = GRID[c](c)
        elif cids.get(c) in ENUMS:
            value = decode_enums(F.col(c), cids[c]) if kinds[c].startswith("array") else decode_enum(F.col(c), cids[c])
        else:
            value = F.col(c).cast("string")
        out.append(F.coalesce(value, F.lit("—")).alias(c))
    return runs.select("checksum", *out)


def summary_long(runs: DataFrame, facets: list[tuple] = FACETS) -> DataFrame:
    """(checksum, sort, name, content): one row for each run and facet with a place in the summary, codes as their names; facets that runs have no column for are left out."""
    kinds = dict(runs.dtypes)
    rows = []
    for cid, name, source, sort, _, _, summary, *_ in facets:
        if summary and source in kinds:
            many = kinds[source].startswith("array")
            value = (decode_enums if many else decode_enum)(F.col(source), cid) if cid in ENUMS else F.array_join(F.col(source).cast("array<string>"), ", ") if many else F.col(source).cast("string")
            rows.append(F.struct(F.lit(sort).alias("sort"), F.lit(name).alias("name"), value.alias("content")))
    return runs.select("checksum", F.explode(F.array(*rows)).alias("x")).select("checksum", "x.*")


def convergence_order(series: DataFrame) -> DataFrame:
    """Order of magnitude of each step's change; equal neighbours are skipped."""
    w = Window.partitionBy("run_id").orderBy("step")
    return (series.withColumn("d", F.abs(F.col("value") - F.lead("value").over(w))).where("d > 0")
            .select("run_id", "step", F.floor(F.log10("d")).cast("int").alias("magnitude")))


def optimisation_story(series: DataFrame) -> DataFrame:
    """Energy above the run's minimum at each step, five decimals."""
    least = series.groupBy("run_id").agg(F.min("value").alias("least"))
    return series.join(least, "run_id").select("run_id", "step", F.round(F.col("value") - F.col("least"), 5).alias("above"))


def optimisation_log(runs: DataFrame) -> DataFrame:
    """(run_id, step, thresholds, cycles): missing cycle counts as ^, missing numbers as NaN."""
    return runs.select("run_id", "ncycles", F.posexplode("tresholds").alias("step", "t")).select(
        "run_id", "step", F.transform("t", lambda x: F.coalesce(x, F.lit(float("nan")))).alias("thresholds"),
        F.coalesce(F.try_element_at("ncycles", F.col("step") + 1).cast("string"), F.lit("^")).alias("cycles"))


#: Page sizes and sort keys of browse().
PAGE_SIZES, SORTS = (50, 100, 250), ("chemical_formula", "location")


def selected(runs: DataFrame, tags: DataFrame, tids: list[int], tables: dict[str, DataFrame] | None = None, ranges: list[tuple[str, str, float, float]] = ()) -> DataFrame:
    """The runs that carry all tags and lie in all ranges."""
    return range_filter(runs.join(all_tags(tags, tids), "checksum", "left_semi") if tids else runs, tables or {}, list(ranges))


def browse(runs: DataFrame, tags: DataFrame, tids: list[int], tables: dict[str, DataFrame] | None = None, ranges: list[tuple[str, str, float, float]] = (), sort: int = 0, page: int = 0, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """One page of the runs that carry all tags and lie in all ranges, in order of formula (sort 0) or location (1) and then key; and (count) of all of them."""
    if size not in PAGE_SIZES or sort not in range(len(SORTS)):
        raise ValueError("unknown page size or sort key")
    rows = selected(runs, tags, tids, tables, ranges)
    return rows.orderBy(SORTS[sort], "checksum").offset(page * size).limit(size), rows.agg(F.count("*").alias("count"))


def validate_parsed(runs: DataFrame) -> DataFrame:
    """Errors of parsed runs, and a warning for unfinished ones."""
    return runs.withColumn("error", F.when(F.coalesce(F.col("natom"), F.lit(0)) == 0, F.lit("Valid structure is not present!")).when(F.col("xc").isNull(), F.lit("XC potential is not present!"))).withColumn(
        "warning", F.when(F.col("finished") == 1, F.lit("This calculation is not correctly finalized!")))


def fill_defaults(runs: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls, and empty strings and arrays, replaced by the facet's default."""
    kinds, new = dict(runs.dtypes), {}
    for c, v in defaults.items():
        empty = F.col(c).isNull() | (F.size(c) == 0 if kinds[c].startswith("array") else F.col(c).cast("string") == "")
        value = F.array(*(F.lit(x) for x in v)) if isinstance(v, list) else F.lit(v)
        new[c] = F.when(empty, value).otherwise(F.col(c))
    return runs.withColumns(new)
