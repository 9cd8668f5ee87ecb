"""Registered queries over the bindings, each with its SQL twin where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import functionals as XC
from ..functions import keys as K
from ..functions import scalars as S
from ..operators import facets as FA
from ..operators import geometry as G
from ..operators import maintain as MT
from ..operators import mining as MI
from ..operators import runs as R
from ..operators import spectra as SP
from ..reference_data import CRYSTAL_SYSTEMS, ENUMS, FACETS, FORMULA_ORDER, LAYER_GROUPS, MASSES, POINT_GROUPS, RADII, SYMBOLS, elements, enum_values, facets
from ..sources import files as SF
from .bindings import table, with_views

QUERIES: dict = {}
#: The twins with their views in front, and as they were written.
ORACLES: dict[str, str] = {}
TWINS: dict[str, str] = {}


class Tables:
    """The tables of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self._dir, name)


def query(name: str, sql: str | None = None):
    """Registers f(tables) under a name with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name], TWINS[name] = with_views(sql), sql
        return f

    return add


def _values(rows) -> str:
    text = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


ELEMENT_ROWS = _values([(i + 1, s, MASSES[i], RADII[i], FORMULA_ORDER.index(s) if s in FORMULA_ORDER else 999) for i, s in enumerate(SYMBOLS)]) + " e(number, symbol, mass, radius, place)"
LISTING = """select e.checksum, s.chemical_formula, s.formula_units, e.total, l.gap, m.location from b_energies e join b_struct_ratios s using (checksum) join b_electrons l using (checksum) join b_metadata m using (checksum)
  join (select chemical_formula, formula_units, min(total) as least from b_energies join b_struct_ratios using (checksum) group by 1, 2) g on g.chemical_formula = s.chemical_formula and g.formula_units = s.formula_units and g.least = e.total where l.gap > 0"""


@query("o2_band_gap_listing", LISTING)
def _(t):
    return R.band_gap_listing(t.b_energies, t.b_struct_ratios, t.b_electrons, t.b_metadata)


@query("a1_count_runs", "select count(*) as n from b_metadata")
def _(t):
    return t.b_metadata.agg(F.count("*").alias("n"))


@query("a2_ground_state", """select e.checksum, s.chemical_formula, s.formula_units, e.total from b_energies e join b_struct_ratios s using (checksum) where e.total is not null
  qualify rank() over (partition by s.chemical_formula, s.formula_units order by e.total) = 1""")
def _(t):
    return R.ground_state(t.b_energies.join(t.b_struct_ratios, "checksum")).select("checksum", "chemical_formula", "formula_units", "total")


@query("a3_slider_bounds", "select floor(min(gap) * 100) / 100 as low, ceil(max(gap) * 100) / 100 as high from b_electrons")
def _(t):
    return t.b_electrons.agg((F.floor(F.min("gap") * 100) / 100).alias("low"), (F.ceil(F.max("gap") * 100) / 100).alias("high"))


@query("a4_facet_topics", "select t.cid, f.name, f.sort, f.kind, t.topic, coalesce(v.value, t.topic) as value, t.tid, coalesce(c.n, 0) as n from b_topics t join " + _values([(f[0], f[1], f[3], "mendeleev" if f[2] == "elements" else "tag") for f in FACETS]) + " f(cid, name, sort, kind) on f.cid = t.cid left join "
       + _values([(c, str(i), v) for c, n in ENUMS.items() for i, v in enumerate(n) if v]) + " v(cid, num, value) on v.cid = t.cid and v.num = t.topic left join (select tid, count(*) as n from b_tags group by 1) c on c.tid = t.tid")
def _(t):
    return FA.facet_topics(t.b_tags, t.b_topics, facets(t.spark), enum_values(t.spark))


@query("a5_searchables", "select t.tid, coalesce(v.value, t.topic) as value from b_topics t left join " + _values([(c, str(i), v) for c, n in ENUMS.items() for i, v in enumerate(n) if v]) + " v(cid, num, value) on v.cid = t.cid and v.num = t.topic")
def _(t):
    names = [(c, str(i), v) for c, n in ENUMS.items() for i, v in enumerate(n) if v]
    known = F.broadcast(t.spark.createDataFrame(names, "cid int, topic string, value string"))  # the enumerations: about 80 rows
    return t.b_topics.join(known, ["cid", "topic"], "left").select("tid", F.coalesce("value", "topic").alias("value"))


COMPOSED = f"""select struct_id, string_agg(symbol || case when n = 1 then '' else cast(n as varchar) end, '' order by place, symbol) as formula, cast(count(*) as int) as nelem, cast(sum(n) as bigint) as natom
  from (select a.struct_id, e.symbol, e.place, count(*) as n from b_atoms a join {ELEMENT_ROWS} on e.number = a.number group by 1, 2, 3) c group by 1"""


@query("a6_composition", COMPOSED)
def _(t):
    return G.composition(t.b_atoms, elements(t.spark))


@query("a7_molecular_weight", f"select struct_id, cast(round_even(sum(e.mass), 0) as bigint) as weight from b_atoms a join {ELEMENT_ROWS} on e.number = a.number group by 1")
def _(t):
    return G.molecular_weight(t.b_atoms, elements(t.spark))


@query("a8_merge_summary", """select chemical_formula as dataset, cid, topic from b_raw_tags join b_struct_ratios using (checksum) where topic <> '' group by 1, 2, 3""")
def _(t):
    members = t.b_struct_ratios.select(F.col("chemical_formula").alias("dataset"), "checksum")
    return MT.merge_summary(members, t.b_raw_tags, t.b_metadata.select("checksum", "download_size", F.lit(0).alias("nested_depth")))[0]


@query("a9_dataset_size", "select parent_checksum, count(*) as siblings_count from b_calcsets group by 1")
def _(t):
    return MT.dataset_sizes(t.b_calcsets)


@query("a10_total_size", "select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, cast(sum(n_chars) as bigint) as size from b_files group by 1")
def _(t):
    return t.b_files.groupBy(SF.folder_and_stem(F.col("path"))[0].alias("folder")).agg(F.sum("n_chars").alias("size"))


@query("a11_smeared_dos", """with b as (select vec_id as run_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
  g as (select run_id, e, list_min(e) - 2.0 as start, case when list_max(e) > list_min(e) then (list_max(e) - list_min(e)) / 200 else 1.0 end as pitch from b)
  select run_id, cast(u.i as int) as i, round(start + u.i * pitch, 3) + 0.0 as energy, round(list_sum(list_transform(e, lambda x: exp(-pow((x - (start + u.i * pitch)) / 0.2, 2) / 2) / (0.2 * sqrt(2 * pi())))), 3) as dos
  from g, unnest(generate_series(0, cast(floor((list_max(e) - list_min(e) + 4.0) / pitch) as int))) as u(i)""")
def _(t):
    return SP.smeared_dos(t.embeddings.select(F.col("vec_id").alias("run_id"), F.col("embedding").cast("array<double>").alias("eigenvalues")))


NEAR = f"""select a.struct_id, a.atom_idx as center, b.atom_idx as ligand, cast(s.i as int) as image, a.x - (b.x + s.u * l.a11 + s.v * l.a21 + s.w * l.a31) as dx, a.y - (b.y + s.u * l.a12 + s.v * l.a22 + s.w * l.a32) as dy, a.z - (b.z + s.u * l.a13 + s.v * l.a23 + s.w * l.a33) as dz
  from b_atoms a join b_atoms b on a.struct_id = b.struct_id join b_lattices l on l.struct_id = a.struct_id, {_values([(i, *x) for i, x in enumerate([(0, 0, 0), *G.IMAGES])])} s(i, u, v, w) where a.number in (22, 26) and b.number = 8"""
WITHIN = "dx * dx + dy * dy + dz * dz <= 6.25"


@query("j7_neighbours", f"select struct_id, center, ligand, image, round(sqrt(dx * dx + dy * dy + dz * dz), 4) as distance from ({NEAR}) n where {WITHIN}")
def _(t):
    return G.neighbours(t.b_atoms, [22, 26], [8], t.b_lattices)


PERIODS = "select struct_id, case when struct_id % 2 = 0 then 2 else 3 end as periodicity from b_lattices"


@query("a13_octahedra", f"""with p as ({PERIODS}), o as (select n.struct_id, center, string_agg('{{' || ligand || ', ' || image || '}}', ';' order by ligand, image) as ligands from ({NEAR}) n join p using (struct_id) where {WITHIN} group by 1, 2, periodicity having count(*) = 6 or (count(*) = 5 and periodicity = 2))
  select p.struct_id, center, ligands, case when center is null then 'Cannot extract valid octahedra: not enough corner atoms found!' end as error from p left join o using (struct_id)""")
def _(t):
    return G.octahedra(G.neighbours(t.b_atoms, [22, 26], [8], t.b_lattices), t.b_lattices.select("struct_id", F.when(F.col("struct_id") % 2 == 0, 2).otherwise(3).alias("periodicity")))


CENTERS = [(0.0, 0.0, 0.0), (0.1, 0.1, 0.1), (-0.1, 0.05, -0.1)]


@query("a14_lloyd_step", "select cast(c as int) as cluster, count(*) as n, round(avg(p1), 6) as p1, round(avg(p2), 6) as p2, round(avg(p3), 6) as p3 from (select *, list_position(d, list_min(d)) - 1 as c from (select *, ["
       + ", ".join("+".join(f"pow(p{k + 1} - ({v}), 2)" for k, v in enumerate(c)) for c in CENTERS) + "] as d from b_points) x) y group by 1")
def _(t):
    return MI.lloyd_step(t.b_points, CENTERS, ["p1", "p2", "p3"])


def _lloyd_sql(rounds: int) -> str:
    """CENTERS after so many steps, as a chain of common table expressions; the last one is c."""
    text = "with c0 as (select * from " + _values([(i, *c) for i, c in enumerate(CENTERS)]) + " v(i, p1, p2, p3))"
    for k in range(rounds + 1):
        text += f", n{k} as (select p.vec_id, arg_min(c.i, {{'d': pow(p.p1 - c.p1, 2) + pow(p.p2 - c.p2, 2) + pow(p.p3 - c.p3, 2), 'i': c.i}}) as i from b_points p, c{k} c group by 1)"
        if k < rounds:
            text += f", c{k + 1} as (select c.i, coalesce(avg(p.p1), any_value(c.p1)) as p1, coalesce(avg(p.p2), any_value(c.p2)) as p2, coalesce(avg(p.p3), any_value(c.p3)) as p3 from c{k} c left join n{k} n on n.i = c.i left join b_points p on p.vec_id = n.vec_id group by 1)"
    return text + f" select cast(i as int) as cluster, count(*) as n from n{rounds} group by 1"


@query("a14_kmeans", _lloyd_sql(3))
def _(t):
    return MI.kmeans(t.b_points, ["p1", "p2", "p3"], CENTERS, cutoff=0.0, most=3)[0].groupBy("cluster").agg(F.count("*").alias("n"))


@query("a15_k_for", "select nelem, case when count(*) > 200 then 8 when count(*) > 100 then 6 when count(*) > 50 then 5 when count(*) > 30 then 4 else 3 end as k from b_struct_ratios group by 1")
def _(t):
    return t.b_struct_ratios.groupBy("nelem").agg(S.k_for(F.count("*")).alias("k"))


@query("a16_binary_features", """with g as (select e.checksum, s.chemical_formula as label, l.gap from b_energies e join b_struct_ratios s using (checksum) join b_electrons l using (checksum) join (select chemical_formula, formula_units, min(total) as least from b_energies join b_struct_ratios using (checksum) group by 1, 2) m
    on m.chemical_formula = s.chemical_formula and m.formula_units = s.formula_units and m.least = e.total where l.gap > 0),
  k as (select distinct s.checksum, a.number, case a.number when 1 then 1 when 6 then 14 when 8 then 16 when 12 then 2 when 22 then 4 when 26 then 8 when 38 then 2 when 57 then 3 end as grp from b_structures s join b_atoms a using (struct_id) where s.final)
  select g.checksum, g.label, cast(min(k.grp) as int) as group_a, cast(max(k.grp) as int) as group_b, g.gap from g join k using (checksum) group by 1, 2, 5 having count(*) = 2""")
def _(t):
    ground = R.ground_state(t.b_energies.join(t.b_struct_ratios, "checksum")).join(t.b_electrons.where("gap > 0"), "checksum")
    return MI.binary_features(ground, t.b_atoms, t.b_structures)


@query("a17_unique_values", "select distinct chemical_formula from b_struct_ratios")
def _(t):
    return t.b_struct_ratios.select("chemical_formula").distinct()


@query("f1_quality_filter", "select checksum from b_metadata join b_energies using (checksum) where finished <> 1 and total is not null and total <> 0")
def _(t):
    return R.quality_filter(t.b_metadata.join(t.b_energies, "checksum")).select("checksum")


@query("f2_range_filter", "select m.checksum from b_metadata m join b_electrons e using (checksum) join b_structures s using (checksum) join b_lattices l using (struct_id) where s.final and e.gap between 1 and 4 and l.a33 between 8 and 20")
def _(t):
    return R.range_filter(t.b_metadata.select("checksum"), {"electrons": t.b_electrons, "lattices": t.b_lattices, "structures": t.b_structures}, [("electrons", "gap", 1, 4), ("lattices", "a33", 8, 20)])


@query("f3_key_filter", "select checksum, location from b_metadata where checksum in (select checksum from b_electrons where gap > 7 order by checksum limit 50 offset 50)")
def _(t):
    return R.key_page(t.b_metadata, t.b_electrons.where("gap > 7").select("checksum"), 1, 50).select("checksum", "location")


@query("f4_decode_enum", "select checksum, case finished when 0 then 'unknown finalization' when 1 then 'not finalized' when 2 then 'finalized' else '—' end as finished from b_metadata")
def _(t):
    return t.b_metadata.select("checksum", S.decode_enum(F.col("finished"), 1006).alias("finished"))


@query("f5_grid_rows", r"""select m.checksum, regexp_replace(s.chemical_formula, '([0-9.\-][0-9.\-d]*)', '<sub>\1</sub>', 'g') as formula, coalesce(printf('%.5f', e.total), '—') as energy, split_part(m.location, '/', -1) as file,
  case when l.gap is null then '—' else cast(l.gap as varchar) end as gap from b_metadata m join b_struct_ratios s using (checksum) join b_energies e using (checksum) left join b_electrons l using (checksum)""")
def _(t):
    return R.grid_rows(t.b_metadata.join(t.b_struct_ratios, "checksum").join(t.b_energies, "checksum").join(t.b_electrons, "checksum", "left"))


@query("f6_summary_long", "select checksum, 20 as sort, 'formula' as name, chemical_formula as content from b_struct_ratios union all select checksum, 40, 'number of elements', case nelem when 1 then 'unary' when 2 then 'binary' else 'ternary' end from b_struct_ratios"
       " union all select checksum, 370, 'finished', case finished when 0 then 'unknown finalization' when 1 then 'not finalized' else 'finalized' end from b_metadata union all select checksum, 310, 'total energy', cast(cast(round(total) as bigint) as varchar) from b_energies")
def _(t):
    runs = t.b_metadata.join(t.b_struct_ratios, "checksum").join(t.b_energies, "checksum")
    return R.summary_long(runs.select("checksum", F.col("chemical_formula").alias("standard"), "nelem", "finished", F.round("total").cast("long").alias("energy")))


@query("f7_select_json_field", "select checksum, json_extract_string(info, '$.framework') as framework from b_grid where json_extract_string(info, '$.framework') is not null")
def _(t):
    return t.b_grid.select("checksum", F.get_json_object("info", "$.framework").alias("framework")).where("framework is not null")


@query("f8_app_scope", "select checksum from b_struct_ratios where chemical_formula like '%O3%' and not cast(formula_units as varchar) like '%2%'")
def _(t):
    return t.b_struct_ratios.where(R.app_scope(t.b_struct_ratios, {"chemical_formula": "O3", "formula_units": "!2", "absent": "x"})).select("checksum")


@query("f9_fill_defaults", "select checksum, coalesce(json_extract_string(info, '$.framework'), '0') as framework from b_grid")
def _(t):
    return R.fill_defaults(t.b_grid.select("checksum", F.get_json_object("info", "$.framework").alias("framework")), {"framework": "0"})


@query("f10_final_structure", "select checksum, struct_id from b_structures where final")
def _(t):
    return t.b_structures.where("final").select("checksum", "struct_id")


@query("j1_join_properties", "select checksum, total, gap, n from b_energies join b_electrons using (checksum) join b_spacegroups using (checksum)")
def _(t):
    return R.join_properties(t.b_energies, t.b_electrons, t.b_spacegroups).select("checksum", "total", "gap", "n")


@query("j2_all_tags", "select checksum from b_tags where tid in (3, 5) group by 1 having count(distinct tid) = 2")
def _(t):
    return FA.all_tags(t.b_tags, [3, 5])


@query("j3_cooccurring_tags", "select distinct tid from b_tags where checksum in (select checksum from b_tags where tid in (3, 5) group by 1 having count(distinct tid) = 2)")
def _(t):
    return FA.cooccurring_tags(t.b_tags, [3, 5])


@query("j4_runs_by_topic", "select checksum from b_tags join b_topics using (tid) where cid = 2 and topic = 'Sr'")
def _(t):
    return FA.runs_by_topic(t.b_tags, t.b_topics, 2, "Sr")


@query("j5_topics_of_run", "select checksum, cid, topic from b_tags join b_topics using (tid)")
def _(t):
    return FA.topics_of_run(t.b_tags, t.b_topics)


@query("j6_relational_lookup", "select checksum, n from b_spacegroups join b_basissets using (checksum) where kind = 3")
def _(t):
    return t.b_spacegroups.join(t.b_basissets.where("kind = 3"), "checksum").select("checksum", "n")


@query("s12_compare_listings", "select 'C' as checksum, 0 as n, 'a' as side where false")
def _(t):
    serial = t.b_grid.where(F.get_json_object("info", "$.ansatz") == "3").select("checksum", F.get_json_object("info", "$.ng").cast("int").alias("n"))
    return FA.same_rows(serial, t.b_spacegroups.join(t.b_basissets.where("kind = 3"), "checksum").select("checksum", "n"))


@query("j8_interval_lookup", "select checksum, (select name from " + _values(CRYSTAL_SYSTEMS) + " v(lo, hi, name) where n between lo and hi) as system, (select name from "
       + _values(POINT_GROUPS) + " v(lo, hi, name) where n between lo and hi) as point_group from b_spacegroups")
def _(t):
    return t.b_spacegroups.select("checksum", S.crystal_system(F.col("n")).alias("system"), S.point_group(F.col("n")).alias("point_group"))


@query("j9_layer_group", "select s.checksum, v.g as layer_group, case when v.g between 1 and 7 then '2d-oblique' when v.g between 8 and 48 then '2d-rectangular' when v.g between 49 and 64 then '2d-square' when v.g >= 65 then '2d-hexagonal' end as system from b_spacegroups s left join "
       + _values(LAYER_GROUPS.items()) + " v(n, g) on v.n = s.n")
def _(t):
    g = S.layer_group(F.col("n"), F.lit(False))
    return t.b_spacegroups.select("checksum", g.alias("layer_group"), S.layer_system(g).alias("system"))


@query("g3_relaxation", """with p as materialized (select s.checksum, s.final, a.atom_idx, a.x, a.y, a.z from b_structures s join b_atoms a using (struct_id)),
  w as (select checksum, atom_idx, count(*) as n, round(sqrt(pow(max(x) filter (where final) - max(x) filter (where not final), 2) + pow(max(y) filter (where final) - max(y) filter (where not final), 2) + pow(max(z) filter (where final) - max(z) filter (where not final), 2)), 2) as shift from p group by 1, 2),
  odd as (select distinct checksum from w where n <> 2)
  select checksum, atom_idx, shift, cast(null as varchar) as error from w where checksum not in (select checksum from odd) union all select checksum, null, null, 'different numbers of atoms' from odd""")
def _(t):
    return G.relaxation(t.b_structures, t.b_atoms)


@query("j10_step_pairs", """with p as materialized (select s.checksum, s.final, a.atom_idx, a.x from b_structures s join b_atoms a using (struct_id))
  select checksum, atom_idx, max(x) filter (where not final) as px, max(x) filter (where final) as qx from p group by 1, 2""")
def _(t):
    return G.step_pairs(t.b_structures, t.b_atoms).select("checksum", "atom_idx", F.col("p.x").alias("px"), F.col("q.x").alias("qx"))


@query("j12_functional_family", "select p_partkey, case p_partkey % 5 when 0 then 'LDA' when 1 then 'GGA' when 2 then 'MGGA' when 3 then 'HYB_GGA' else 'HYB_MGGA' end as name, case p_partkey % 5 when 0 then '1' when 1 then '2' when 2 then '3' when 3 then '2,4' else '3,4' end as family from part")
def _(t):
    name = F.element_at(F.array(*(F.lit(x) for x in ("LDA", "GGA", "MGGA", "HYB_GGA", "HYB_MGGA"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", name.alias("name"), F.array_join(S.functional_family(F.concat(name, F.lit("_X_TEST"))), ",").alias("family"))


@query("j13_unused_dimension", "select tid, cid, topic from b_topics where tid not in (select t.tid from b_tags t join b_metadata m using (checksum) where m.finished = 2)")
def _(t):
    return FA.unused(t.b_topics, t.b_tags.join(t.b_metadata.where("finished = 2"), "checksum"), "tid").select("tid", "cid", "topic")


@query("w1_convergence_order", "select run_id, step, cast(floor(log10(d)) as int) as magnitude from (select run_id, step, abs(value - lead(value) over (partition by run_id order by step)) as d from b_series) x where d > 0")
def _(t):
    return R.convergence_order(t.b_series)


@query("w2_optimisation_story", "select run_id, step, round(value - min(value) over (partition by run_id), 5) as above from b_series")
def _(t):
    return R.optimisation_story(t.b_series)


@query("w3_convergence_story", "select run_id, step, round(value, 5) as value from b_series")
def _(t):
    return t.b_series.select("run_id", "step", F.round("value", 5).alias("value"))


LENGTHS = ", ".join(f"sqrt(a{i}1 * a{i}1 + a{i}2 * a{i}2 + a{i}3 * a{i}3)" for i in (1, 2, 3))
ORDERED = f"""select a.struct_id, cast(row_number() over (partition by a.struct_id order by h, a.atom_idx) as int) as place, a.atom_idx, a.number, h as height from (select b.*, case when l.axis = 1 then b.x when l.axis = 2 then b.y else b.z end as h from b_atoms b
  join (select struct_id, list_last(list_filter([1, 2, 3], lambda i: ls[i] = list_max(ls))) as axis from (select struct_id, [{LENGTHS}] as ls from b_lattices) q) l on l.struct_id = b.struct_id) a"""
LAYERS = f"""select struct_id, layer, number, count(*) as n from (select *, cast(sum(fresh) over (partition by struct_id order by place rows unbounded preceding) as bigint) as layer from
  (select *, case when height - lag(height) over (partition by struct_id order by place) > 0.7 then 1 else 0 end as fresh from ({ORDERED}) o) f) l group by 1, 2, 3"""


@query("o3_atoms_by_axis", ORDERED)
def _(t):
    return G.atoms_by_axis(t.b_atoms, t.b_lattices)


@query("w4_slab_layers", LAYERS)
def _(t):
    return G.slab_layers(t.b_atoms, t.b_lattices)


@query("c8_surface_termination", f"""with c as (select struct_id, layer, list_reduce(list(n), lambda a, b: gcd(a, b)) as g, list({{'p': e.place, 's': e.symbol, 'n': n}} order by e.place, e.symbol) as content from ({LAYERS}) y join {ELEMENT_ROWS} on e.number = y.number group by 1, 2),
  d as (select struct_id, min_by(content, layer) as a, max_by(content, layer) as b, min_by(g, layer) as g, count(*) as k from c group by 1)
  select struct_id, array_to_string(list_transform(a, lambda x: x.s || case when x.n = g then '' else cast(x.n // g as varchar) end), '') as termination from d where k > 1 and a = b""")
def _(t):
    return G.surface_termination(G.slab_layers(t.b_atoms, t.b_lattices), elements(t.spark))


DET = "abs(a11 * (a22 * a33 - a23 * a32) - a12 * (a21 * a33 - a23 * a31) + a13 * (a21 * a32 - a22 * a31))"


CELLS = f"""select struct_id, round(sqrt(a11 * a11 + a12 * a12 + a13 * a13), 3) as a, round(sqrt(a21 * a21 + a22 * a22 + a23 * a23), 3) as b, round(sqrt(a31 * a31 + a32 * a32 + a33 * a33), 3) as c,
  round(degrees(acos((a21 * a31 + a22 * a32 + a23 * a33) / (sqrt(a21 * a21 + a22 * a22 + a23 * a23) * sqrt(a31 * a31 + a32 * a32 + a33 * a33)))), 2) as alpha,
  round(degrees(acos((a11 * a31 + a12 * a32 + a13 * a33) / (sqrt(a11 * a11 + a12 * a12 + a13 * a13) * sqrt(a31 * a31 + a32 * a32 + a33 * a33)))), 2) as beta,
  round(degrees(acos((a11 * a21 + a12 * a22 + a13 * a23) / (sqrt(a11 * a11 + a12 * a12 + a13 * a13) * sqrt(a21 * a21 + a22 * a22 + a23 * a23)))), 2) as gamma, round({DET}, 3) as volume from b_lattices"""


@query("g1_cell_parameters", CELLS)
def _(t):
    return G.cell_parameters(t.b_lattices)


@query("w5_cell_drift", "select checksum, " + ", ".join(f"round(max_by(c.{n}, s.step) - min_by(c.{n}, s.step), 3) as {'dv' if n == 'volume' else 'd' + n}" for n in ("a", "b", "c", "alpha", "beta", "gamma", "volume")) + f" from b_structures s join ({CELLS}) c using (struct_id) group by 1")
def _(t):
    return G.cell_drift(t.b_structures, t.b_lattices)


FRACTIONS = """with f as (select a.struct_id, a.atom_idx, a.number, x, y, z, l.*, a11 * (a22 * a33 - a23 * a32) - a12 * (a21 * a33 - a23 * a31) + a13 * (a21 * a32 - a22 * a31) as det from b_atoms a join b_lattices l on a.struct_id = l.struct_id),
  r as (select struct_id, atom_idx, number, (x * (a22 * a33 - a23 * a32) + y * (a23 * a31 - a21 * a33) + z * (a21 * a32 - a22 * a31)) / det as fx, (x * (a13 * a32 - a12 * a33) + y * (a11 * a33 - a13 * a31) + z * (a12 * a31 - a11 * a32)) / det as fy,
  (x * (a12 * a23 - a13 * a22) + y * (a13 * a21 - a11 * a23) + z * (a11 * a22 - a12 * a21)) / det as fz from f)"""


@query("g2_fractional", FRACTIONS + " select struct_id, atom_idx, number, round(fx + 1e-9, 5) + 0.0 as fx, round(fy + 1e-9, 5) + 0.0 as fy, round(fz + 1e-9, 5) + 0.0 as fz from r")
def _(t):
    return G.fractional(t.b_atoms, t.b_lattices).select("struct_id", "atom_idx", "number", *((F.round(F.col(c) + 1e-9, 5) + 0.0).alias(c) for c in ("fx", "fy", "fz")))


BANDS_SQL = "select vec_id as run_id, list_transform(generate_series(0, 3), lambda b: list_transform(generate_series(1, 16), lambda k: cast(embedding[b * 16 + k] as double) + [-0.6, -0.2, 0.25, 0.6][b + 1])) as s, list_transform(generate_series(0, 15), lambda k: k // 2) as x from embeddings"


def _bands(t) -> DataFrame:
    move = F.array(*(F.lit(x) for x in (-0.6, -0.2, 0.25, 0.6)))
    e = F.col("embedding").cast("array<double>")
    stripes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.transform(F.slice(e, b * 16 + 1, F.lit(16)), lambda x: x + move[b]))
    return t.embeddings.select(F.col("vec_id").alias("run_id"), stripes.alias("stripes"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.floor(k / 2).cast("double")).alias("abscissa"))


CONDUCTS = f"select run_id, len(list_filter(generate_series(1, 4), lambda i: list_min(s[i]) < 0 and list_max(s[i]) > 0 and len(list_filter(generate_series(1, i), lambda j: list_min(s[j]) > 0)) = 0)) > 0 as conductor from ({BANDS_SQL}) b"


@query("g5_is_conductor", CONDUCTS)
def _(t):
    return _bands(t).select("run_id", SP.is_conductor(F.col("stripes")).alias("conductor"))


GAPS = f"""select run_id, case when n is null or gap > 50 then null else round(greatest(gap, 0.0), 4) end as gap, case when n is null or gap > 50 or gap <= 0 then null else x[list_position(s[n + 1], list_min(s[n + 1]))] = x[list_position(s[n], list_max(s[n]))] end as direct,
  case when n is null then 'no bands above zero found' when gap > 50 then 'unphysical band gap' end as error
  from (select run_id, s, x, n, list_min(s[n + 1]) - list_max(s[n]) as gap from (select run_id, s, x, list_filter([1, 2, 3], lambda i: list_min(s[i + 1]) > 0)[1] as n from ({BANDS_SQL}) b) c) d"""


@query("g6_band_gap", GAPS)
def _(t):
    return SP.band_gap(_bands(t))


@query("g8_electronic_type", f"""select g.run_id, case when conductor then 2 when g.gap is not null then 1 else 0 end as etype, case when conductor then 0.0 else round(g.gap, 2) end as gap, case when conductor then 1 when g.gap is null then 0 when g.gap = 0 then 1 when g.direct then 2 else 3 end as bandgaptype
  from ({GAPS}) g join ({CONDUCTS}) h on g.run_id = h.run_id""")
def _(t):
    bands = _bands(t)
    both = SP.band_gap(bands).join(bands.select("run_id", SP.is_conductor(F.col("stripes")).alias("c")), "run_id")
    return both.select("run_id", SP.electronic_type(F.col("c"), F.col("gap"), F.col("direct")).alias("x")).select("run_id", "x.*")


@query("w7_band_path", """select run_id, k_idx, round(sum(s) over (partition by run_id order by k_idx rows unbounded preceding), 6) as d from (select user_id as run_id, event_id as k_idx,
  case when lag(value) over w is null then 0.0 else sqrt(pow(value + lag(value) over w, 2)) end as s from events window w as (partition by user_id order by event_id)) x""")
def _(t):
    return SP.band_path(t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("k_idx"), F.col("value").alias("kx"), F.lit(0.0).alias("ky"), F.lit(0.0).alias("kz")))


BROWSE = "select checksum, chemical_formula, location from b_struct_ratios join b_metadata using (checksum) where checksum in (select checksum from b_tags where tid in (3, 5) group by 1 having count(distinct tid) = 2) and checksum in (select checksum from b_electrons where gap between 0 and 6)"


def _browse(t):
    runs = t.b_struct_ratios.join(t.b_metadata, "checksum").select("checksum", "chemical_formula", "location")
    return R.browse(runs, t.b_tags, [3, 5], {"electrons": t.b_electrons}, [("electrons", "gap", 0, 6)], sort=0, page=1, size=50)


@query("o1_browse", BROWSE + " order by chemical_formula, checksum limit 50 offset 50")
def _(t):
    return _browse(t)[0]


@query("o1_browse_count", f"select count(*) as count from ({BROWSE}) b")
def _(t):
    return _browse(t)[1]


@query("s1_make_tags", "select distinct checksum, 1 as cid, chemical_formula as topic from b_struct_ratios union select checksum, 3, cast(nelem as varchar) from b_struct_ratios union select checksum, 1006, cast(finished as varchar) from b_metadata")
def _(t):
    runs = t.b_struct_ratios.join(t.b_metadata, "checksum").select("checksum", F.col("chemical_formula").alias("standard"), "nelem", "finished")
    return FA.make_tags(runs, FACETS)


@query("s2_upsert_dimension", "select cid, topic from b_topics")
def _(t):
    known = t.b_topics.where("cid = 22").select("tid", "cid", "topic")
    out = FA.upsert_dimension(known, t.b_raw_tags.select("cid", "topic"), ["cid", "topic"], "tid")
    single = out.groupBy("tid").agg(F.count("*").alias("n")).where("n = 1").select("tid")
    return out.join(single, "tid", "left_semi").select("cid", "topic")


OWN = "select tid from b_topics where cid = 22"


@query("s3_replace_topics", f"select checksum, tid from b_tags where not (tid in ({OWN}) and checksum in (select checksum from b_electrons where gap > 7)) union select e.checksum, t.tid from b_electrons e, b_topics t where e.gap > 7 and t.cid = 22 and t.topic = '1'")
def _(t):
    return FA.replace_topics(t.b_tags, t.b_topics, t.b_electrons.where("gap > 7").select("checksum"), 22, ["1"])


@query("s4_append_topics", "select checksum, tid from b_tags union select e.checksum, t.tid from b_electrons e, b_topics t where e.gap > 7 and t.cid = 2 and t.topic in ('Sr', 'Ti')")
def _(t):
    return FA.append_topics(t.b_tags, t.b_topics, t.b_electrons.where("gap > 7").select("checksum"), 2, ["Sr", "Ti"])


@query("s5_dedupe_new", "select checksum from b_metadata where checksum not in (select checksum from b_electrons)")
def _(t):
    return FA.dedupe_new(t.b_metadata.select("checksum"), t.b_electrons)


@query("s6_purge", "select checksum, tid from b_tags where checksum not in (select checksum from b_electrons where gap > 7)")
def _(t):
    return MT.purge({"tags": t.b_tags}, t.b_electrons.where("gap > 7").select("checksum"))["tags"].select("checksum", "tid")


CLOSURE = """with recursive up as (select children_checksum as node, parent_checksum as ancestor, 1 as distance from b_calcsets union all select u.node, c.parent_checksum, u.distance + 1 from up u join b_calcsets c on c.children_checksum = u.ancestor)"""


@query("s9_ancestors", CLOSURE + " select node, ancestor, min(distance) as distance from up group by 1, 2")
def _(t):
    return MT.ancestors(t.b_calcsets)


@query("s7_purge_dataset", CLOSURE + """, s as (select distinct checksum from (select children_checksum as checksum from b_calcsets union select parent_checksum from b_calcsets) a), k as (select checksum from s where length(checksum) = 4),
  g as (select parent_checksum as checksum, count(*) as n, count(*) filter (where length(children_checksum) = 4) as fewer from b_calcsets group by 1)
  select s.checksum, cast(10 - coalesce((select count(*) * 10 from (select distinct node from up where ancestor = s.checksum and node in (select checksum from k)) d), 0) as bigint) as download_size, coalesce(g.n - g.fewer, 0) as siblings_count, coalesce(g.n = g.fewer and g.fewer > 0, false) as refused
  from s left join g using (checksum) where s.checksum not in (select checksum from k)""")
def _(t):
    sizes = t.b_calcsets.select(F.col("children_checksum").alias("checksum")).union(t.b_calcsets.select("parent_checksum")).distinct().withColumn("download_size", F.lit(10).cast("long"))
    return MT.purge_dataset(sizes, t.b_calcsets, sizes.where("length(checksum) = 4").select("checksum"))


@query("src1_scan_files", "select path from b_files where not path like 'f1%' and not path like '%.bak'")
def _(t):
    return t.b_files.where(SF.unskipped(F.col("path"), [".bak"]) & ~F.col("path").startswith("f1")).select("path")


@query("src4_split_text_binary", r"select path, regexp_matches(substring(text, 1, 2048), '[^\x00-\x7F]') as is_binary from b_files")
def _(t):
    return t.b_files.select("path", SF.is_binary(F.col("text")).alias("is_binary"))


@query("src5_detect_format", r"""select path, min_by(case when l like '%license%' then 'license' when l like '%rights%' then 'rights' end, i) filter (where l like '%license%' or l like '%rights%') as format
  from (select path, text, n_chars, unnest(string_split(text, chr(10))[1:701]) as l, generate_subscripts(string_split(text, chr(10))[1:701], 1) as i from b_files) x group by path, text, n_chars""")
def _(t):
    return t.b_files.select("path", SF.detect_format(F.col("text"), {"license": ["license"], "rights": ["rights"]}).alias("format"))


@query("src8_attach_related_files", r"""with f as (select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, regexp_extract(path, '([^/.]*)(\.[^/.]*)$', 1) as stem, regexp_extract(path, '(\.[^/.]*)$', 1) as ext from b_files),
  i as (select folder, count(*) as n, min(path) as only_one from f where ext in ('.in', '.inp', '.input') group by 1), o as (select folder, stem, min(path) as own from f where ext = '.in' group by 1, 2)
  select f.path, coalesce(o.own, case when i.n = 1 then i.only_one end) as input, case when coalesce(o.own, case when i.n = 1 then i.only_one end) is not null then null when coalesce(i.n, 0) = 0 then 'no input file' else 'several input files' end as warning
  from f left join o on o.folder = f.folder and o.stem = f.stem left join i on i.folder = f.folder where f.ext = '.out'""")
def _(t):
    return SF.attach_inputs(t.b_files)


@query("src6_parse_runs", """select 'runs/C' || o_orderkey || '.out' as path, (o_orderkey % 6) || '.1' as version, round(-(floor(o_totalprice) + 0.5) * 13.605693, 2) as energy, case o_custkey % 3 when 2 then 'mine' else 'PBE' end as h, case o_custkey % 3 when 2 then '' else '2' end as types,
  case when o_orderstatus = 'F' then 2 else 1 end as finished, case when o_orderstatus = 'F' then round((o_orderkey % 60) / 60.0, 2) end as hours, cast(null as varchar) as error from orders""")
def _(t):
    runs = SF.parse_runs(t.b_logs)
    return runs.select("path", "version", F.round("energy", 2).alias("energy"), F.col("H").alias("h"), F.array_join("xc_types", ",").alias("types"), "finished", "hours", "error")


@query("h1_html_formula", r"select checksum, regexp_replace(chemical_formula, '([0-9.\-][0-9.\-d]*)', '<sub>\1</sub>', 'g') as html from b_struct_ratios")
def _(t):
    return t.b_struct_ratios.select("checksum", S.html_formula(F.col("chemical_formula")).alias("html"))


@query("h2_extract_symbols", "select checksum, array_to_string(regexp_extract_all(regexp_extract(chemical_formula, '^[^ :]*'), '[A-Z][a-z]*'), ',') as symbols from b_struct_ratios")
def _(t):
    return t.b_struct_ratios.select("checksum", F.array_join(S.chemical_symbols(F.col("chemical_formula")), ",").alias("symbols"))


@query("h3_parse_formula", "select checksum, array_to_string(list_transform(regexp_extract_all(chemical_formula, '[A-Z][a-z]?[0-9]*'), lambda x: regexp_extract(x, '[A-Za-z]+') || '=' || coalesce(nullif(regexp_extract(x, '[0-9]+'), ''), '1')), ',') as parts from b_struct_ratios")
def _(t):
    return t.b_struct_ratios.select("checksum", F.array_join(F.transform(S.parse_formula(F.col("chemical_formula")), lambda x: F.concat_ws("=", x["element"], x["count"])), ",").alias("parts"))


@query("h4_standard_formula", f"select struct_id, formula from ({COMPOSED}) c")
def _(t):
    named = t.b_atoms.join(F.broadcast(elements(t.spark)), "number").groupBy("struct_id").agg(F.collect_list("symbol").alias("symbols"))
    return named.select("struct_id", S.standard_formula(F.col("symbols")).alias("formula"))


@query("h5_reduced_formula", f"""with c as (select a.struct_id, e.symbol, e.place, count(*) as n from b_atoms a join {ELEMENT_ROWS} on e.number = a.number group by 1, 2, 3), g as (select struct_id, case when count(*) = 1 then 1 else list_reduce(list(n), lambda a, b: gcd(a, b)) end as g from c group by 1)
  select struct_id, string_agg(symbol || case when n = g then '' else cast(n // g as varchar) end, '' order by place, symbol) as reduced from c join g using (struct_id) group by 1""")
def _(t):
    return G.composition(t.b_atoms, elements(t.spark)).select("struct_id", S.reduced_formula(S.parse_formula(F.col("formula"))).alias("reduced"))


@query("h6_nelem", "select struct_id, least(cast(count(distinct number) as int), 13) as nelem, count(*) as natom from b_atoms group by 1")
def _(t):
    return t.b_atoms.groupBy("struct_id").agg(F.least(F.countDistinct("number").cast("int"), F.lit(13)).alias("nelem"), F.count("*").alias("natom"))


@query("h7_surrogate_key", "select checksum, md5(checksum || '|' || location) as key from b_metadata")
def _(t):
    return t.b_metadata.select("checksum", F.md5(F.concat_ws("|", "checksum", "location")).alias("key"))


@query("h8_file_md5", "select path, md5(text) || 'PDF' as key from b_files")
def _(t):
    return t.b_files.select("path", SF.article_key(F.col("text")).alias("key"))


@query("h9_url_is_valid", "select page_id, regexp_matches(url, '^(https?|ftp)://[a-z0-9.-]+(/[^ ]*)?$') as ok from pages")
def _(t):
    return t.pages.select("page_id", S.url_is_valid(F.col("url")).alias("ok"))


@query("h10_human_size", "select checksum, case when download_size < 1024 then printf('%.1fbytes', download_size / 1.0) when download_size < 1048576 then printf('%.1fKB', download_size / 1024.0) else printf('%.1fMB', download_size / 1048576.0) end as size from b_metadata")
def _(t):
    return t.b_metadata.select("checksum", S.human_size(F.col("download_size")).alias("size"))


@query("h11_direction", "select vec_id, cast(sign(p1) as int) as a, cast(sign(p2) as int) as b from b_points")
def _(t):
    d = S.direction(F.array("p1", "p2"))
    return t.b_points.select("vec_id", d[0].alias("a"), d[1].alias("b"))


@query("h12_markup_to_html", "select p_partkey, 'E<sub>' || p_name || '</sub><sup>2</sup>' as html from part")
def _(t):
    return t.part.select("p_partkey", S.markup_to_html(F.concat(F.lit("E,,"), "p_name", F.lit("__^^2**"))).alias("html"))


@query("h13_html_entities", "select page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as h from pages")
def _(t):
    return t.pages.select("page_id", F.md5(S.html_entities(F.col("html"))).alias("h"))


@query("h14_periodic_group", "select distinct number, case number when 1 then 1 when 6 then 14 when 8 then 16 when 12 then 2 when 22 then 4 when 26 then 8 when 38 then 2 when 57 then 3 end as grp from b_atoms")
def _(t):
    return t.b_atoms.select("number", S.periodic_group(F.col("number")).alias("grp")).distinct()


@query("h15_frac_to_float", "select p_partkey, round(1.0::double / p_partkey, 9) as v from part where p_partkey > 0")
def _(t):
    return t.part.where("p_partkey > 0").select("p_partkey", F.round(S.frac_to_float(F.concat(F.lit("1/"), F.col("p_partkey").cast("string"))), 9).alias("v"))


@query("h16_duration_hours", "select p_partkey, round((p_partkey % 5) * 24 + p_partkey % 24 + cast(p_partkey % 60 as double) / 60, 2) as hours from part")
def _(t):
    n = lambda k: (F.col("p_partkey") % k).cast("string")
    return t.part.select("p_partkey", S.duration_hours(F.concat(n(5), F.lit("d"), n(24), F.lit("h"), n(60), F.lit("m"))).alias("hours"))


@query("h17_to_ev", "select checksum, round(total * 13.605693, 6) as ev from b_energies")
def _(t):
    return t.b_energies.select("checksum", F.round(S.to_ev(F.col("total"), F.lit("Ry")), 6).alias("ev"))


@query("h18_calctypes", "select checksum, array_to_string(list_filter([case when charged then 4 end, 1], lambda x: x is not null), ',') as codes from (select s.checksum, bool_or(a.charge <> 0) as charged from b_structures s join b_atoms a using (struct_id) where s.final group by 1) c")
def _(t):
    flags = t.b_structures.where("final").join(t.b_atoms, "struct_id").groupBy("checksum").agg(F.bool_or(F.col("charge") != 0).alias("charged"))
    return flags.select("checksum", F.array_join(S.calctypes({4: F.col("charged"), 1: F.lit(True)}), ",").alias("codes"))


@query("h19_periodicity_code", "select checksum, case when n % 5 = 0 then 4 else n % 5 end as code, case when n % 2 = 0 then 2 else 1 end as spin from b_spacegroups")
def _(t):
    return t.b_spacegroups.select("checksum", S.periodicity_code(F.col("n") % 5).alias("code"), S.spin_code(F.col("n") % 2 == 0).alias("spin"))


@query("h20_space_group_label", "select checksum, n || ' &mdash; ' || 'P1' as label from b_spacegroups")
def _(t):
    return t.b_spacegroups.select("checksum", S.space_group_label(F.col("n"), F.lit("P1")).alias("label"))


@query("h21_xc_validate", "select checksum, n <= 7 as ok from b_spacegroups")
def _(t):
    return t.b_spacegroups.select("checksum", S.xc_is_valid(F.array("n")).alias("ok"))


@query("h23_bit_signature", "select checksum, cast(pow(2, n % 10) + pow(2, n % 7 + 10) as bigint) as sig from b_spacegroups")
def _(t):
    return t.b_spacegroups.select("checksum", S.bit_signature(F.array(F.col("n") % 10, F.col("n") % 7 + 10)).alias("sig"))


@query("h25_hybrid_label", "select checksum, case n % 4 when 0 then 'PBE0' when 1 then 'PBE' when 2 then 'HSE06' else 'HSE06 0.30' end as label from b_spacegroups")
def _(t):
    screen = F.when(F.col("n") % 4 == 0, 0.0).when(F.col("n") % 4 == 2, 0.2).when(F.col("n") % 4 == 3, 0.3)
    return t.b_spacegroups.select("checksum", S.hybrid_label(screen).alias("label"))


@query("c1_effective_dimension", f"""with v as (select a.struct_id, sum(4.0 / 3 * 3.141592653589793 * pow(e.radius, 3)) as filled, count(*) as n from b_atoms a join {ELEMENT_ROWS} on e.number = a.number group by 1),
  c as (select l.struct_id, {DET} as v, sqrt(a11 * a11 + a12 * a12 + a13 * a13) as la, sqrt(a21 * a21 + a22 * a22 + a23 * a23) as lb, sqrt(a31 * a31 + a32 * a32 + a33 * a33) as lc from b_lattices l),
  m as (select c.struct_id, (c.v - v.filled) / v.n as vacuum, greatest(la, lb, lc) as big, list_filter([1, 2, 3], lambda i: i <> list_position([la, lb, lc], greatest(la, lb, lc)) and i <> list_position([la, lb, lc], least(la, lb, lc)))[1] as mid, [la, lb, lc] as ls from c join v using (struct_id))
  select struct_id, round(vacuum, 4) as vacuum, case when vacuum > 12 and ls[mid] * 3.9 < big then 2 when vacuum > 48 then 0 else 3 end as periodicity from m""")
def _(t):
    return G.effective_dimension(t.b_atoms, t.b_lattices, elements(t.spark))


@query("c2_is_perovskite", "select checksum, chemical_formula in ('SrTiO3', 'BaTiO3', 'LaFeO3') as perovskite from b_struct_ratios")
def _(t):
    return t.b_struct_ratios.select("checksum", G.is_perovskite(S.parse_formula(F.col("chemical_formula")), dict(zip(SYMBOLS, RADII, strict=True))).alias("perovskite"))


@query("c6_organic_molecule", "select checksum, chemical_formula = 'C2H6O' as organic from b_struct_ratios")
def _(t):
    return t.b_struct_ratios.select("checksum", G.is_organic(S.parse_formula(F.col("chemical_formula")), F.lit(0)).alias("organic"))


@query("c4_vacancy_defect", f"""with c as (select a.struct_id, e.symbol, e.place, count(*) as n from b_atoms a join {ELEMENT_ROWS} on e.number = a.number group by 1, 2, 3), l as (select struct_id, list(n order by place, symbol) as ns, list(symbol order by place, symbol) as es from c group by 1),
  t as (select struct_id, es[i] as element, k, i, list_reduce(list_transform(ns, lambda x, j: x + case when j = i then k else 0 end), lambda a, b: gcd(a, b)) as g, list_reduce(ns, lambda a, b: gcd(a, b)) as plain from (select *, unnest(generate_series(1, len(ns))) as i from l where len(ns) > 1) q, (values (1), (2)) v(k)),
  b as (select struct_id, any_value(plain) as plain, arg_max({{'gcd': g, 'element': element, 'added': k}}, g * 10000 - k * 1000 - i) as x from t group by 1)
  select f.struct_id, f.formula, case when x.gcd > plain then cast(x.gcd as int) end as gcd, case when x.gcd > plain then x.element end as element, case when x.gcd > plain then x.added end as added from ({COMPOSED}) f left join b on b.struct_id = f.struct_id""")
def _(t):
    return G.composition(t.b_atoms, elements(t.spark)).select("struct_id", "formula", G.vacancy_defect(S.parse_formula(F.col("formula"))).alias("x")).select("struct_id", "formula", "x.*")


@query("snk3_to_xyz", f"select struct_id, count(*) || chr(10) || 'XYZ' || chr(10) || string_agg(e.symbol || printf(' %.4f %.4f %.4f', x, y, z), chr(10) order by atom_idx) as xyz from b_atoms a join {ELEMENT_ROWS} on e.number = a.number group by 1")
def _(t):
    return G.to_xyz(t.b_atoms, elements(t.spark))


CIF_LOOP = "_symmetry_space_group_name_H-M 'P1'\nloop_\n_symmetry_equiv_pos_as_xyz\nx,y,z\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n".replace("'", "''")


@query("snk2_to_cif", FRACTIONS + f""", s as (select struct_id, string_agg(e.symbol || ' ' || e.symbol || printf(' % 1.8f % 1.8f % 1.8f', fx + 1e-10, fy + 1e-10, fz + 1e-10), chr(10) order by atom_idx) as sites from r join {ELEMENT_ROWS} on e.number = r.number group by 1)
  select s.struct_id, 'data_' || s.struct_id || printf(concat(chr(10), '_cell_length_a %.6f', chr(10), '_cell_length_b %.6f', chr(10), '_cell_length_c %.6f', chr(10), '_cell_angle_alpha %.6f', chr(10), '_cell_angle_beta %.6f', chr(10), '_cell_angle_gamma %.6f', chr(10)), c.a, c.b, c.c, c.alpha, c.beta, c.gamma)
  || '{CIF_LOOP}' || sites as cif from s join ({CELLS}) c on c.struct_id = s.struct_id""")
def _(t):
    return G.to_cif(t.b_atoms, t.b_lattices, elements(t.spark))


XC_TEXTS = ["PBE ( 1 4 3 4 0 0)", "SLA PW PBX PBC (1 4 3 4)", "'sla-pw' xx", "SLA+PW+HSE+PBE", "sla+pw+none+pbc"]


@query("j11_xc_lookup", "select p_partkey, case p_partkey % 5 when 0 then 'PBE' when 1 then 'PBE' when 2 then 'sla-pw''+xx' when 3 then 'HSE06' else 'sla+pw+none+pbc' end as name, case p_partkey % 5 when 0 then '2' when 1 then '2' when 3 then '2,4' else '' end as types from part")
def _(t):
    x = XC.xc_lookup(F.element_at(F.array(*map(F.lit, XC_TEXTS)), (F.col("p_partkey") % 5 + 1).cast("int")))
    return t.part.select("p_partkey", x.alias("x")).select("p_partkey", "x.name", F.array_join("x.types", ",").alias("types"))


@query("h7_run_key")
def _(t):
    runs = t.b_energies.select("checksum", F.col("total").alias("energy"), F.lit("prog").alias("prog"), F.lit(None).cast("string").alias("given"), F.array(F.lit(1)).alias("codes"))
    return K.run_keys(runs, t.b_structures, t.b_lattices, t.b_atoms)


@query("g11_tick_labels", "select name, case name when 'GAMMA' then '&#915;' else name end as label from (select case p_partkey % 3 when 0 then 'GAMMA' when 1 then 'X' else 'M' end as name from part) p")
def _(t):
    return t.part.select(F.element_at(F.array(F.lit("GAMMA"), F.lit("X"), F.lit("M")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("name")).select("name", SP.tick_label(F.col("name")).alias("label"))


@query("g11_spectra_points", "select vec_id as run_id, s.k as series, cast(i - 1 as int) as i, cast(i - 1 as double) as x, cast(embedding[i + s.o] as double) as y from embeddings, (values ('total', 0), ('part', 32)) s(k, o), generate_series(1, 32) as g(i)")
def _(t):
    e = F.col("embedding").cast("array<double>")
    x = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: i.cast("double"))
    return SP.spectra_points(t.embeddings.select(F.col("vec_id").alias("run_id"), x.alias("x"), F.create_map(F.lit("total"), F.slice(e, 1, 32), F.lit("part"), F.slice(e, 33, 32)).alias("values")))


@query("g12_phonon_listing", """select vec_id as run_id, s.k as kpoint, cast(i - 1 as int) as mode, cast(embedding[i + s.o] as double) as frequency, case when s.o = 0 and i = 1 then 'A1' else '?' end as irrep,
  case when s.o = 0 then i % 2 = 1 end as ir, case when s.o = 0 then i % 2 = 0 end as raman from embeddings, (values ('0 0 0', 0), ('1 0 0', 8)) s(k, o), generate_series(1, 8) as g(i)""")
def _(t):
    e = F.col("embedding").cast("array<double>")
    flags = lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i % 2 == r)
    modes, irreps = F.create_map(F.lit("0 0 0"), F.slice(e, 1, 8), F.lit("1 0 0"), F.slice(e, 9, 8)), F.create_map(F.lit("0 0 0"), F.array(F.lit("A1")))
    return SP.phonon_listing(t.embeddings.select(F.col("vec_id").alias("run_id"), modes.alias("modes"), irreps.alias("irreps"), flags(0).alias("ir_active"), flags(1).alias("raman_active")))


@query("c5_isolated_atom", f"select c.struct_id, natom = 1 and v / r > 100 as isolated from (select a.struct_id, count(*) as natom, min(e.radius) as r from b_atoms a join {ELEMENT_ROWS} on e.number = a.number group by 1) c join (select struct_id, {DET} as v from b_lattices) l using (struct_id)")
def _(t):
    named = t.b_atoms.join(F.broadcast(elements(t.spark)), "number").groupBy("struct_id").agg(F.collect_list("symbol").alias("symbols"), F.min("radius").alias("radius"))
    cells = t.b_lattices.select("struct_id", G.volume().alias("v"))
    alone = G.is_isolated(S.parse_formula(S.standard_formula(F.col("symbols"))), F.lit(3), F.col("v"), F.col("radius"))
    return named.join(cells, "struct_id").select("struct_id", alone.alias("isolated"))
