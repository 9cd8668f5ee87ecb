"""Views that shape general tables into those of a run repository; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.facets import distinct_tags

TABLES = "customer supplier part orders lineitem events documents embeddings pages".split()

#: {i} stands for the SQL of an array's (i + 1)-th entry.
VIEWS = {
    "b_metadata": """select concat('C', cast(o_orderkey as string)) as checksum,
        concat('runs/', lower(substring(o_orderpriority, 3, 20)), '/C', cast(o_orderkey as string), '.out') as location,
        case o_orderstatus when 'F' then 2 when 'O' then 1 else 0 end as finished, o_orderdate as added, cast(floor(o_totalprice) as bigint) as download_size from orders""",
    "b_energies": "select concat('C', cast(o_orderkey as string)) as checksum, case when o_orderkey % 11 = 0 then null else -o_totalprice / 1000 end as total from orders",
    "b_electrons": """select concat('C', cast(o_orderkey as string)) as checksum,
        case when o_orderkey % 5 = 0 then cast(0 as double) else cast(o_orderkey * 37 % 800 as double) / 100 end as gap from orders where o_orderkey % 3 <> 0""",
    "b_struct_ratios": """select concat('C', cast(o_orderkey as string)) as checksum,
        case o_custkey % 6 when 0 then 'SrTiO3' when 1 then 'MgO' when 2 then 'BaTiO3' when 3 then 'Si16' when 4 then 'C2H6O' else 'LaFeO3' end as chemical_formula,
        cast(o_orderkey % 4 + 1 as int) as formula_units, case o_custkey % 6 when 3 then 1 when 1 then 2 else 3 end as nelem from orders""",
    "b_spacegroups": "select concat('C', cast(o_orderkey as string)) as checksum, cast(o_orderkey * 13 % 230 + 1 as int) as n from orders",
    "b_basissets": "select concat('C', cast(o_orderkey as string)) as checksum, cast(o_orderkey % 5 as int) as kind from orders",
    "b_structures": """select o_orderkey * 2 + s.step as struct_id, concat('C', cast(o_orderkey as string)) as checksum, s.step, s.step = 1 as final
        from orders cross join (select 0 as step union all select 1 as step) s""",
    "b_lattices": """select o_orderkey * 2 + s.step as struct_id,
        cast(3 + o_orderkey % 7 as double) + cast(s.step as double) / 10 as a11, cast(0 as double) as a12, cast(0 as double) as a13,
        cast(o_orderkey % 3 as double) / 10 as a21, cast(4 + o_orderkey % 5 as double) as a22, cast(0 as double) as a23,
        cast(0 as double) as a31, cast(o_orderkey % 2 as double) / 10 as a32, cast(5 + o_orderkey % 30 as double) as a33
        from orders cross join (select 0 as step union all select 1 as step) s""",
    "b_atoms": """select l_orderkey * 2 + s.step as struct_id,
        cast(row_number() over (partition by l_orderkey, s.step order by l_partkey, l_suppkey, l_linenumber) as int) as atom_idx,
        case l_partkey % 10 when 0 then 38 when 1 then 22 when 2 then 8 when 3 then 8 when 4 then 8 when 5 then 1 when 6 then 6 when 7 then 26 when 8 then 57 else 12 end as number,
        l_quantity / 10 + cast(s.step * l_linenumber as double) / 100 as x, l_discount * 50 as y,
        cast(cast(floor(l_extendedprice) as bigint) % 997 as double) / 100 as z, case when l_tax = 0 then null else l_tax end as charge
        from lineitem cross join (select 0 as step union all select 1 as step) s""",
    "b_series": "select user_id as run_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as step, value from events",
    "b_grid": """select concat('C', cast(o_orderkey as string)) as checksum,
        concat('{"ng":', cast(o_orderkey * 13 % 230 + 1 as string), ',"ansatz":', cast(o_orderkey % 5 as string), case when o_orderkey % 7 = 0 then '' else concat(',"framework":', cast(o_orderkey % 5 as string)) end, '}') as info from orders""",
    "b_calcsets": """select concat('D', cast(cast(floor(p_partkey / 10) as bigint) as string)) as parent_checksum, concat('D', cast(p_partkey as string)) as children_checksum from part where p_partkey >= 10""",
    "b_raw_tags": """select concat('C', cast(o_orderkey as string)) as checksum, 22 as cid, cast(o_orderkey % 5 as string) as topic from orders
        union all select concat('C', cast(o_orderkey as string)), 80, cast(o_orderkey % 5 as string) from orders
        union all select concat('C', cast(o_orderkey as string)), 1006, o_orderstatus from orders
        union all select distinct concat('C', cast(l_orderkey as string)), 2, case l_partkey % 10 when 0 then 'Sr' when 1 then 'Ti' when 2 then 'O' when 3 then 'O' when 4 then 'O' when 5 then 'H' when 6 then 'C' when 7 then 'Fe' when 8 then 'La' else 'Mg' end from lineitem""",
    "b_topics": "select cast(row_number() over (order by cid, topic) as int) as tid, cid, topic from (select distinct cid, topic from b_raw_tags) t",
    "b_tags": "select r.checksum, t.tid from (select distinct checksum, cid, topic from b_raw_tags) r join b_topics t on r.cid = t.cid and r.topic = t.topic",
    "b_points": "select vec_id, cast({0} as double) as p1, cast({1} as double) as p2, cast({2} as double) as p3, label from embeddings",
    "b_logs": """select concat('runs/C', cast(o_orderkey as string), '.out') as path, concat('     Program PWSCF v.', cast(o_orderkey % 6 as string), '.1 starts on 1Jan2014', chr(10),
        '     Exchange-correlation      =  ', case o_custkey % 3 when 0 then 'PBE ( 1 4 3 4 0 0)' when 1 then 'SLA PW PBX PBC (1 4 3 4)' else 'MINE' end, chr(10),
        '!    total energy              =     -', cast(cast(floor(o_totalprice) as bigint) as string), '.5 Ry', chr(10),
        case when o_orderstatus = 'F' then concat('     PWSCF        :   ', cast(o_orderkey % 50 as string), 'm 1.00s CPU     ', cast(o_orderkey % 60 as string), 'm WALL', chr(10)) else '' end) as text from orders""",
    "b_files": """select concat('f', cast(cast(floor(doc_id / 5) as bigint) as string), '/r', cast(cast(floor(doc_id / 2) as bigint) as string),
        case doc_id % 7 when 0 then '.out' when 1 then '.d12' when 2 then '.in' when 3 then '.out' when 4 then '.gui' when 5 then '.inp' else '.bak' end) as path, text, n_chars from documents""",
}


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\bb_[a-z_]+\b", sql):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found.append(name)
    return found


def entry_sql(i: int, engine: str) -> str:
    return f"element_at(embedding, {i + 1})" if engine == "spark" else f"embedding[{i + 1}]"


def with_views(sql: str, engine: str = "duckdb") -> str:
    """sql with the views that it uses as common table expressions in front."""
    text = lambda v: re.sub(r"\{(\d)\}", lambda m: entry_sql(int(m[1]), engine), VIEWS[v])
    parts = [f"{v} as ({text(v)})" for v in _needed(sql, [])]
    body = sql.strip()
    if not parts:
        return body
    if body[:5].lower() == "with ":
        rest = body[5:]
        recursive = rest[:10].lower() == "recursive "
        return f"with {'recursive ' * recursive}{', '.join(parts)}, {rest[10:] if recursive else rest}"
    return f"with {', '.join(parts)} {body}"


def _atoms(lineitem: DataFrame) -> DataFrame:
    """The view b_atoms, numbered by struct_id, which tells order and step: what follows by structure needs no further shuffle."""
    rows = lineitem.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (F.col("l_orderkey") * 2 + F.col("step")).alias("struct_id"), "l_partkey", "l_suppkey", "l_linenumber",
        *(F.expr(v).alias(k) for k, v in {
            "x": "l_quantity / 10 + cast(step * l_linenumber as double) / 100", "y": "l_discount * 50", "z": "cast(cast(floor(l_extendedprice) as bigint) % 997 as double) / 100", "charge": "case when l_tax = 0 then null else l_tax end"}.items()))
    idx = F.row_number().over(Window.partitionBy("struct_id").orderBy("l_partkey", "l_suppkey", "l_linenumber"))
    number = F.expr("case l_partkey % 10 when 0 then 38 when 1 then 22 when 2 then 8 when 3 then 8 when 4 then 8 when 5 then 1 when 6 then 6 when 7 then 26 when 8 then 57 else 12 end")
    return rows.select("struct_id", idx.alias("atom_idx"), number.alias("number"), "x", "y", "z", "charge")


def _raw(orders: DataFrame, lineitem: DataFrame, *key: str) -> DataFrame:
    """The rows of the view b_raw_tags, some more than once; with or without the run's checksum."""
    checksum = lambda c: [F.expr(f"concat('C', cast({c} as string))").alias("checksum")] if key else []
    told = F.explode(F.expr("array(struct(22 as cid, cast(o_orderkey % 5 as string) as topic), struct(80 as cid, cast(o_orderkey % 5 as string) as topic), struct(1006 as cid, o_orderstatus as topic))")).alias("x")
    symbol = F.expr("case l_partkey % 10 when 0 then 'Sr' when 1 then 'Ti' when 2 then 'O' when 3 then 'O' when 4 then 'O' when 5 then 'H' when 6 then 'C' when 7 then 'Fe' when 8 then 'La' else 'Mg' end").alias("topic")
    return orders.select(*checksum("o_orderkey"), told).select(*key, "x.*").unionByName(lineitem.select(*checksum("l_orderkey"), F.lit(2).alias("cid"), symbol))


def _topics(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The view b_topics: topics are found without the tags of single runs."""
    number = F.row_number().over(Window.orderBy("cid", "topic")).cast("int")
    return _raw(orders, lineitem).distinct().select(number.alias("tid"), "cid", "topic")


def _tags(orders: DataFrame, lineitem: DataFrame, topics: DataFrame) -> DataFrame:
    """The view b_tags: the bindings have some twenty topics, so no topic's rows have to meet in one task.

    Tags are dealt by run, which serves what follows by run, and sorted there: no task holds the
    keys of its part of a file in a hash table before.
    """
    return distinct_tags(_raw(orders, lineitem, "checksum").join(F.broadcast(topics), ["cid", "topic"]))


#: Views that Spark builds in a cheaper way, with the same rows.
BUILT = {"b_atoms": (_atoms, ["lineitem"]), "b_topics": (_topics, ["orders", "lineitem"]), "b_tags": (_tags, ["orders", "lineitem", "b_topics"])}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view over them, read lazily and pruned by Spark."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in BUILT:
        build, used = BUILT[name]
        return build(*(table(spark, sf_dir, u) for u in used))
    sql = with_views(f"select * from {name}", "spark")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    return spark.sql(_bound(sql, used), **{f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def _bound(sql: str, used: list[str]) -> str:
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{t_{t}}} {t}", sql)
    return sql
