"""Names and types of exchange-correlation functionals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import functional_family

# Short name, name, type codes, set-ups.
FUNCTIONALS = [
    ("pw", "PW_LDA", [1], ["sla+pw+nogx+nogc"]),
    ("pz", "PZ_LDA", [1], ["sla+pz+nogx+nogc"]),
    ("bp", "Becke-Perdew grad.corr.", [2], ["b88+p86+nogx+nogc"]),
    ("pw91", "PW91", [2], ["sla+pw+ggx+ggc"]),
    ("blyp", "BLYP", [2], ["sla+b88+lyp+blyp"]),
    ("pbe", "PBE", [2], ["sla+pw+pbx+pbc", "sla+pw+pbe+pbe"]),
    ("revpbe", "revPBE", [2], ["sla+pw+rpb+pbc", "sla+pw+rpb+pbe"]),
    ("pw86pbe", "PW86+PBE", [2], ["sla+pw+pw86+pbc", "sla+pw+pw86+pbe"]),
    ("b86bpbe", "B86b+PBE", [2], ["sla+pw+b86b+pbc", "sla+pw+b86b+pbe"]),
    ("pbesol", "PBEsol", [2], ["sla+pw+psx+psc"]),
    ("q2d", "PBEQ2D", [2], ["sla+pw+q2dx+q2dc"]),
    ("hcth", "HCTH/120", [2], ["nox+noc+hcth+hcth"]),
    ("olyp", "OLYP", [2], ["nox+lyp+optx+blyp"]),
    ("wc", "Wu-Cohen", [2], ["sla+pw+wcx+pbc", "sla+pw+wcx+pbe"]),
    ("sogga", "SOGGA", [2], ["sla+pw+sox+pbc", "sla+pw+sox+pbe"]),
    ("optbk88", "optB88", [2], ["sla+pw+obk8+p86"]),
    ("optb86b", "optB86", [2], ["sla+pw+ob86+p86"]),
    ("ev93", "Engel-Vosko", [2], ["sla+pw+evx+nogc"]),
    ("tpss", "TPSS", [3], ["sla+pw+tpss+tpss"]),
    ("m06l", "M06L", [3], ["nox+noc+m6lx+m6lc"]),
    ("tb09", "TB09", [3], ["sla+pw+tb09+tb09"]),
    ("pbe0", "PBE0", [2, 4], ["pb0x+pw+pb0x+pbc", "pb0x+pw+pb0x+pbe"]),
    ("hse", "HSE06", [2, 4], ["sla+pw+hse+pbc", "sla+pw+hse+pbe"]),
    ("b3lyp", "B3LYP", [2, 4], ["b3lp+vwn+b3lp+b3lp"]),
    ("gaupbe", "Gau-PBE", [2, 4], ["sla+pw+gaup+pbc", "sla+pw+gaup+pbe"]),
    ("vdw-df", "vdW-DF", [2, 7], ["sla+pw+rpb+vdw1"]),
    ("vdw-df2", "vdW-DF2", [2, 7], ["sla+pw+rw86+vdw2"]),
    ("vdw-df-c09", "vdW-DF-C09", [2, 7], ["sla+pw+c09x+vdw1"]),
    ("vdw-df2-c09", "vdW-DF2-C09", [2, 7], ["sla+pw+c09x+vdw2"]),
    ("vdw-df-cx", "vdW-DF-cx", [2, 7], ["sla+pw+cx13+vdW1"]),
    ("vdw-df-obk8", "vdW-DF-obk8", [2, 7], ["sla+pw+obk8+vdw1"]),
    ("vdw-df-ob86", "vdW-DF-ob86", [2, 7], ["sla+pw+ob86+vdw1"]),
    ("vdw-df2-b86r", "vdW-DF2-B86R", [2, 7], ["sla+pw+b86r+vdw2"]),
    ("rvv10", "rVV10", [2, 7], ["sla+pw+rw86+pbc+vv10", "sla+pw+rw86+pbe+vv10"]),
    ("hf", "Hartree-Fock", [5], ["hf+noc+nogx+nogc"]),
    ("vdw-df3", "vdW-DF3", [2, 7], ["sla+pw+rw86+vdw3"]),
    ("vdw-df4", "vdW-DF4", [2, 7], ["sla+pw+rw86+vdw4"]),
    ("gaup", "Gau-PBE", [2, 4], ["sla+pw+gaup+pbc", "sla+pw+gaup+pbe"]),
]


def _known() -> Column:
    """Short names and set-ups, to name and types; the first owner of a set-up keeps it.

    Texts are compared in lower case, so a set-up spelled with capitals is found too.
    """
    found: dict[str, Column] = {}
    for short, name, types, setups in FUNCTIONALS:
        value = F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, types)).alias("types"))
        for key in [short, *setups]:
            found.setdefault(key.lower(), value)
    return F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v)))


def xc_lookup(text: Column) -> Column:
    """(name, types) of a functional as logs print it; an unknown one keeps its own text and has no types.

    What stands before a bracket counts. Four or more words, or parts between + of one word, are
    a set-up, fewer a short name; case and surrounding dashes and quotes don't count. Null gives null.
    """
    clean = lambda x: F.regexp_replace(F.lower(x), "^[-'\"]+|[-'\"]+$", "")
    words = F.filter(F.split(F.trim(F.regexp_extract(text, r"^[^(]*", 0)), r"\s+"), lambda x: x != "")
    parts = F.when(F.size(words) == 1, F.split(words[0], r"\+")).otherwise(words)
    key = F.when(F.size(parts) < 4, clean(F.array_join(parts, "+"))).otherwise(F.array_join(F.transform(parts, clean), "+"))
    hit = F.try_element_at(_known(), key)
    return F.when(text.isNotNull(), F.struct(F.coalesce(hit["name"], key).alias("name"), F.coalesce(hit["types"], F.expr("cast(array() as array<int>)")).alias("types")))


def by_number(rows: DataFrame, number: str, names: DataFrame) -> DataFrame:
    """rows with name, comment and family of the functional that a column's number stands for.

    names (id, name, comment) is the table of a library of functionals, given by the user, as it
    comes in editions; of an id that it has twice, the smallest name counts. error says why there
    is no family: the number is unknown, or the name has no known prefix. A null number has none of all.
    """
    known = names.groupBy("id").agg(F.min(F.struct("name", "comment")).alias("of"))
    found = rows.join(known.withColumnRenamed("id", number), number, "left")
    family = functional_family(F.col("of.name"))
    error = F.when(F.col(number).isNull() | family.isNotNull(), None).when(F.col("of").isNull(), F.lit("unknown functional")).otherwise(F.concat(F.lit("unknown family of "), F.col("of.name")))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), F.col("of.name").alias("name"), F.col("of.comment").alias("comment"), family.alias("family"), error.alias("error"))
