"""Column functions over formulas, labels, units and symmetry numbers; null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..reference_data import CRYSTAL_SYSTEMS, ENUMS, FORMULA_ORDER, LAYER_GROUPS, LAYER_SYSTEMS, OBLIQUE_LAYER_GROUPS, POINT_GROUPS

RYDBERG_EV, HARTREE_EV = 13.605693, 27.211386


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once a row however often f names it: an expression in a lambda would be computed for each entry."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _literal(x) -> str:
    return f"'{x}'".replace("\\", "\\\\") if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x)


def fixed_map(pairs) -> Column:
    """A map of plain strings and numbers, as one expression instead of one for each entry: columns are made faster."""
    return F.expr(f"map({', '.join(_literal(x) for pair in pairs for x in pair)})")


def fixed_list(values) -> Column:
    """An array of plain strings or numbers, as one expression."""
    return F.expr(f"array({', '.join(map(_literal, values))})")


_map = fixed_map


def html_formula(s: Column) -> Column:
    """Digits, points and minus signs (and a d after them) as subscripts."""
    return F.regexp_replace(s, r"[0-9.\-][0-9.\-d]*", "<sub>$0</sub>")


def chemical_symbols(s: Column) -> Column:
    """Symbols in order, up to the first space or colon."""
    return F.regexp_extract_all(F.regexp_extract(s, r"^[^ :]*", 0), F.lit("[A-Z][a-z]*"), F.lit(0))


def parse_formula(s: Column) -> Column:
    """Array of (element, count); the count is 1 where it is missing, and X is skipped."""
    symbols = F.regexp_extract_all(s, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(1))
    counts = F.regexp_extract_all(s, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(2))
    count = lambda c: F.when(c == "", F.lit(1)).otherwise(c.cast("int"))
    pairs = F.zip_with(symbols, counts, lambda e, c: F.struct(e.alias("element"), count(c).alias("count")))
    return F.filter(pairs, lambda x: x["element"] != "X")


def formula_text(pairs: Column) -> Column:
    """Element-count pairs as a formula; a count of 1 is left out."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["element"], F.when(x["count"] == 1, F.lit("")).otherwise(x["count"].cast("string")))), "")


def standard_formula(symbols: Column) -> Column:
    """Formula of a list of labels: digits dropped, capitalised, in standard order, unknown ones last as first seen."""
    order = fixed_list(FORMULA_ORDER)

    def told(clean: Column) -> Column:
        place = lambda s, i: F.struct(F.when(F.array_position(order, s) > 0, F.array_position(order, s)).otherwise(F.lit(1000) + i).alias("place"), s.alias("element"), F.size(F.filter(clean, lambda t: t == s)).alias("count"))
        return formula_text(F.array_sort(F.transform(F.array_distinct(F.filter(clean, lambda s: s != "X")), place)))

    return let(F.transform(symbols, lambda s: F.initcap(F.regexp_replace(s, "[0-9]", ""))), told)


def counts_gcd(counts: Column) -> Column:
    """Greatest common divisor of an array of counts."""
    return let(counts, lambda own: F.filter(F.sequence(F.array_min(own), F.lit(1), F.lit(-1)), lambda g: F.forall(own, lambda c: c % g == 0))[0])


def reduced_formula(pairs: Column) -> Column:
    """Formula divided by its greatest common divisor; unaries stay."""
    g = F.when(F.size(pairs) == 1, F.lit(1)).otherwise(counts_gcd(F.transform(pairs, lambda x: x["count"])))
    return formula_text(F.transform(pairs, lambda x: F.struct(x["element"].alias("element"), (x["count"] / g).cast("int").alias("count"))))


def nelem(pairs: Column) -> Column:
    return F.least(F.size(pairs), F.lit(13))


URL = (r"(?i)^(https?|ftp)://(\S+(:\S*)?@)?(\d{1,3}(\.\d{1,3}){3}|\[[0-9a-f:.]+\]|localhost|([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,})(:\d{2,5})?(/\S*|[?#]\S*)?$")


def url_is_valid(s: Column) -> Column:
    return s.rlike(URL)


def human_size(n: Column) -> Column:
    """Bytes in steps of 1,024, one decimal."""
    out = None
    for power, unit in enumerate(("bytes", "KB", "MB", "GB", "TB")):
        text = F.format_string("%3.1f" + unit, F.bround(n / float(1024**power), 1))
        cond = n.cast("double") < 1024.0 ** (power + 1)
        out = F.when(cond, text) if out is None else (out.when(cond, text) if power < 4 else out.otherwise(text))
    return out


def direction(v: Column) -> Column:
    """Sign of each component."""
    return F.transform(v, lambda x: F.signum(x).cast("int"))


def markup_to_html(s: Column, units: bool = True) -> Column:
    """Marks of sub- and superscripts, and of an energy's unit, as HTML."""
    s = F.replace(s, F.lit("{{units-energy}}"), F.lit(", <span class=units-energy></span>" if units else ""))
    for a, b in ((",,", "<sub>"), ("__", "</sub>"), ("^^", "<sup>"), ("**", "</sup>")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_entities(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def periodic_group(z: Column) -> Column:
    """Group 1 to 18 of an atomic number; the f elements belong to group 3."""
    def tail(low):  # groups 3 to 18 of a long period
        return z - low + 1

    return (F.when(z == 1, F.lit(1)).when(z == 2, F.lit(18)).when(z <= 4, z - 2).when(z <= 10, z + 8).when(z <= 12, z - 10).when(z <= 18, z).when(z <= 36, tail(19)).when(z <= 54, tail(37))
            .when(z <= 56, tail(55)).when(z <= 71, F.lit(3)).when(z <= 86, z - 68).when(z <= 88, z - 86).when(z <= 103, F.lit(3)).otherwise(z - 100)).cast("int")


def frac_to_float(s: Column) -> Column:
    """'1/3' as 0.333; plain numbers pass."""
    parts = F.split(s, "/")
    return F.when(F.size(parts) == 2, parts[0].try_cast("double") / parts[1].try_cast("double")).otherwise(s.try_cast("double"))


def duration_hours(s: Column) -> Column:
    """Wall times like 1d2h13m4.5s in hours, two decimals."""
    part = lambda unit: F.coalesce(F.regexp_extract(s, r"([0-9.]+)\s*" + unit, 1).try_cast("double"), F.lit(0.0))
    return F.round(part("d") * 24 + part("h") + part("m") / 60 + part("s") / 3600, 2)


def to_ev(e: Column, unit: Column) -> Column:
    """Energies of the named unit in electronvolts; unknown units give null."""
    return e * _map([("eV", 1.0), ("Ry", RYDBERG_EV), ("Ha", HARTREE_EV), ("kJ/mol", 0.010364270), ("cm-1", 1.239842e-4), ("THz", 4.135667e-3)])[unit]


def calctypes(flags: dict[int, Column]) -> Column:
    """Codes whose flag holds, in order: charges 4, moments 5, phonons 6, dispersion 7, dielectric 8, elastic 9, optimisation 3, electrons 2, energy 1."""
    return F.array_compact(F.array(*(F.when(flags[c], F.lit(c)) for c in (4, 5, 6, 7, 8, 9, 3, 2, 1) if c in flags)))


def periodicity_code(p: Column) -> Column:
    return F.when(p == 0, F.lit(4)).when(p == -1, F.lit(5)).otherwise(p)


def spin_code(magnetic: Column) -> Column:
    return F.when(magnetic, F.lit(2)).otherwise(F.lit(1))


def space_group_label(n: Column, symbol: Column) -> Column:
    return F.format_string("%s &mdash; %s", n.cast("string"), symbol)


def xc_is_valid(types: Column) -> Column:
    """Only the codes 1 to 7 may occur."""
    return F.size(F.array_except(types, F.array(*(F.lit(i) for i in range(1, 8))))) == 0


def basis_label(shells: Column, ecp: Column | None = None) -> Column:
    """Shells (struct of type and size) of an element, after the shells of its pseudopotential in brackets.

    A shell is its type in lower case with its size as a superscript; equal shells in a row are
    one in round brackets with their number.
    """
    one = lambda c: F.concat(F.lower(c["type"]), F.lit("<sup>"), c["size"].cast("string"), F.lit("</sup>"))
    texts = F.transform(shells, one)
    runs = F.aggregate(texts, F.expr("cast(array() as array<struct<s:string,n:int>>)"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["s"] == s),
        F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.struct(s.alias("s"), (F.try_element_at(acc, F.lit(-1))["n"] + 1).alias("n"))))).otherwise(F.concat(acc, F.array(F.struct(s.alias("s"), F.lit(1).alias("n"))))))
    text = F.array_join(F.transform(runs, lambda r: F.when(r["n"] > 1, F.concat(F.lit("("), r["s"], F.lit(")<sup>"), r["n"].cast("string"), F.lit("</sup>"))).otherwise(r["s"])), "")
    return text if ecp is None else F.concat(F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(ecp, one), ""), F.lit("]")), F.lit("")), text)


def bit_signature(codes: Column) -> Column:
    """Sum of 2 to the power of each code."""
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: acc + F.pow(F.lit(2.0), x).cast("long"))


def hubbard_label(elements: Column, us: Column, js: Column, kind: Column | None = None) -> Column:
    """Scheme of the correction (type 1, 2 or 4) and the sorted el:U/J list, one decimal; zero pairs are skipped.

    Further pairs of an element have its number after its name; a pair that is like its first one counts once.
    """
    rows = F.filter(F.arrays_zip(elements.alias("e"), us.alias("u"), js.alias("j")), lambda x: (x["u"] != 0) | (x["j"] != 0))
    pairs = F.transform(rows, lambda x: F.struct(x["e"].alias("e"), F.format_string("%.1f/%.1f", x["u"], x["j"]).alias("v")))
    first = lambda x: F.filter(pairs, lambda y: y["e"] == x["e"])[0]["v"]
    further = lambda x, i: F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda y: (y["e"] == x["e"]) & (y["v"] != first(x))))
    name = lambda x, i: F.when(x["v"] == first(x), x["e"]).otherwise(F.concat(x["e"], further(x, i).cast("string")))
    text = F.array_join(F.array_sort(F.array_distinct(F.transform(pairs, lambda x, i: F.concat(name(x, i), F.lit(":"), x["v"])))), " ")
    if kind is None:
        return text
    scheme = F.when(kind == 2, F.lit("GGA+U(std.)")).when(kind == 1, F.lit("GGA+U(Liecht.)")).when(kind == 4, F.lit("LDA+U(Liecht.)")).otherwise(F.format_string("GGA+U(type %s)", kind.cast("string")))
    return F.concat_ws(" ", scheme, F.when(text != "", text))


def tolerance_label(ev: Column) -> Column:
    """Plane-wave cutoff as a label."""
    return F.concat(F.lit("cutoff "), ev.cast("string"), F.lit("eV"))


def hybrid_label(screening: Column) -> Column:
    return F.when(screening.isNull(), F.lit("PBE")).when(screening == 0, F.lit("PBE0")).when(F.abs(screening - 0.2) < 1e-9, F.lit("HSE06")).otherwise(F.format_string("HSE06 %.2f", screening))


def _by_number(ranges: list[tuple[int, int, str]]) -> Column:
    """Names by every number of ranges of integers."""
    return fixed_map((k, name) for low, high, name in ranges for k in range(low, high + 1))


def crystal_system(n: Column) -> Column:
    return F.try_element_at(_by_number(CRYSTAL_SYSTEMS), n)


def point_group(n: Column) -> Column:
    """Schoenflies symbol with the index as a subscript."""
    return F.try_element_at(_by_number(POINT_GROUPS), n)


def layer_group(n: Column, oblique: Column) -> Column:
    """Layer group of a space group; other than right angles have entries of their own."""
    return F.coalesce(F.when(oblique, _map(OBLIQUE_LAYER_GROUPS.items())[n]), _map(LAYER_GROUPS.items())[n])


def layer_system(g: Column) -> Column:
    out = None
    for low, high, name in LAYER_SYSTEMS:
        out = (F.when if out is None else out.when)(g.between(low, high), F.lit(name))
    return out


def decode_enum(num: Column, cid: int) -> Column:
    """Name of a code; unknown codes as a dash, and facets without names as they are."""
    if cid not in ENUMS:
        return F.coalesce(num.cast("string"), F.lit("—"))
    return F.coalesce(_map([(i, v) for i, v in enumerate(ENUMS[cid]) if v])[num], F.lit("—"))


def decode_enums(nums: Column, cid: int) -> Column:
    return F.array_join(F.transform(nums, lambda x: decode_enum(x, cid)), ", ")


def k_for(n: Column) -> Column:
    """Number of clusters for n points."""
    return F.when(n > 200, F.lit(8)).when(n > 100, F.lit(6)).when(n > 50, F.lit(5)).when(n > 30, F.lit(4)).otherwise(F.lit(3))


def functional_family(name: Column) -> Column:
    """Family codes of a functional by its prefix; unknown ones give null."""
    codes = [("HYB_MGGA", [3, 4]), ("HYB_GGA", [2, 4]), ("MGGA", [3]), ("GGA", [2]), ("LDA", [1])]
    out = None
    for prefix, own in codes:
        value = F.array(*(F.lit(c) for c in own))
        out = (F.when if out is None else out.when)(name.startswith(prefix) | name.startswith("XC_" + prefix), value)
    return out
