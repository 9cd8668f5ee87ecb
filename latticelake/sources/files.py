"""Folders of run logs as tables, and tables as files."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.functionals import xc_lookup
from ..functions.scalars import RYDBERG_EV, duration_hours
from ..reference_data import SYMBOLS

# Formats by what a line of their logs holds; a line must match all patterns of a rule.
RULES = {"vasp-xml": [r'<i name="program" type="string">vasp'], "pwscf": [r"pwscf|PWSCF", r"     Current dimensions of program "]}


def _has(affix: str):
    return lambda part: part.startswith(affix) | part.endswith(affix)


def unskipped(path: Column, affixes: list[str]) -> Column:
    """No file or folder of the path starts or ends with a skip affix."""
    ok = F.lit(True)
    for a in affixes:
        ok = ok & ~F.array_contains(F.transform(F.split(path, "/"), _has(a)), True)
    return ok


def scan_files(spark: SparkSession, root: str, recursive: bool = False, skip_affixes: list[str] = ()) -> DataFrame:
    """(path, length, content) of a folder's files without skipped files and folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    below = F.expr(f"substring(path, instr(path, '{root.rstrip('/').split('/')[-1]}/') + {len(root.rstrip('/').split('/')[-1])})")
    return files.where(unskipped(below, list(skip_affixes))).select("path", "length", "content")


def scan_stem(files: DataFrame, stem: str, skip_affixes: list[str] = ()) -> DataFrame:
    """Files whose path contains stem, without skipped ones."""
    return files.where(F.col("path").contains(stem) & unskipped(F.col("path"), list(skip_affixes)))


def scan_targets(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Files that a listed path (column value) names, or that lie in a listed folder at any level.

    Every file is joined through the folders above it, so the join has a key.
    """
    wanted = targets.select(F.regexp_replace(F.trim("value"), "/+$", "").alias("target")).where("target <> ''").distinct()
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("target"))
    found = above.join(wanted, "target", "left_semi").select("path").distinct()
    return files.join(found, "path", "left_semi")


def is_binary(content: Column) -> Column:
    """Whether the first 2,048 bytes hold other than ASCII."""
    return F.decode(F.substring(content.cast("binary"), 1, 2048), "ISO-8859-1").rlike("[^\\x00-\\x7F]")


def detect_format(text: Column, rules: dict[str, list[str]] = RULES) -> Column:
    """Format by the first line, of at most 701, that a rule matches; null if none does."""
    lines = F.slice(F.split(text, "\n"), 1, 701)
    def of(line):
        out = None
        for name, patterns in rules.items():
            cond = F.lit(True)
            for p in patterns:
                cond = cond & line.rlike(p)
            out = (F.when if out is None else out.when)(cond, F.lit(name))
        return out
    return F.get(F.filter(F.transform(lines, of), lambda x: x.isNotNull()), F.lit(0))


#: What the plane-wave parser makes of a log.
LOG = ("path string, version string, energy double, xc string, finished int, wall string, spin boolean, cell array<array<double>>, atoms array<struct<symbol:string,x:double,y:double,z:double>>, kpoints array<array<double>>,"
       " bands struct<abscissa:array<double>,stripes:array<array<double>>>, k string, warns array<string>, error string")
BOHR = 0.5291772083
_KNOWN = frozenset(SYMBOLS)


_NUMBER, _COORDINATE = re.compile(r"-?\d+\.?\d*(?:[eEdD][+-]?\d+)?"), re.compile(r"-?\d*\.\d{4}")
_PROGRAM, _ENERGY, _XC = re.compile(r"     Program PWSCF\s*(?:v\.)?\s*(.*?) starts "), re.compile(r"!\s+total energy\s+=\s+(-?[\d.]+)"), re.compile(r"     Exchange-correlation\s*=\s*(.+)$")
_WALL = re.compile(r"PWSCF\s+:.*CPU(?:\s+time)?,?\s*(.*?)\s*(?:WALL|wall)")


#: Three plain numbers and no more of them; a line of plain numbers.
_THREE = re.compile(r"[\s(]*(-?\d+\.?\d*)\s+(-?\d+\.?\d*)\s+(-?\d+\.?\d*)(?![\d.eEdD])[^\d]*\Z", re.ASCII)
_PLAIN = re.compile(r"[ \d.+-]+\Z", re.ASCII)


def _numbers(line: str) -> list[float]:
    return [float(x) for x in _NUMBER.findall(line)]


def _three(text: str) -> list[float]:
    """The first three numbers of a text, or as many as it has."""
    if m := _THREE.match(text):
        return [float(m[1]), float(m[2]), float(m[3])]
    return _numbers(text)[:3]


def _times(rows: list[list[float]], k: float) -> list[list[float]]:
    """Rows of three numbers times k; others as NumPy takes them, which may be an error."""
    try:
        return [[x * k, y * k, z * k] for x, y, z in rows]
    except ValueError:
        return (np.array(rows) * k).tolist()


def _inverse(cell: list[list[float]]) -> list[list[float]]:
    """Inverse of a cell by its cofactors; where that is not safe, NumPy's, with its errors."""
    if [len(r) for r in cell] == [3, 3, 3]:
        (a, b, c), (d, e, f), (g, h, i) = cell
        p, q, r = e * i - f * h, f * g - d * i, d * h - e * g
        det = a * p + b * q + c * r
        if abs(det) > 1e-6 * (abs(a) + abs(b) + abs(c)) * (abs(d) + abs(e) + abs(f)) * (abs(g) + abs(h) + abs(i)):
            return [[p / det, (c * h - b * i) / det, (b * f - c * e) / det], [q / det, (a * i - c * g) / det, (c * d - a * f) / det], [r / det, (b * g - a * h) / det, (a * e - b * d) / det]]
    return np.linalg.inv(np.array(cell)).tolist()


def _walk(points: list[list[float]], cell: list[list[float]]) -> list[float]:
    """Places of k-points along their path."""
    (a, b, c), (d, e, f), (g, h, i) = _inverse(cell)
    out, so_far, u, v, w = [], 0.0, 0.0, 0.0, 0.0
    for x, y, z in points:
        r, s, t = x * a + y * b + z * c, x * d + y * e + z * f, x * g + y * h + z * i
        u, v, w = r + u, s + v, t + w
        so_far += math.sqrt(u * u + v * v + w * w)
        out.append(so_far)
        u, v, w = r, s, t
    return out


class LogReader:
    """What a plane-wave log says, line by line: only the structure of now and the last set of eigenvalues are kept."""

    def __init__(self):
        self.row = {"version": None, "energy": None, "xc": None, "wall": None, "ended": False}
        self.alat, self.scaled, self.cell, self.names, self.place = 1.0, False, None, [], None
        self.block: list[str] | None = None  # lines of the block under way, what it is, how many it has (None: up to an empty line)
        self.kind, self.most = "", None
        self.sets = None

    def feed_all(self, lines: list[str | None]) -> None:
        """feed() of each line; what most lines are is told here: lines of a block, empty ones and rows of eigenvalues."""
        for line in lines:
            if (block := self.block) is not None:
                if line and not line.isspace() and len(block) != self.most:
                    block.append(line)
                    if len(block) == self.most:
                        self.close()
                    continue
            elif line and (now := self.sets) and now["open"] and not now["done"] and _PLAIN.match(line):
                self.eigenvalues(now, line)
                continue
            self.feed(line or "")

    def feed(self, line: str) -> None:
        if self.block is not None:
            if (line.strip() or self.most is not None and self.kind != "cell") and len(self.block) != self.most:
                self.block.append(line)
                if len(self.block) == self.most:
                    self.close()
                return
            self.close()
        if not line:  # says nothing but in a set of eigenvalues, of which it ends a row
            if (now := self.sets) and not now["done"] and now["values"] and now["values"][-1]:
                now["open"] = False
            return
        if line.startswith("     "):
            sign = line[5:6]
            if sign == "P":
                if m := line.startswith("     Program PWSCF") and _PROGRAM.match(line):
                    self.row["version"] = self.row["version"] or m[1].strip()
            elif sign == "E":
                if m := line.startswith("     Exchange-correlation") and _XC.match(line):
                    self.row["xc"] = self.row["xc"] or m[1].strip()
            elif sign == "c":
                if line.startswith("     celldm") and not self.scaled:
                    self.scaled, self.alat = True, float(line.split("=", 1)[1].split()[0]) * BOHR or 1.0
                elif line.startswith("     crystal axes:"):
                    self.open("axes", 3)
            elif sign == "s" and line.startswith("     site n.") and not self.names:
                self.open("sites", None)
        elif m := line[0] == "!" and _ENERGY.match(line):
            self.row["energy"] = float(m[1]) * RYDBERG_EV
        elif line.startswith("CELL_PARAMETERS") and self.place is not None:
            self.open("cell", 3, line)
        elif line.startswith("ATOMIC_POSITIONS") and self.place is not None:
            self.open("positions", len(self.names), line)
        if m := "PWSCF" in line and _WALL.search(line):
            self.row["wall"] = m[1].replace(" ", "")
        if "This run was terminated on" in line:
            self.row["ended"] = True
        if "End of " in line and ("End of self-consistent calculation" in line or "End of band structure calculation" in line):
            self.sets = {"points": [], "values": [], "level": None, "failed": False, "spin": False, "open": False, "done": False}
        elif self.sets and not self.sets["done"]:
            self.eigenvalues(self.sets, line)

    def open(self, kind: str, most: int | None, head: str = "") -> None:
        self.block, self.kind, self.most, self.head = [], kind, most, head
        if most == 0:
            self.close()

    def close(self) -> None:
        """The block under way has all its lines. A new cell keeps the fractional positions."""
        rows, self.block = self.block, None
        scale = self.alat if "alat" in self.head else BOHR if "bohr" in self.head else 1.0
        if self.kind == "axes":
            self.cell = _times([_three(x.split("=", 1)[1]) for x in rows], self.alat)
        elif self.kind == "sites":
            names = [x.split(None, 2)[1].strip("0123456789").split("_")[0] for x in rows]
            self.names = [x if x in _KNOWN or len(x) == 1 else x[:-1] for x in names]
            self.place = _times([_three(x.rsplit("(", 1)[1]) for x in rows], self.alat)
        elif self.kind == "cell" and len(rows) == 3:
            fractions = np.array(self.place) @ np.linalg.inv(np.array(self.cell))
            self.cell = _times([_three(x) for x in rows], BOHR if "bohr" in self.head else self.alat if "alat" in self.head else 1.0)
            self.place = (fractions @ np.array(self.cell)).tolist()
        elif self.kind == "positions":
            at = [[float(v) for v in x.split()[1:4]] for x in rows]
            self.place = _times(at, scale) if scale != 1.0 or "alat" in self.head else _times(at, 1.0) if "angstrom" in self.head else (np.array(at) @ np.array(self.cell)).tolist()

    @staticmethod
    def eigenvalues(now: dict, line: str) -> None:
        """One line after the end of a calculation: k-points and their values, up to the level that they count from."""
        if now["open"] and _PLAIN.match(line):  # holds no word that is looked for
            try:
                now["values"][-1] += [float(x) for x in line.split()]
            except ValueError:
                now["failed"] = now["done"] = True
            if line.isspace() and now["values"][-1]:
                now["open"] = False
        elif "    k =" in line:
            now["points"].append([float(x) for x in _COORDINATE.findall(line.split("k =")[1])[:3]])
            now["values"].append([])
            now["open"] = True
        elif "highest occupied level" in line or "highest occupied, lowest unoccupied" in line or "Fermi energy" in line:
            found = _numbers(line.split("is" if "Fermi" in line else ":")[-1])
            now["level"], now["done"] = found[0] if found else None, True
        elif "SPIN UP" in line or "SPIN DOWN" in line:
            now["spin"] = True
        elif "Ry" in line or "CPU" in line:
            now["failed"] = now["done"] = True
        elif now["open"] and line.strip():
            try:
                now["values"][-1] += [float(x) for x in line.split()]
            except ValueError:
                now["failed"] = now["done"] = True
        elif now["values"] and now["values"][-1]:
            now["open"] = False

    def bands(self) -> dict:
        """kpoints, bands, k, spin and what to warn of; bands count from the highest occupied level."""
        out, now = {"kpoints": None, "bands": None, "k": None, "spin": False, "warns": []}, self.sets
        if not now or not any(now["values"]):
            return out | {"spin": bool(now and now["spin"])}
        if now["spin"]:
            out["warns"].append("Spin states are not supported: only the spin down projection is considered.")
        out |= {"kpoints": now["points"], "k": f"{len(now['points']) // (2 if now['spin'] else 1)} pts/BZ", "spin": now["spin"]}
        if now["level"] is None and not now["failed"]:
            out["warns"].append("The highest occupied state was not found.")
        elif now["failed"] or len({len(v) for v in now["values"]}) > 1:
            out["warns"].append("The band data are incorrect.")
        else:
            level = now["level"]
            out["bands"] = {"abscissa": _walk(now["points"], self.cell), "stripes": [[v - level for v in band] for band in zip(*now["values"], strict=True)]}
        return out

    def result(self, path: str) -> dict:
        """The log as a row of LOG."""
        if self.block is not None:
            self.close()
        said = self.row
        row = {"path": path, "version": said["version"], "energy": said["energy"], "xc": said["xc"], "wall": said["wall"], "finished": 2 if said["wall"] is not None or said["ended"] else 1, "spin": False, "warns": [], "error": None if said["version"] is not None else "no version found"}
        if self.place is not None and self.cell is not None:
            row |= {"cell": self.cell, "atoms": [{"symbol": n, "x": x, "y": y, "z": z} for n, (x, y, z) in zip(self.names, self.place, strict=True)]}
            row |= self.bands()
        return row


def _read(path: str, stretches: Iterable[list[str | None]]) -> dict:
    """A log, as lists of lines, as a row of LOG; one that can't be read is a row with an error. All lists are used up."""
    reader, error = LogReader(), None
    for lines in stretches:
        if error is None:
            try:
                reader.feed_all(lines)
            except Exception as e:  # a bad log is a result
                error = e
    try:
        if error is None:
            return reader.result(path)
    except Exception as e:
        error = e
    return {"path": path, "error": f"{type(error).__name__}: {error}"[:200]}


def parse_log(path: str, text: str) -> dict:
    """One plane-wave log as a row of LOG: what its last step says."""
    return _read(path, [text.split("\n")])


def parse_runs(files: DataFrame) -> DataFrame:
    """Run rows of (path, text): LOG with the functional's name and types and the wall time in hours.

    A log that can't be read gives a row with an error, never a failed job.
    """
    names = StructType.fromDDL(LOG).names

    def run(batches):
        for pdf in batches:
            rows = [parse_log(path, text or "") for path, text in zip(pdf["path"], pdf["text"], strict=True)]
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return _with_labels(files.select("path", "text").mapInPandas(run, LOG))


def log_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, start, n, line) of the logs of a folder; start and n give the order of a file's lines. Large files are read by several tasks."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def _stretches(batches: Iterable[pa.RecordBatch]):
    """(path, lines) of the lines of a batch that follow one another in one file: each path is read once, not with every line."""
    for b in batches:
        runs = pc.run_end_encode(b.column(0))
        lines, start = b.column(1).to_numpy(zero_copy_only=False).tolist(), 0  # quicker than to_pylist
        for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            yield path, lines[start:end]
            start = end


def _rows(batches: Iterable[pa.RecordBatch], kinds: pa.Schema):
    """Rows of LOG of logs whose lines follow one another."""
    batch = lambda done: pa.RecordBatch.from_arrays([pa.array([r.get(k.name) for r in done], k.type) for k in kinds], schema=kinds)
    done = []
    for path, own in groupby(_stretches(batches), key=itemgetter(0)):
        done.append(_read(path, (lines for _, lines in own)))
        if len(done) == 64:
            yield batch(done)
            done = []
    if done:
        yield batch(done)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Run rows, as parse_runs gives them, of logs that come as lines (path, start, n, line): no log has to fit a row or a task's memory.

    Lines are dealt by file and sorted; a task reads them one by one and keeps only what the log
    says so far. Null lines are empty; lines without a path belong to no log.
    """
    kinds = to_arrow_schema(StructType.fromDDL(LOG))

    def run(batches):
        return _rows(batches, kinds)

    dealt = lines.where("path is not null").repartition("path").sortWithinPartitions("path", "start", "n")
    return _with_labels(dealt.select("path", "line").mapInArrow(run, LOG))


def _with_labels(raw: DataFrame) -> DataFrame:
    xc = xc_lookup(F.col("xc"))
    return raw.select("*", xc["name"].alias("H"), xc["types"].alias("xc_types"), F.when(F.col("wall").isNotNull(), duration_hours(F.col("wall"))).alias("hours"), F.size("atoms").alias("natom"), F.lit("pwscf").alias("format")).drop("wall")


def folder_and_stem(path: Column) -> tuple[Column, Column, Column]:
    """Folder, stem and extension of a path."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*?)(\.[^/.]*)?$", 1), F.regexp_extract(path, r"(\.[^/.]*)$", 1)


def attach_inputs(files: DataFrame) -> DataFrame:
    """(path, input, warning) of each .out log: the .in of its stem, else the only input file of its folder."""
    folder, stem, ext = folder_and_stem(F.col("path"))
    named = files.select("path", folder.alias("folder"), stem.alias("stem"), ext.alias("ext"))
    inputs = named.where(F.col("ext").isin(".in", ".inp", ".input"))
    own = inputs.where("ext = '.in'").groupBy("folder", "stem").agg(F.min("path").alias("own"))
    only = inputs.groupBy("folder").agg(F.min("path").alias("only"), F.count("*").alias("n"))
    found = named.where("ext = '.out'").join(own, ["folder", "stem"], "left").join(only, "folder", "left")
    chosen = F.coalesce("own", F.when(F.col("n") == 1, F.col("only")))
    return found.select("path", chosen.alias("input"), F.when(chosen.isNull(), F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("no input file")).otherwise(F.lit("several input files"))).alias("warning"))


def attach_setups(files: DataFrame) -> DataFrame:
    """(path, related, warning) of each .out log of a Gaussian-basis code: itself and the .d12 and .gui of its stem, and the first line of its folder's fort.87.

    files has path and text. The stem of `x.cryst.out` is `x`; an empty first line is no warning.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    named = files.select("path", folder.alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "text")
    logs = named.where(F.col("file").endswith(".out")).select("path", "folder", F.regexp_replace("file", r"(\.cryst)?\.out$", "").alias("stem"))
    setups = named.where(F.col("file").rlike(r"\.(d12|gui)$")).select("folder", F.regexp_replace("file", r"\.(d12|gui)$", "").alias("stem"), F.col("path").alias("setup"))
    own = setups.groupBy("folder", "stem").agg(F.array_sort(F.collect_set("setup")).alias("setups"))
    said = named.where("file = 'fort.87'").groupBy("folder").agg(F.min(F.split("text", "\n")[0]).alias("line"))
    found = logs.join(own, ["folder", "stem"], "left").join(said, "folder", "left")
    return found.select("path", F.concat(F.array("path"), F.coalesce("setups", F.array().cast("array<string>"))).alias("related"), F.nullif(F.col("line"), F.lit("")).alias("warning"))


def load_articles(els: DataFrame, meta: DataFrame, biblio: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(paper, elements, standard, authors, title, dtype) of articles: sorted elements, authors once in order.

    els has (element, papers), overrides (paper, elements) replaces a paper's elements, meta has
    (paper, authors, title); papers that it lacks take theirs from biblio, which has the same columns.
    """
    papers = els.select("element", F.explode("papers").alias("paper")).groupBy("paper").agg(F.array_sort(F.collect_set("element")).alias("elements"))
    if overrides is not None:
        own = overrides.select("paper", F.array_sort(F.array_distinct("elements")).alias("own"))
        papers = papers.join(own, "paper", "full").select("paper", F.coalesce("own", "elements").alias("elements"))
    found = papers.join(meta.select("paper", "authors", "title"), "paper", "left")
    if biblio is not None:
        found = found.join(biblio.select("paper", F.replace("authors", F.lit(" and "), F.lit(", ")).alias("raw_authors"), F.col("title").alias("raw_title")), "paper", "left").withColumns({"authors": F.coalesce("authors", "raw_authors"), "title": F.coalesce("title", "raw_title")})
    return found.select("paper", "elements", F.array_join("elements", " / ").alias("standard"), F.array_distinct(F.split("authors", ", ")).alias("authors"), "title", F.lit(1).alias("dtype"))


def _entries(texts: DataFrame, column: str, path: str, value: str) -> DataFrame:
    """(key, value) of the JSON object at path in a column of texts; values as the type value."""
    parsed = texts.select(F.expr(f"variant_get(parse_json(`{column}`), '{path}', 'variant')").alias("v")).where("v is not null")
    return texts.sparkSession.sql(f"select e.key, cast(e.value as {value}) as value from {{parsed}} p, lateral variant_explode(p.v) e", parsed=parsed)


def load_articles_json(els: DataFrame, meta: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(paper, elements, standard, authors, title, year, doi, pubdata, location, dtype) of articles, straight from the texts of their JSON maps.

    els (text) has els2paperids, papers by element, and paperids2bib, [authors, title, year,
    journal] by paper; meta (text) has [file, doi, authors, title, journal, year] by paper, and
    papers that it lacks take theirs from paperids2bib. Maps may be spread over any number of
    texts. overrides (paper, elements) replaces a paper's elements; papers without any are left
    out. Only ASCII stays of names and titles.
    """
    papers = _entries(els, "text", "$.els2paperids", "array<string>").select(F.col("key").alias("element"), F.explode("value").alias("paper"))
    papers = papers.groupBy("paper").agg(F.array_sort(F.collect_set("element")).alias("elements"))
    if overrides is not None:
        own = overrides.select("paper", F.array_sort(F.array_distinct("elements")).alias("own"))
        papers = papers.join(own, "paper", "full").select("paper", F.coalesce("own", "elements").alias("elements"))
    ascii_only = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "")
    bib = _entries(els, "text", "$.paperids2bib", "array<string>").select(F.col("key").alias("paper"), F.col("value").alias("b"))
    told = _entries(meta, "text", "$", "array<string>").select(F.col("key").alias("paper"), F.col("value").alias("m"))
    rows = bib.join(told, "paper", "left").join(papers, "paper")
    known, m, b = F.col("m").isNotNull(), (lambda i: F.get("m", F.lit(i))), (lambda i: F.get("b", F.lit(i)))
    pick = lambda one, other: F.when(known, one).otherwise(other)
    authors = F.array_distinct(F.split(ascii_only(pick(m(2), F.replace(b(0), F.lit(" and "), F.lit(", ")))), ", "))
    return rows.select("paper", "elements", F.array_join("elements", " / ").alias("standard"), authors.alias("authors"), ascii_only(pick(m(3), b(1))).alias("title"), pick(m(5), b(2)).alias("year"),
                       F.nullif(m(1), F.lit("")).alias("doi"), ascii_only(pick(m(4), b(3))).alias("pubdata"), pick(m(0), F.lit("data/NONCE")).alias("location"), F.lit(1).alias("dtype"))


def article_key(content: Column) -> Column:
    return F.concat(F.md5(content), F.lit("PDF"))


def write_repository(tables: dict[str, DataFrame], path: str) -> None:
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def read_repository(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def export_csv(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").option("header", True).csv(path)
