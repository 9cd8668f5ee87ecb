"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to eight dimensions and decoded to the nearest point of the
E8 lattice, once for each of several tables. A vector meets those of its own cell and those whose
cell is among the nearest neighbours of its own; every meeting is verified by its exact cosine.

Cells are cut into blocks, and each pair of blocks is a unit of work of its own, so a cell that
holds many vectors is spread over many tasks. A pair counts in the first table where it meets.
A block pair reports counts and its local components, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .graph import connected_components

#: Vectors of a cell that one side of a unit of work holds, about.
BLOCK = 256


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    rows = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    rows.append(v)
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate([np.array(rows), signs[signs.prod(axis=1) == 1] / 2])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points whose coordinates have an even sum."""
    near = np.round(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    w = worst[rows]
    near[rows, w] += np.where(off[rows, w] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Tables:
    """Random projections and offsets of the hash tables; the same for the same arguments everywhere."""

    def __init__(self, dim: int, tables: int, cell: float, probes: int, seed: int = 11):
        g = np.random.default_rng([seed, dim])
        wide = max(dim, 8)
        self.maps = [np.linalg.qr(g.normal(size=(wide, wide)))[0][:dim, :8] * (wide / 8) ** 0.5 / cell for _ in range(tables)]
        self.moves = [g.uniform(size=8) for _ in range(tables)]
        self.probes, self.roots = probes, e8_roots()
        self.key = g.integers(1, 2**62, size=8, dtype=np.int64) | 1

    def _names(self, points: np.ndarray) -> np.ndarray:
        return ((2 * points).astype(np.int64) * self.key).sum(axis=-1)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cell (n, tables) and probed cells (n, tables, probes) of unit vectors."""
        own, probed = [], []
        for m, move in zip(self.maps, self.moves, strict=True):
            y = unit @ m + move
            c = nearest_e8(y)
            toward = (y - c) @ self.roots.T
            best = np.argpartition(-toward, self.probes, axis=1)[:, :self.probes]
            own.append(self._names(c))
            probed.append(self._names(c[:, None] + self.roots[best]))
        return np.stack(own, axis=1), np.stack(probed, axis=1)


def _units(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors are usable, and those as unit vectors in double precision."""
    good, unit = [], []
    for x in column.to_pylist():
        v = None if x is None or not x or any(y is None for y in x) else np.array(x, dtype=np.float64)
        norm = 0.0 if v is None else float(np.sqrt(v @ v))
        ok = 0 < norm < np.inf
        good.append(ok)
        if ok:
            unit.append(v / norm)
    return np.array(good, dtype=bool), unit


def hashed(rows: DataFrame, tables: int, cell: float, probes: int) -> DataFrame:
    """(id, label, unit, own, probed) of every usable vector with a label."""

    def run(batches):
        made: dict[int, Tables] = {}
        for b in batches:
            good, unit = _units(b.column(2))
            if not good.any():
                continue
            n = len(unit)
            o, p = np.zeros((n, tables), np.int64), np.zeros((n, tables, probes), np.int64)
            lens = np.array([len(u) for u in unit])
            for dim in np.unique(lens):
                at = np.flatnonzero(lens == dim)
                o[at], p[at] = made.setdefault(int(dim), Tables(int(dim), tables, cell, probes)).cells(np.stack([unit[i] for i in at]))
            keep = b.filter(pa.array(good))
            cut = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (a.size // n)), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(unit))), lists(o), lists(p)], names=["id", "label", "unit", "own", "probed"])

    return rows.mapInArrow(run, "id long, label string, unit array<double>, own array<long>, probed array<long>")


def _block_pair(part: dict, tables: int, least: float):
    """Counts of links and local components within one unit of work."""
    unit, members = np.stack(part["unit"]), np.array(part["n"])
    table, home, block = part["table"][0], np.array(part["home"]), np.array(part["block"])
    cos = unit @ unit.T
    hit = np.triu(cos >= least, 1) & (home[:, None] | home[None, :])
    if part["low"][0] != part["high"][0]:
        hit &= block[:, None] != block[None, :]
    a, b = np.nonzero(hit)
    if len(a):
        own = np.stack(part["own"]).reshape(len(unit), tables)
        probed = np.stack(part["probed"]).reshape(len(unit), tables, -1)
        a_in_b, b_in_a = (own[a][:, :, None] == probed[b]).any(axis=2), (own[b][:, :, None] == probed[a]).any(axis=2)
        met = ((own[a] == own[b]) | a_in_b | b_in_a)[:, :table].any(axis=1)
        # two neighbouring cells that probe each other meet in both of them: the lower one counts
        twice = a_in_b[:, table] & b_in_a[:, table] & (part["cell"][0] != np.minimum(own[a, table], own[b, table]))
        a, b = a[~met & ~twice], b[~met & ~twice]
    ids = part["id"]
    top = list(range(len(unit)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            if ids[x] > ids[y]:
                x, y = y, x
            top[y] = x
    links = np.bincount(np.concatenate([a, b]), np.concatenate([members[b], members[a]]), minlength=len(unit))
    for x in np.flatnonzero(links):
        yield ids[x], int(links[x]), ids[find(int(x))]


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98,
                 tables: int = 3, cell: float = 0.4, probes: int = 12) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors of equal label are linked if their cosine in double precision is at least `least`;
    component_id is the smallest id that links reach. Null vectors or labels, zero vectors and
    vectors with null or non-finite entries have no links; vectors of unequal length never meet.
    Equal vectors of a label are compared once, as one node with the number of their ids, so a
    group of copies of any size makes one row. Rows that repeat an id with the same vector count
    once and give repeated rows; different vectors of one id are vectors of their own. Recall
    depends on tables, cell and probes. Other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark, 2048)
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    source = source.withColumn("same", F.xxhash64("label", "v"))
    named = source.where("label is not null and id is not null and v is not null")
    members = written(named.select("id", "same").distinct(), "members")
    sizes = written(members.groupBy("same").agg(F.count("*").alias("n"), F.min("id").alias("least")), "sizes")
    one = named.groupBy("same").agg(F.first("label").alias("label"), F.first("v").alias("v")).select(F.col("same").alias("id"), "label", "v")
    h = written(hashed(one, tables, cell, probes).join(sizes.select(F.col("same").alias("id"), "n"), "id"), "cells")
    size = (F.size("probed") / F.size("own")).cast("int")
    spots = h.select("id", "label", F.posexplode("own").alias("table", "cell")).withColumn("home", F.lit(True)).unionByName(
        h.select("id", "label", F.posexplode("probed").alias("p", "cell"), size.alias("size")).select("id", "label", F.floor(F.col("p") / F.col("size")).cast("int").alias("table"), "cell", F.lit(False).alias("home")))
    key = ["label", "table", "cell"]
    busy = spots.groupBy(*key).agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any").select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    units = (spots.join(busy, key).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("id", *key, "home", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    unit_key = [*key, "low", "high"]
    work = units.join(h.select("id", "n", "unit", "own", "probed"), "id").repartition(*unit_key).sortWithinPartitions(*unit_key)
    columns = ["id", "n", "home", "block", "unit", "own", "probed", *unit_key]

    def run(batches):
        last, part = None, None

        def done():
            out = list(_block_pair(part, tables, least)) if part and len(part["id"]) > 1 and len(set(map(len, part["unit"]))) == 1 else []
            if part and len(set(map(len, part["unit"]))) > 1:  # vectors of unequal length: apart
                for n in set(map(len, part["unit"])):
                    own = [i for i, u in enumerate(part["unit"]) if len(u) == n]
                    out += list(_block_pair({k: [v[i] for i in own] for k, v in part.items()}, tables, least))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["id", "links", "root"])

        for b in batches:
            cols = {n: c.to_pylist() for n, c in zip(columns, b.columns, strict=True) if n not in ("unit", "own", "probed")}
            arrays = {n: np.split(c.flatten().to_numpy(), np.asarray(c.offsets)[1:-1] - np.asarray(c.offsets)[0]) for n, c in zip(columns, b.columns, strict=True) if n in ("unit", "own", "probed")}
            for i, now in enumerate(zip(*(cols[k] for k in unit_key), strict=True)):
                if now != last:
                    if part and len(part["id"]) > 1:
                        yield done()
                    last, part = now, {n: [] for n in columns}
                for n in columns:
                    part[n].append(arrays[n][i] if n in arrays else cols[n][i])
        if part and len(part["id"]) > 1:
            yield done()

    found = written(work.select(*columns).mapInArrow(run, "id long, links long, root long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "component")
    nodes = h.select("id").join(sizes.select(F.col("same").alias("id"), "n", "least"), "id").join(counts, "id", "left").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    nodes = written(nodes.select(F.col("id").alias("same"), "component", "least", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links")), "nodes")
    top = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    done = nodes.join(top, "component").select("same", "n_links", "component_id")
    usable = F.when(F.col("label").isNotNull() & F.col("id").isNotNull(), F.col("same"))
    return (source.select("id", usable.alias("same")).join(done, "same", "left")
            .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
