"""Clustering of numeric properties and the features that go into it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import periodic_group


def assign(points: DataFrame, centroids: list[tuple[float, ...]], columns: list[str]) -> DataFrame:
    """points with the nearest centroid, the lowest index on ties; the k centroids are literals."""
    d2 = lambda c: sum((F.pow(F.col(x) - v, 2) for x, v in zip(columns, c, strict=True)), F.lit(0.0))
    return points.withColumn("cluster", F.array_min(F.array(*(F.struct(d2(c).alias("d2"), F.lit(i).alias("i")) for i, c in enumerate(centroids))))["i"])


def lloyd_step(points: DataFrame, centroids: list[tuple[float, ...]], columns: list[str]) -> DataFrame:
    """(cluster, n, means): one step of assignment and averaging."""
    return assign(points, centroids, columns).groupBy("cluster").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in columns))


def random_start(points: DataFrame, columns: list[str], k: int, seed: int = 1) -> list[tuple[float, ...]]:
    """k of the points, by a hash of their values and the seed."""
    rows = points.select(*(F.col(c).cast("double").alias(c) for c in columns)).distinct().orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(k).collect()
    return [tuple(r) for r in rows]


def kmeans(points: DataFrame, columns: list[str], start: list[tuple[float, ...]], cutoff: float = 0.5, most: int = 100) -> tuple[DataFrame, list[tuple[float, ...]]]:
    """points with their cluster, and the centroids: steps until no centroid moves by cutoff, at most so many.

    The nearest centroid counts, the first one on ties; one without points stays. Only the k
    centroids come to the driver.
    """
    centroids = [tuple(map(float, c)) for c in start]
    for _ in range(most):
        rows = assign(points, centroids, columns).groupBy("cluster").agg(*(F.avg(c).alias(c) for c in columns)).collect()
        now = list(centroids)
        for r in rows:
            now[r.cluster] = tuple(r[c] for c in columns)
        moved = max(math.dist(a, b) for a, b in zip(centroids, now, strict=True))
        centroids = now
        if moved < cutoff:
            break
    return assign(points, centroids, columns), centroids


def binary_features(ground: DataFrame, atoms: DataFrame, structures: DataFrame) -> DataFrame:
    """(checksum, label, group_a, group_b, gap) of two-element runs: sorted periodic groups of their elements and the gap."""
    final = structures.where("final").join(ground.select("checksum"), "checksum", "left_semi").select("checksum", "struct_id")
    kinds = atoms.join(final, "struct_id").select("checksum", "number").distinct()
    pairs = kinds.groupBy("checksum").agg(F.sort_array(F.collect_list(periodic_group(F.col("number")))).alias("groups")).where(F.size("groups") == 2)
    return ground.join(pairs, "checksum").select("checksum", F.col("chemical_formula").alias("label"), F.col("groups")[0].alias("group_a"), F.col("groups")[1].alias("group_b"), "gap")
