"""Nested datasets and removal: tables are immutable, each function returns the tables as they are afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, written


def ancestors(calcsets: DataFrame) -> DataFrame:
    """(node, ancestor, distance): all datasets above each node with the least distance.

    Round k knows all pairs up to a distance of 2**k. A pair further apart, up to twice that, has
    a dataset at just that distance from the node on its way, so pairs at exactly 2**k are joined
    with all: a nesting of n levels takes about log2(n) rounds. A dataset within itself is an error.
    """
    step = calcsets.select(F.col("children_checksum").alias("node"), F.col("parent_checksum").alias("ancestor")).where("node is not null and ancestor is not null").distinct()
    known, far = written(step.withColumn("distance", F.lit(1)), "closure"), 1
    while True:
        ends = known.where(F.col("distance") == far).select("node", F.col("ancestor").alias("between"))
        if ends.isEmpty():
            break
        above = known.select(F.col("node").alias("between"), "ancestor", (F.col("distance") + far).alias("distance"))
        more = known.unionByName(ends.join(above, "between").select("node", "ancestor", "distance"))
        longer = written(more.groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "closure")
        discard(known)
        known, far = longer, 2 * far
    if not known.where("node = ancestor").isEmpty():
        raise ValueError("a dataset contains itself")
    return known


def dataset_sizes(calcsets: DataFrame) -> DataFrame:
    return calcsets.groupBy("parent_checksum").agg(F.count("*").alias("siblings_count"))


def merge_summary(members: DataFrame, values: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of the facet values over the members (dataset, checksum) of each dataset, and their total size and depth."""
    topics = members.join(values, "checksum").where("topic is not null and topic <> ''").select("dataset", "cid", "topic").distinct()
    total = members.join(sizes, "checksum").groupBy("dataset").agg(F.sum("download_size").alias("download_size"), (F.max("nested_depth") + 1).alias("nested_depth"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_set("checksum"))), 224).alias("checksum"))
    return topics, total.where("download_size > 0")


def purge(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given runs: keyed by checksum or through their structures, and both ends of the datasets' edges; references that no run has any more go too."""
    out = {}
    gone = tables["structures"].join(keys, "checksum", "left_semi").select("struct_id") if "structures" in tables else None
    for name, t in tables.items():
        if name == "calcsets":
            for end in ("parent_checksum", "children_checksum"):
                t = t.join(keys.withColumnRenamed("checksum", end), end, "left_anti")
            out[name] = t.select("parent_checksum", "children_checksum")
        elif "checksum" in t.columns:
            out[name] = t.join(keys, "checksum", "left_anti").select(*t.columns)
        elif "struct_id" in t.columns and gone is not None:
            out[name] = t.join(gone, "struct_id", "left_anti").select(*t.columns)
        else:
            out[name] = t
    if "references" in out and "metadata_references" in out:
        out["references"] = out["references"].join(out["metadata_references"].select("reference_id"), "reference_id", "left_semi")
    return out


def purge_dataset(sizes: DataFrame, calcsets: DataFrame, keys: DataFrame) -> DataFrame:
    """(checksum, download_size, siblings_count, refused) after the given runs or datasets are removed: each counts once for a dataset above it.

    refused marks the datasets that would be empty; as long as there is one, the removal should not be carried out.
    """
    above = ancestors(calcsets).join(keys.withColumnRenamed("checksum", "node"), "node", "left_semi").select("node", "ancestor").distinct()
    delta = above.join(sizes.select(F.col("checksum").alias("node"), "download_size"), "node").groupBy("ancestor").agg(F.sum("download_size").alias("gone"))
    gone = calcsets.join(keys.withColumnRenamed("checksum", "children_checksum"), "children_checksum", "left_semi").groupBy("parent_checksum").agg(F.count("*").alias("fewer"))
    now = sizes.join(keys, "checksum", "left_anti").join(delta.withColumnRenamed("ancestor", "checksum"), "checksum", "left").join(dataset_sizes(calcsets).withColumnRenamed("parent_checksum", "checksum"), "checksum", "left").join(gone.withColumnRenamed("parent_checksum", "checksum"), "checksum", "left")
    left = F.col("siblings_count") - F.coalesce("fewer", F.lit(0))
    return now.select("checksum", (F.col("download_size") - F.coalesce("gone", F.lit(0))).alias("download_size"), F.coalesce(left, F.lit(0)).alias("siblings_count"), F.coalesce((left == 0) & F.col("fewer").isNotNull(), F.lit(False)).alias("refused"))


def merge(members: DataFrame, values: DataFrame, sizes: DataFrame) -> dict[str, DataFrame]:
    """The rows that new datasets add to a repository: runs (checksum, title, size, depth, siblings), calcsets and raw_tags.

    members has (dataset, checksum), the dataset's title and its runs; the key of a dataset is a
    hash of its members' keys. The title is the dataset's formula (cid 1). A dataset without size is left out.
    """
    topics, total = merge_summary(members, values, sizes)
    runs = total.join(members.distinct().groupBy("dataset").agg(F.count("*").alias("siblings_count")), "dataset").select("checksum", F.col("dataset").alias("title"), "download_size", "nested_depth", "siblings_count")
    keys = total.select("dataset", F.col("checksum").alias("parent_checksum"))
    edges = members.distinct().join(keys, "dataset").select("parent_checksum", F.col("checksum").alias("children_checksum"))
    tags = topics.where("cid <> 1").join(keys, "dataset").select(F.col("parent_checksum").alias("checksum"), "cid", "topic").unionByName(keys.select(F.col("parent_checksum").alias("checksum"), F.lit(1).alias("cid"), F.col("dataset").alias("topic")))
    return {"runs": runs, "calcsets": edges, "raw_tags": tags}


def augment(runs: DataFrame, calcsets: DataFrame, tags: DataFrame, parent: str, keys: DataFrame, title_cid: int = 1) -> dict[str, DataFrame]:
    """runs (checksum, download_size, nested_depth), calcsets and raw_tags after further members join a dataset.

    Members it has already are skipped. Only a dataset can grow, nothing new is an error, and so
    is itself or a dataset above it. The members' topics join the dataset's (its title stays), its
    size and depth grow, and those of the datasets above by the same sizes.
    """
    spark = keys.sparkSession
    if calcsets.where(F.col("parent_checksum") == parent).isEmpty():
        raise ValueError("this is no dataset")
    above = ancestors(calcsets).where(F.col("node") == parent).select(F.col("ancestor").alias("checksum"), "distance").unionByName(spark.createDataFrame([(parent, 0)], "checksum string, distance int"))
    if not keys.join(above, "checksum", "left_semi").isEmpty():
        raise ValueError("a dataset can't contain itself or a dataset above it")
    new = keys.select("checksum").distinct().join(calcsets.where(F.col("parent_checksum") == parent).select(F.col("children_checksum").alias("checksum")), "checksum", "left_anti")
    if new.isEmpty():
        raise ValueError("nothing new to add")
    edges = calcsets.unionByName(new.select(F.lit(parent).alias("parent_checksum"), F.col("checksum").alias("children_checksum")))
    added = new.join(runs, "checksum").agg(F.coalesce(F.sum("download_size"), F.lit(0)).alias("more"), F.coalesce(F.max("nested_depth"), F.lit(0)).alias("depth"))
    own = runs.where(F.col("checksum") == parent).select(F.col("nested_depth").alias("own_depth"))
    changed = runs.join(above, "checksum", "left").crossJoin(F.broadcast(added)).crossJoin(F.broadcast(own))  # one row each
    deep = F.greatest("nested_depth", F.greatest("own_depth", F.col("depth") + 1) + F.col("distance"))
    grown = F.col("distance").isNotNull()
    runs = changed.select("checksum", (F.col("download_size") + F.when(grown, F.col("more")).otherwise(0)).alias("download_size"), F.when(grown, deep).otherwise(F.col("nested_depth")).alias("nested_depth"))
    topics = tags.join(new, "checksum", "left_semi").where(F.col("cid") != title_cid).select(F.lit(parent).alias("checksum"), "cid", "topic")
    return {"runs": runs, "calcsets": edges, "raw_tags": tags.select("checksum", "cid", "topic").unionByName(topics).distinct()}
