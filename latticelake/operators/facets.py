"""Tags, topics and facets: a dictionary-encoded many-to-many relation between runs and facet values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..reference_data import FACETS
from ..tables import written


def make_tags(runs: DataFrame, facets: list[tuple]) -> DataFrame:
    """(checksum, cid, topic) of every facet column of nested run rows; arrays give one row per entry."""
    parts, kinds = [], dict(runs.dtypes)
    for cid, _, source, _, _, optional, _, _, _, topic in facets:
        if not topic or source not in kinds:
            continue
        value = F.col(source).cast("array<string>") if kinds[source].startswith("array") else F.array(F.col(source).cast("string"))
        parts.append(F.arrays_zip(F.array_repeat(F.lit(cid), F.coalesce(F.size(value), F.lit(0))).alias("cid"), F.coalesce(value, F.array().cast("array<string>")).alias("topic")))
    if not parts:
        return runs.select("checksum", F.lit(0).alias("cid"), F.lit("").alias("topic")).where("false")
    return runs.select("checksum", F.explode(F.concat(*parts)).alias("x")).select("checksum", "x.cid", "x.topic").where("topic is not null and topic <> ''").distinct()


def upsert_dimension(existing: DataFrame, new: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """existing plus the unseen values of new, numbered on by value from the largest id; known ids stay.

    Numbers come from the sizes of parts of about a million new values, so no task sees all of them.
    """
    unseen = written(new.select(*keys).distinct().join(existing, keys, "left_anti"), "unseen")
    parts = unseen.count() // 1_000_000 + 1
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    spread = unseen.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    numbered = spread.withColumn("_rank", rank).join(F.broadcast(sizes), "_part").crossJoin(F.broadcast(top))  # a row for a million values, and one row
    return existing.select(id_col, *keys).unionByName(numbered.select((F.col("top") + F.col("before") + F.col("_rank")).cast(existing.schema[id_col].dataType).alias(id_col), *keys))


def all_tags(tags: DataFrame, tids: list[int]) -> DataFrame:
    """Runs that carry every one of the tags: filtered before the shuffle, then counted."""
    want = sorted(set(tids))
    return tags.where(F.col("tid").isin(want)).groupBy("checksum").agg(F.countDistinct("tid").alias("n")).where(F.col("n") == len(want)).select("checksum")


def cooccurring_tags(tags: DataFrame, tids: list[int]) -> DataFrame:
    """Tags carried by the runs that have all given ones."""
    return tags.join(all_tags(tags, tids), "checksum", "left_semi").select("tid").distinct()


def runs_by_topic(tags: DataFrame, topics: DataFrame, cid: int, topic: str) -> DataFrame:
    return tags.join(topics.where((F.col("cid") == cid) & (F.col("topic") == topic)), "tid").select("checksum")


def topics_of_run(tags: DataFrame, topics: DataFrame) -> DataFrame:
    return tags.join(topics, "tid").select("checksum", "cid", "topic")


def facet_topics(tags: DataFrame, topics: DataFrame, facets: DataFrame, values: DataFrame) -> DataFrame:
    """(cid, name, sort, kind, topic, value, tid, n): a row for each topic of a facet with its decoded name and number of runs.

    Blocks are the rows of a cid, kind tells how they are shown (mendeleev: chemical elements).
    """
    count = tags.groupBy("tid").agg(F.count("*").alias("n"))
    shown = topics.join(facets.where("has_facet or has_topic").select("cid", "name", "sort", "source"), "cid").join(values.select("cid", F.col("num").cast("string").alias("topic"), "value"), ["cid", "topic"], "left").join(count, "tid", "left")
    kind = F.when(F.col("source") == "elements", F.lit("mendeleev")).otherwise(F.lit("tag"))
    return shown.select("cid", "name", "sort", kind.alias("kind"), "topic", F.coalesce("value", "topic").alias("value"), "tid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def topic_counts(tags: DataFrame) -> DataFrame:
    """(tid, n): the number of runs of each topic, to be kept as a table."""
    return tags.groupBy("tid").agg(F.count("*").alias("n"))


def changed_counts(counts: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Kept counts after tags went and came: only the changes are counted, and topics without runs leave.

    gone and new are tags before and after a change (both may hold what stays), such as the
    buckets that a rewrite touched, the tags of purged runs, or those of a batch that was taken in.
    """
    signed = lambda rows, k: rows.groupBy("tid").agg((F.count("*") * k).alias("n"))
    every = counts.select("tid", "n").unionByName(signed(gone, -1)).unionByName(signed(new, 1))
    return every.groupBy("tid").agg(F.sum("n").alias("n")).where("n <> 0")


def distinct_tags(tags: DataFrame) -> DataFrame:
    """(checksum, tid), each pair once: dealt by run, which serves what follows by run, and sorted there, so that no task keeps a hash table of its rows."""
    by = Window.partitionBy("checksum").orderBy("tid")
    seen = tags.select("checksum", "tid").repartition("checksum").withColumns({"place": F.row_number().over(by), "before": F.lag("tid").over(by)})
    return seen.where("place = 1 or not before <=> tid").select("checksum", "tid")


def replace_topics(tags: DataFrame, topics: DataFrame, keys: DataFrame, cid: int, values: list[str]) -> DataFrame:
    """Tags after those of one facet on the given runs are exchanged; the values must be topics already."""
    own = topics.where(F.col("cid") == cid)
    marked = tags.join(own.select("tid", F.lit(True).alias("own")).distinct(), "tid", "left").join(keys.select("checksum", F.lit(True).alias("given")).distinct(), "checksum", "left")
    return distinct_tags(marked.where("own is null or given is null").select("checksum", "tid").unionByName(_given(own, keys, values)))


def append_topics(tags: DataFrame, topics: DataFrame, keys: DataFrame, cid: int, values: list[str]) -> DataFrame:
    """Tags with further values of a multiple facet; pairs that exist stay single, and single facets are refused."""
    if not {f[0]: f[4] for f in FACETS}.get(cid, True):
        raise ValueError("a facet with one value takes no further ones")
    return tags.unionByName(_given(topics.where(F.col("cid") == cid), keys, values)).distinct()


def _given(own: DataFrame, keys: DataFrame, values: list[str]) -> DataFrame:
    return keys.select("checksum").join(F.broadcast(own.where(F.col("topic").isin(values)).select("tid")))  # as many rows as the call has values


def dedupe_new(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of a batch whose key isn't in the repository, once each."""
    return new.dropDuplicates(["checksum"]).join(existing.select("checksum"), "checksum", "left_anti")


def unused(dimension: DataFrame, bridge: DataFrame, key: str) -> DataFrame:
    """Dimension rows without any run."""
    return dimension.join(bridge.select(key), key, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two results has; empty if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
