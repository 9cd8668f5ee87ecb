"""Near-duplicate documents by bottom-k sketches.

One hash function gives every word shingle a value; a document's sketch is its k smallest
values. Documents with the same set become one representative. Inverted lists of retained
values give overlaps, the union of two sketches estimates their Jaccard similarity, and pairs
that may reach the threshold are verified on their full sets.

Lists are kept short without caps. A pair at the threshold shares at least t of its retained
values (t is exact where whole sets are retained, else missed with a probability under 1e-5),
so it meets in the list of one of its k - t + 1 rarest values: values of passages that many
documents share are not indexed. In each list all members are compared with one hub, the
member with the most frequent values, and only members that no verified link has joined are
compared further: directly in short lists, and in long ones by their differences from the hub.
Two members can only be linked if they share a certain number of these differences, which
again is looked up by the rarest of them. So groups of thousands of near copies cost a few rows
for each member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_and_text, small_batches, texts_of, written
from .graph import connected_components
from .textcore import U, Words, mix

#: Lists of up to this length are compared pair by pair where components still differ.
SHORT_LIST = 32
#: Sketches of a pair that is estimated this far below the threshold can't belong to a link.
MARGIN = 0.35


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, n, s1, s2, mins): set size, a 128-bit name of the set, and its k smallest values."""

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in chunks(texts):
                n, s1, s2, mins = [], [], [], []
                for own in Words(texts[i:j], lower=True).shingle_sets(words):
                    n.append(len(own))
                    s1.append(own.sum(dtype=U))
                    s2.append(mix(own ^ U(0x5851F42D4C957F2D)).sum(dtype=U))
                    mins.append(own[:k])
                cut = np.concatenate([[0], np.cumsum([len(x) for x in mins])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), *(pa.array(np.array(s, U).view(np.int64)) for s in (s1, s2)),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(mins).view(np.int64)))],
                    names=["doc_id", "n", "s1", "s2", "mins"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, mins array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, items): each text's sorted distinct shingle values as packed 64-bit integers."""

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in chunks(texts):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([x.tobytes() for x in Words(texts[i:j], lower=True).shingle_sets(words)], pa.binary())], names=["id", "items"])

    return docs.mapInArrow(run, "id long, items binary")


def _packed(x) -> np.ndarray:
    return np.frombuffer(x, dtype=U)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold; or, with differences, every pair with what b lacks and adds."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")

    def linked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = _packed(x), _packed(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def differ(batches):
        for batch in batches:
            size, lacks, adds, items = [], [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = _packed(x), _packed(y)
                less, more = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                size.append(len(x))
                lacks.append(len(less))
                adds.append(len(more))
                items.append(np.concatenate([mix(less ^ U(0xC2B2AE3D27D4EB4F)), more]).view(np.int64))
            cut = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(lacks, pa.int64()), pa.array(adds, pa.int64()), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(items)))],
                names=["a", "b", "size", "lacks", "adds", "items"])

    rows = both.select("a", "b", "items_a", "items_b")
    return rows.mapInArrow(differ, "a long, b long, size long, lacks long, adds long, items array<long>") if differences else rows.mapInArrow(linked, "a long, b long")


def _may_link(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the size bound and the estimate from the k smallest values of both sketches together."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("mins").alias(f"m_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # array_sort puts Spark's signed order on values that the sketch took in unsigned order; the sign bit is turned for that
    flip = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(2**63)).cast("long")))
    union = F.slice(F.array_sort(flip(F.array_union("m_a", "m_b"))), 1, k)
    shared = F.size(F.array_intersect(union, flip(F.array_intersect("m_a", "m_b"))))
    return both.where(shared >= (percent / 100 - MARGIN) * F.size(union)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Two documents are linked if 100 * intersection >= percent * union of their sets of word
    shingles (A-Z lower-cased); component_id is the smallest id that links reach and kept marks
    it. A text with fewer words than a shingle has its whole sequence as one shingle. A null or
    empty text has no shingles and is its own component. Repeated rows give repeated rows; rows
    that share an id count as one node. Rows with a null id are linked with nothing and have no
    component. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = id_and_text(docs, id_col, text_col)
    sk = written(sketches(source, words, k), "sketches")
    named = sk.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    groups = named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    reps = written(named.join(groups.select("rep", "n", "s1", "s2"), ["n", "s1", "s2"]).where("doc_id = rep").select("rep", "n", "mins").dropDuplicates(["rep"]), "representatives")

    # Inverted lists of the rarest retained values.
    full = int(k * percent / 100)
    retained = F.least(F.col("n"), F.lit(k))
    need = F.greatest(F.lit(1), F.when(F.col("n") <= full, F.ceil(F.col("n") * percent / 100)).otherwise(F.ceil(percent / 200 * retained)))
    posted = reps.select("rep", "n", F.explode("mins").alias("v"))
    common = posted.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    indexed = (posted.join(common, "v").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"), F.sum("df").alias("score"))
               .withColumn("places", (retained - need + 1 - (retained - F.size("held"))).cast("int")).where("places > 0")
               .select("rep", "n", "score", F.explode(F.slice("held", F.lit(1), F.col("places"))).alias("x")).select("rep", "score", F.col("x.v").alias("v")))
    indexed = written(indexed, "lists")
    hubs = indexed.groupBy("v").agg(F.max(F.struct("score", (-F.col("rep")).alias("neg"))).alias("top"), F.count("*").alias("length")).where("length > 1").select("v", "length", (-F.col("top.neg")).alias("hub"))
    lists = written(indexed.select("v", "rep").join(hubs, "v"), "lists-hubs")

    involved = lists.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(full_sets(source.join(involved, "doc_id", "left_semi"), words).dropDuplicates(["id"]), "sets")

    # Everyone against the hub of each list.
    first = lists.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(_compared(_may_link(first, reps, k, percent), sets, percent), "links")
    label = written(connected_components(links), "components")
    at = written(lists.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "lists-components")
    apart = at.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("v")
    rest = written(at.where("length > 2").join(apart, "v", "left_semi"), "lists-apart")

    # Short lists: members of different components against each other.
    short = rest.where((F.col("length") <= SHORT_LIST) & (F.col("rep") != F.col("hub"))).select("v", "rep", "component")
    other = short.select("v", F.col("rep").alias("a"), F.col("component").alias("other"))
    direct = short.withColumnRenamed("rep", "b").join(other, "v").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("other"))).select("a", "b").distinct()

    # Long lists: only members that share enough of what sets them apart from the hub.
    # Hubs that links have joined stand for each other: the one with most members takes over the lists of its component.
    long = rest.where(F.col("length") > SHORT_LIST).select("hub", "rep", "component").distinct()
    hub = long.groupBy("hub").agg(F.count("*").alias("m")).join(label.withColumnRenamed("node", "hub"), "hub", "left").select("hub", "m", F.coalesce("component", "hub").alias("of"))
    top = hub.groupBy("of").agg(F.max(F.struct("m", (-F.col("hub")).alias("neg"))).alias("top")).select("of", (-F.col("top.neg")).alias("a"))
    long = long.join(hub.join(top, "of").select("hub", "a", "of"), "hub").where("rep <> a").select("a", "of", F.col("rep").alias("b"), "component").distinct()
    apart = long.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("a")
    long = written(long.join(apart, "a", "left_semi"), "lists-long")
    told = _compared(long.select("a", "b"), sets, percent, differences=True).join(long, ["a", "b"])
    weight = 100 * F.col("lacks") + percent * F.col("adds")
    told = written(told.withColumn("weight", weight).withColumn("slack", (100 - percent) * F.col("size")).withColumn("outside", F.col("weight") > F.col("slack")), "differences")
    # The differences that x and y share, o, must satisfy (100 + percent) * o >= weight_x + weight_y - slack, where a member
    # is outside if its weight is above the slack. So o > weight / (100 + percent) for each of two outside members and for an
    # inside one that an outside one links to; an outside one has only the weaker bound towards an inside one.
    strict = F.floor(F.col("weight") / (100 + percent)) + 1
    loose = F.when(F.col("outside"), F.greatest(F.lit(1), F.ceil((F.col("weight") - F.col("slack")) / (100 + percent)))).otherwise(strict)
    items = told.select("a", "b", "component", "outside", F.size("items").alias("size"), strict.alias("strict"), loose.alias("loose"), (F.col("size") - F.col("lacks") + F.col("adds")).alias("n"), F.explode("items").alias("e"))
    seen = items.groupBy("a", "e").agg(F.count("*").alias("df"), F.max("outside").alias("any")).where("df > 1 and any")
    alone = F.col("size") - F.size("held")
    short_of = (items.join(seen, ["a", "e"]).groupBy("a", "b", "component", "outside", "n", "size", "strict", "loose").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("held"))
                .withColumn("places", (F.col("size") - F.col("loose") + 1 - alone).cast("int")).withColumn("near", F.col("size") - F.col("strict") + 1 - alone).where("places > 0")
                .select("a", "b", "component", "outside", "n", "near", F.posexplode(F.slice("held", F.lit(1), F.col("places"))).alias("pos", "x"))
                .select("a", "b", "component", "outside", "n", (F.col("pos") < F.col("near")).alias("strict"), F.col("x.e").alias("e")))
    short_of = written(short_of, "differences-rare")
    left = short_of.where("outside").select("a", "e", F.col("b").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("strict").alias("sx"))
    meets = ~F.col("outside") | (F.col("sx") & F.col("strict") & (F.col("x") < F.col("b")))
    alike = 100 * F.least("nx", "n") >= percent * F.greatest("nx", "n")
    hidden = left.join(short_of, ["a", "e"]).where((F.col("cx") != F.col("component")) & meets & alike).select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct()

    # A member that is not outside links to a, which its list may not have compared it with.
    taken = told.where(~F.col("outside") & (F.col("component") != F.col("of"))).select("a", "b")

    more = _compared(_may_link(direct.unionByName(hidden).distinct(), reps, k, percent), sets, percent)
    joined = label.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(written(more, "links-more")).unionByName(taken)
    label = connected_components(joined)

    found = groups.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    return (sk.join(found, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
