"""Chat formatting of reply trees.

Messages refer to their parents. Self-joins double the distance that each message sees, so a
path of n messages takes about log2(n) joins up and as many back down. Root-to-leaf paths are
ranked by the sum of their messages' scores, and each chosen one becomes one conversation.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

# The template: each turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.DOTALL)


def escaped(text: Column) -> Column:
    """Backslashes doubled, and a backslash put after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def leaves(nodes: DataFrame, branches: int | None) -> tuple[list[DataFrame], DataFrame]:
    """The jump tables (tree_id, node_id, up, distance 2**k) and the chosen leaves (tree_id, leaf_id, length, score, rank).

    A tree of m messages has no path of more than m, so its rows leave the doubling at a distance of m.
    """
    sizes = nodes.groupBy("tree_id").agg(F.count("*").alias("m"))
    at = nodes.join(sizes, "tree_id").select("tree_id", "node_id", F.col("parent_id").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("n"), "m")
    at = written(at, "jump")
    jumps, ends = [], []
    while True:
        # sum and n cover the messages from node_id up to, but without, `up`.
        jumps.append(at.where("up is not null").select("tree_id", "node_id", "up"))
        far = 2 ** (len(jumps) - 1)
        ends.append(at.where(F.col("m") <= far))
        rest = at.where(F.col("m") > far)
        if not rest.take(1):
            break
        above = rest.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("sum").alias("more"), F.col("n").alias("k"))
        at = rest.join(above, ["tree_id", "up"], "left").select(
            "tree_id", "node_id", F.col("next").alias("up"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"), (F.col("n") + F.coalesce("k", F.lit(0))).alias("n"), "m")
        at = written(at, "jump")
    done = reduce(DataFrame.unionByName, ends).where("up is null")  # the rest lies on or below a cycle
    parents = nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    tips = done.join(parents, ["tree_id", "node_id"], "left_anti").select("tree_id", F.col("node_id").alias("leaf_id"), F.col("n").alias("length"), F.col("sum").alias("score"))
    ranked = tips.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")))
    return jumps, ranked if branches is None else ranked.where(F.col("rank") <= branches)


def cyclic(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id) of the messages on or below a cycle of parent links, which belong to no path; nodes as for format_trees."""
    rows = written(_linked(nodes), "links")
    jumps, _ = leaves(rows.select(F.col("key").alias("tree_id"), "node_id", "parent_id", "score"), 0)
    roots = rows.where("parent_id is null and node_id is not null").select("key", "node_id")
    for jump in reversed(jumps):  # whatever reaches a root, in jumps from the longest to the shortest, is sound
        step = jump.select(F.col("tree_id").alias("key"), F.col("node_id").alias("below"), F.col("up").alias("node_id"))
        roots = written(roots.unionByName(roots.join(step, ["key", "node_id"]).select("key", F.col("below").alias("node_id"))), "sound")
    return rows.where("node_id is not null").join(roots, ["key", "node_id"], "left_anti").select("tree_id", "node_id")


def paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree_id, leaf_id, rank, score, node_id, place) of every message on the chosen root-to-leaf paths; place counts from the root.

    Each jump table adds the messages that lie its distance above those found so far; each
    addition is written, so that the plan stays as long as the number of tables.
    """
    jumps, chosen = leaves(nodes, branches)
    found = [written(chosen.select("tree_id", "leaf_id", "rank", "score", F.col("leaf_id").alias("node_id"), (F.col("length") - 1).alias("place")), "path")]
    for k in reversed(range(len(jumps))):
        so_far = reduce(DataFrame.unionByName, found)
        found.append(written(so_far.join(jumps[k], ["tree_id", "node_id"]).select("tree_id", "leaf_id", "rank", "score", F.col("up").alias("node_id"), (F.col("place") - 2**k).alias("place")), "path"))
    return reduce(DataFrame.unionByName, found)


def _key() -> Column:
    """Joins drop null keys: trees go by a text that null has too."""
    return F.coalesce(F.concat(F.lit("="), F.col("tree_id").cast("string")), F.lit(""))


def _linked(nodes: DataFrame, keyed: bool = False) -> DataFrame:
    """(tree_id, key, node_id, parent_id, score) of each different node; a parent that isn't there is null."""
    links = nodes.where("node_id is not null").select("tree_id", (F.col("tree_id") if keyed else _key()).alias("key"), "node_id", "parent_id", "score")
    links = written(links if keyed else links.dropDuplicates(["key", "node_id"]), "links")
    present = links.select("key", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    return links.join(present, ["key", "parent_id"], "left").select("tree_id", "key", "node_id", F.when(F.col("there"), F.col("parent_id")).alias("parent_id"), "score")


def format_trees(nodes: DataFrame, branches: int | None = None, learn_role: str = "assistant") -> DataFrame:
    """(tree_id, leaf_id, rank, score, formatted, loss_spans) of each chosen path.

    nodes has tree_id, node_id, parent_id (null: a root), role, text and score; node_id is unique
    within its tree, and a parent that isn't there ends a path. Of rows that repeat a node_id, the
    first by parent, score, role and text counts, once; messages on or below a cycle belong to no
    path (`cyclic` lists them), whatever else their tree holds. The best `branches` paths of each
    tree are chosen (None: all), by score and then by the smallest leaf. Null roles, texts and
    scores count as empty and 0; rows with a null tree_id form one tree, rows with a null node_id
    belong to no path. loss_spans are the character ranges [start, end) of formatted that hold the
    texts of learn_role. Other columns are ignored.
    """
    kind = nodes.schema["tree_id"].dataType
    nodes = nodes.select(_key().alias("tree_id"), "node_id", "parent_id", "role", "text", "score")
    # Texts are dealt by tree once: the join below and the grouping after it keep that partitioning.
    nodes.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    ids = nodes.where("node_id is not null").groupBy("tree_id", "node_id").agg(F.count("*").alias("rows")).where("rows > 1")
    if not ids.isEmpty():
        order = Window.partitionBy("tree_id", "node_id").orderBy("parent_id", "score", "role", "text")
        nodes = nodes.withColumn("nth", F.row_number().over(order)).where("nth = 1 or node_id is null").drop("nth")
    linked = written(_linked(nodes, keyed=True), "links").select(F.col("key").alias("tree_id"), "node_id", "parent_id", "score")
    says = nodes.select("tree_id", "node_id", escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce(F.col("role") == learn_role, F.lit(False)).alias("learn"))
    turns = (paths(linked, branches).join(says, ["tree_id", "node_id"]).groupBy("tree_id", "leaf_id", "rank", "score")
             .agg(F.array_sort(F.collect_list(F.struct("place", "role", "text", "learn"))).alias("turns")))
    one = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    fixed = len(OPEN) + len(MIDDLE)

    def step(acc, t):
        begin = acc["at"] + fixed + F.length(t["role"])
        end = begin + F.length(t["text"])
        return F.struct((end + len(CLOSE)).alias("at"), F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    tree = F.when(F.col("tree_id") != "", F.substr(F.col("tree_id"), F.lit(2)).cast(kind)).alias("tree_id")
    return turns.select(tree, "leaf_id", "rank", "score", F.array_join(F.transform("turns", one), "").alias("formatted"), F.aggregate("turns", start, step)["spans"].alias("loss_spans"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def from_turns(rows: DataFrame) -> DataFrame:
    """Nodes of linear conversations (conv_id, turn, role, text): each row replies to the one before it.

    Rows with equal turns follow each other by role, then by a hash of the text; repeated rows
    stay. A null turn comes first; rows with a null conv_id form one conversation.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    return rows.withColumn("tie", F.xxhash64("text")).select(F.col("conv_id").alias("tree_id"), F.row_number().over(w).cast("long").alias("node_id"), "role", "text").select(
        "tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the output."""
    import hashlib

    small_batches(formatted.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for conv, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return formatted.select(F.col("tree_id").alias("conv_id"), "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
