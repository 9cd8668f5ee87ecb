"""Removal of repeated byte strings, by ranks of strings of growing length.

A full prefix doubling ranks every byte position. Here the positions to rank are sampled so that
equal windows sample equal places: of each window of the threshold's length, the gram with the
least hash. The first rank of a position is its gram; positions of a gram that occurs once drop
out. From then on a position stands for a range of windows around it, all of which hold a common
string. Every round cuts the ranges, so that the common string grows: 24 bytes, then 62, 91, 98 and
100 of a threshold of 100. Its new rank is that of the pair (rank so far, hash of the bytes added on
either side): Spark counts the distinct pairs, sorts them and numbers those that occur more than
once. A range leaves when its rank is unique, or when an earlier position has all of its windows
too, which is then past the threshold and goes. Equal ranges are collapsed into one row with
their earliest place before every round, so no group of copies multiplies, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, discard, small_batches, texts_of, written
from .textcore import PLACES, Hasher, U, mix

GRAM = 24
#: Contexts of one gram that a map task sends under the gram alone; more are spread by their hash.
SPREAD = 32
#: Windows in a range, round by round.
WIDTHS = (39, 10, 3, 1)
PLACE = ["doc_id", "version", "start"]


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    n = len(x)
    pad = np.full(-(-n // k) * k, np.iinfo(np.uint64).max, U)
    pad[:n] = x
    rows = pad.reshape(-1, k)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - k + 1], left[k - 1:n])


def sampled(texts: list[bytes], length: int):
    """(text index, start in text, gram hash, context hash) of the sampled positions of all texts."""
    keep = [i for i, t in enumerate(texts) if len(t) >= length]
    if not keep:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2
    buf = np.frombuffer(b"".join(texts[i] for i in keep), dtype=np.uint8)
    n, k = len(buf), length - GRAM + 1
    h = Hasher(buf)
    gram = h.grams(GRAM)
    at = np.arange(len(gram))
    bits = U(max(1, int(n).bit_length()))
    low = _sliding_min((gram >> bits << bits) | at.astype(U), k)
    edge = np.cumsum([0] + [len(texts[i]) for i in keep])
    inside = np.ones(n - length + 1, dtype=bool)
    for e in edge[1:-1]:
        inside[max(0, e - length + 1):e] = False
    a = np.unique((low[inside] & ((U(1) << bits) - U(1))).astype(np.int64))
    doc = np.searchsorted(edge, a, side="right") - 1
    lo, hi = np.maximum(a - (length - GRAM), edge[doc]), np.minimum(a + length, edge[doc + 1])
    return np.array(keep)[doc], a - edge[doc], gram[a], h.ranges(lo, hi) + (a - lo).astype(U)


def positions(docs: DataFrame, length: int) -> DataFrame:
    """(g, c, spread, doc_id, version, start, sure, late): sampled positions with the hashes of their gram and context; sure if the gram is repeated for certain, late if an earlier twin was seen."""

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            ids, versions = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for i, j in chunks(texts, 200_000):
                at, start, g, c = sampled(texts[i:j], length)
                # many contexts of one gram: it is repeated for certain, so its rows needn't meet; one of them still goes with the rest
                doc, version = ids[i:j][at].astype(np.int64), versions[i:j][at].astype(np.int32)
                order = np.lexsort((start, version, doc, c, g))
                gs, cs = g[order], c[order]
                new = np.ones(len(gs), dtype=bool)
                new[1:] = (gs[1:] != gs[:-1]) | (cs[1:] != cs[:-1])
                _, group, count = np.unique(gs[new], return_inverse=True, return_counts=True)
                hot = np.zeros(len(gs), dtype=bool)
                hot[new] = count[group] > SPREAD if len(group) else False
                hot = hot[np.maximum.accumulate(np.where(new, np.arange(len(gs)), 0))] if len(gs) else hot
                first = np.ones(len(gs), dtype=bool)
                first[1:] = gs[1:] != gs[:-1]
                spread = np.zeros(len(gs), dtype=np.int64)
                spread[order] = np.where(hot & ~first, (cs >> U(8)).astype(np.int64) | 1, 0)
                sure, late = np.zeros(len(gs), dtype=bool), np.zeros(len(gs), dtype=bool)
                sure[order] = hot
                # a position that has an earlier twin here is settled, and goes anywhere
                if len(gs):
                    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(gs)), 0))]
                    late[order] = (doc[order] != doc[lead]) | (version[order] != version[lead]) | (start[order] != start[lead])  # the same place twice: a repeated row
                spread[late] = mix((doc * 1_000_003 + start)[late].view(U)).view(np.int64) | 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(spread), pa.array(doc), pa.array(version), pa.array(start), pa.array(sure), pa.array(late)], names=["g", "c", "spread", *PLACE, "sure", "late"])

    return docs.mapInArrow(run, "g long, c long, spread long, doc_id long, version int, start long, sure boolean, late boolean")


def _by_group(batches, key: list[int], work):
    """Calls work on the columns of whole groups of rows that are sorted by the columns of key."""
    held = None
    for b in batches:
        held = b if held is None else pa.concat_batches([held, b])
        keys = [np.asarray(held.column(k)) for k in key]
        other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys])) if held.num_rows else []
        if len(other):
            cut = int(other[-1]) + 1
            yield work(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield work(held)


def judged(rows: DataFrame) -> DataFrame:
    """(doc_id, version, start, g, done): positions of repeated grams; done if an earlier position has the same context."""

    def work(b):
        g, c, spread, doc, version, start, sure, late = (np.asarray(x) for x in b.columns)
        new_g = np.ones(len(g), dtype=bool)
        new_g[1:] = (g[1:] != g[:-1]) | (spread[1:] != spread[:-1])
        new_c = new_g.copy()
        new_c[1:] |= c[1:] != c[:-1]
        group = np.cumsum(new_g) - 1
        kinds = np.bincount(group[new_c])
        lead = np.maximum.accumulate(np.where(new_c, np.arange(len(g)), 0))
        done = (doc != doc[lead]) | (version != version[lead]) | (start != start[lead]) | late
        # a leading row of a sure gram may itself be done; its group stays active all the same
        active = ~done & ((kinds[group] > 1) | (np.bincount(group, sure)[group] > 0))
        keep = done | active
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, version, start, g)] + [pa.array(done[keep])], names=[*PLACE, "g", "done"])

    ordered = rows.repartition("g", "spread").sortWithinPartitions("g", "spread", "c", *PLACE)
    return ordered.mapInArrow(lambda batches: _by_group(batches, [0, 2], work), "doc_id long, version int, start long, g long, done boolean")


def _squeezed(docs: DataFrame, others: list[str]) -> DataFrame:
    """(doc_id, z, version, others): texts compressed before they are shuffled."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t) for t in texts_of(b.column(1))], pa.binary()), *b.columns[2:]], names=["doc_id", "z", "version", *others])

    out = T.StructType([*T.StructType.fromDDL("doc_id long, z binary, version int"), *(docs.schema[c] for c in others)])
    return docs.select("doc_id", "text", "version", *others).mapInArrow(run, out)


def contexts(squeezed: DataFrame, active: DataFrame, length: int) -> DataFrame:
    """(doc_id, version, start, rank, low, left, bytes): what lies around each active position, which starts at `left` of bytes; its range of windows starts at 0."""

    def run(batches):
        z = zstandard.ZstdDecompressor()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            out = [[] for _ in kinds]
            for doc_id, version, raw, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = z.decompress(raw)
                for x in at:
                    lo = max(0, x["start"] - (length - GRAM))
                    for column, v in zip(out, (doc_id, version, x["start"], x["g"], 0, x["start"] - lo, text[lo:x["start"] + length]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=[*PLACE, "rank", "low", "left", "bytes"])

    lists = active.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "g")).alias("at"))
    return squeezed.select("doc_id", "version", "z").join(lists, ["doc_id", "version"]).select("doc_id", "version", "z", "at").mapInArrow(run, "doc_id long, version int, start long, rank long, low int, left int, bytes binary")


def pairs(around: DataFrame, width: int, narrow: int, length: int) -> DataFrame:
    """(rank, added, full, doc_id, version, start, low, first, last): ranges of `width` windows cut into ranges of `narrow`.

    Window o starts o bytes left of its position; a range holds the windows from low on. All of
    them have a string in common; rank stands for what the wider range had in common, added for
    the bytes that come to it. first and last are the windows of the range that lie within the
    text, full is the hash of all their bytes.
    """
    most = length - GRAM

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rank, low, left = (np.asarray(b.column(k)) for k in (3, 4, 5))
            content = b.column(6)
            size = np.array([len(x) for x in content.to_pylist()], dtype=np.int64)
            joined = np.frombuffer(b"".join(content.to_pylist()), dtype=np.uint8)
            h, at = Hasher(joined), np.concatenate([[0], np.cumsum(size)])[:-1] + left
            from_o, to_o = np.maximum(0, length - (size - left)), np.minimum(most, left)
            outer = np.minimum(low + width - 1, most)
            step = np.arange(width, dtype=U) * PLACES[2]
            for x in range(0, width, narrow):
                lo = low + x
                hi = np.minimum(np.minimum(lo + narrow - 1, outer), most)
                first, last = np.maximum(lo, from_o), np.minimum(hi, to_o)
                own = np.flatnonzero((lo <= outer) & (first <= last))
                if not len(own):
                    continue
                p, a, z, f, t = at[own], lo[own], hi[own], first[own], last[own]
                added = h.ranges(p - a, p - low[own]) * PLACES[0] + h.ranges(p + length - outer[own], p + length - z) * PLACES[1] + step[x]
                full = h.ranges(p - t, p + length - f) * PLACES[3] + f.astype(U) * PLACES[4] + t.astype(U) * PLACES[5]
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [b.column(3).take(rows), pa.array(mix(added).view(np.int64)), pa.array(mix(full).view(np.int64)), *(b.column(k).take(rows) for k in range(3)), *(pa.array(v.astype(np.int32)) for v in (a, f, t))],
                    names=["rank", "added", "full", *PLACE, "low", "first", "last"])

    columns = [*PLACE, "rank", "low", "left", "bytes"]
    return around.select(*columns).mapInArrow(run, "rank long, added long, full long, doc_id long, version int, start long, low int, first int, last int")


def reranked(classes: DataFrame) -> DataFrame:
    """(rank, added, next): the pairs that more than one class has, sorted and numbered in that order."""
    shared = classes.groupBy("rank", "added").agg(F.count("*").alias("n")).where("n > 1")
    return shared.orderBy("rank", "added").select("rank", "added", F.monotonically_increasing_id().alias("next"))


def later_windows(around: DataFrame, length: int) -> list[DataFrame]:
    """(doc_id, version, low, high) of every round: the bytes of ranges all windows of which start earlier too."""
    out, width = [], length - GRAM + 1
    widths = [w for w in WIDTHS if w < width]
    for narrow in widths:
        rows = written(pairs(around, width, narrow, length), "pairs")
        place = F.struct(*PLACE)
        classes = written(rows.groupBy("rank", "added", "full").agg(F.min(place).alias("place"), (F.min(place) != F.max(place)).alias("more"), F.first("low").alias("low")), "classes")
        many = classes.where("more").select("rank", "added", "full", "place")
        late = rows.join(many, ["rank", "added", "full"]).where(place != F.col("place"))
        out.append(written(late.select("doc_id", "version", (F.col("start") - F.col("last")).alias("low"), (F.col("start") - F.col("first") + length).alias("high")), "late"))
        if narrow > 1:
            ranks = written(reranked(classes), "ranks")
            open_ = classes.join(ranks, ["rank", "added"]).select("place.*", F.col("next").alias("rank"), "low")
            wider, around = around, written(around.select(*PLACE, "left", "bytes").dropDuplicates(PLACE).join(open_, PLACE).select(*PLACE, "rank", "low", "left", "bytes"), "open")
            discard(wider, ranks)
        else:
            discard(around)
        discard(rows, classes)
        width = narrow
    return out


def cut_out(text: bytes, spans) -> tuple[bytes, int]:
    """What is left of text without the given [low, high) spans, and how many runs they make."""
    out, at, runs = [], 0, 0
    end = None
    for low, high in sorted(spans):
        if end is None or low > end:
            if end is not None:
                at = end
            out.append(text[at:low])
            runs += 1
            end = high
        else:
            end = max(end, high)
    out.append(text[end if end is not None else 0:])
    return b"".join(out), runs


def _versions(docs: DataFrame) -> DataFrame:
    """docs with a column version that numbers the different texts of one id; it is 0 but for ids that have several."""
    h = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("least"), F.max(h).alias("most")).where("least <> most").select("doc_id")
    several = written(several, "several")
    if several.isEmpty():
        return docs.withColumn("version", F.lit(0))
    w = Window.partitionBy("doc_id").orderBy("h")
    numbered = written(docs.withColumn("h", h).join(several, "doc_id").select("doc_id", "h").distinct().withColumn("version", F.row_number().over(w)), "versions")
    return docs.withColumn("h", h).join(numbered, ["doc_id", "h"], "left").withColumn("version", F.coalesce("version", F.lit(0))).drop("h")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, others: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept are the remaining bytes.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document of
    smaller id, or earlier in the same one. All texts are judged as they came in. A null or empty
    text has no bytes. Repeated rows count as one document and give repeated rows; different texts
    of one id count as documents that follow each other by a hash. Rows with a null id keep all
    their bytes. The columns named in others come along as struct `others`; the rest is ignored.
    With as_text, kept is a string, in which characters that lost some of their bytes are left out.
    """
    small_batches(docs.sparkSession, 512)
    carried = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("others")] if others else []
    source = _versions(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *carried))
    marks = written(judged(positions(source.where("doc_id is not null").select("doc_id", "text", "version"), length)), "positions")
    active = marks.where("not done").select(*PLACE, "g").distinct()
    squeezed = _squeezed(source, ["others"] if others else [])
    late = later_windows(written(contexts(squeezed, active, length), "contexts"), length)
    spans = marks.where("done").select("doc_id", "version", F.greatest(F.lit(0), F.col("start") - (length - GRAM)).alias("low"), (F.col("start") + length).alias("high"))
    for found in late:
        spans = spans.unionByName(found)
    lists = spans.groupBy("doc_id", "version").agg(F.collect_set(F.struct("low", "high")).alias("spans"))

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            n, gone, runs, kept = [], [], [], []
            for raw, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = z.decompress(raw)
                left, k = cut_out(text, [(x["low"], min(x["high"], len(text))) for x in found or []])
                n.append(len(text))
                gone.append(len(text) - len(left))
                runs.append(k)
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64()) for v in (n, gone, runs)), pa.array(kept, pa.string() if as_text else pa.binary()), *b.columns[3:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *extra])

    extra = ["others"] if others else []
    out = T.StructType([*T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary")), *(squeezed.schema[c] for c in extra)])
    return squeezed.join(lists, ["doc_id", "version"], "left").select("doc_id", "z", "spans", *extra).mapInArrow(run, out)
