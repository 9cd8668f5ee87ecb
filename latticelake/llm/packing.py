"""Packing of tokenized documents into sequences of a fixed capacity.

How many pieces there are of each length (at most `capacity` numbers, whatever the input) is
all that planning needs. Pieces above a third of the capacity pair at most twice in a bin: from
the longest down, each takes the longest remaining one that fits beside it. Smaller pieces then
fill the tightest gap that holds them, and what fits nowhere opens new bins. Bins with the same
content are planned together, so the plan is a short table of length ranges; pieces find their
place by their rank within their length, which Spark counts in parallel.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, id_and_text, small_batches, texts_of, written

#: Words whose ids a Python worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
#: Pieces of one length and bucket, about, that one task ranks.
BUCKET = 20_000


class WordTokenizer:
    """Ids of whole texts by a tokenizer that lower-cases and never joins over white space.

    Each distinct word is encoded once by tokenizers; a text's ids are those of its words. To
    meet fewer distinct words, A-Z are lower-cased beforehand (unless combining marks follow
    somewhere, which could compose with a letter, or an added token would come into being) and a full stop or comma after a letter counts
    as a word of its own, as the tokenizer separates it anyway.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens that are found in the text as it stands, before it is lower-cased.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, texts: list[bytes]) -> pa.Array:
        joined = b"\n".join(texts) + b"\n"
        raw, small = np.frombuffer(joined, dtype=np.uint8), joined.lower()
        if not ((raw == 0xCC) | (raw == 0xCD)).any() and all(small.count(t.lower()) == joined.count(t) for t in self.added):
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        stop = (raw == 44) | (raw == 46)
        at = np.flatnonzero(stop[1:] & (raw[:-1] >= 97) & (raw[:-1] <= 122)) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        offsets = np.concatenate([[0], ends + np.searchsorted(at, ends)]).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.insert(raw, at, 32)))
        return pc.ascii_split_whitespace(text)

    def _learn(self, new: list[str]) -> None:
        lines = [new[i:i + 1000] for i in range(0, len(new), 1000)]
        for line, e in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4").tobytes()
            start = np.array([o[0] for o in e.offsets], dtype=np.int64)
            first = np.concatenate([[0], np.cumsum([len(w) + 1 for w in line])])
            cut = np.searchsorted(start, first) * 4
            for w, i, j in zip(line, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                self.known[w] = ids[i:j]

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        words = self._words(texts)
        cut = np.asarray(words.offsets)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = []
        for w in distinct:
            if w not in self.known:
                if w in self.older:
                    self.known[w] = self.older[w]
                else:
                    new.append(w)
        self._learn(new)
        parts = [self.known[w] for w in distinct]
        lens = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, first = np.frombuffer(b"".join(parts), dtype="<u4"), np.concatenate([[0], np.cumsum(lens)])
        at = np.asarray(coded.indices)
        n = lens[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1])] if len(at) else flat[:0]
        bounds = np.concatenate([[0], ends])[cut]
        return [ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and end_id, cut only where longer than capacity."""

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in chunks(texts, 8_000_000):
                rows = []
                for doc_id, ids in zip(b.column(0).slice(i, j - i).to_pylist(), t.encode_batch(texts[i:j]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start:start + capacity]
                        rows.append((doc_id, k, start, len(own), zlib.crc32(own.tobytes()), own.astype(np.int32)))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(columns[c], pa.int64()) for c in (2, 3, 4))]
                if keep_ids:
                    arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(arrays)])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of bins with the same content: ([(length, copies)], bins), from the number of pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[list]] = {}  # by free space: [content, bins]
    free: list[int] = []

    def put(content, bins, gap):
        if bins > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(free, gap)
            gaps[gap].append([content, bins])

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n] > 0:
            k = bisect_left(large, capacity - n + 1) - 1
            while k >= 0 and left[large[k]] == 0:
                k -= 1
            k = min(k, bisect_left(large, n))
            if k >= 0 and large[k] == n and left[n] < 2:  # alone: a shorter partner, if there is one
                k -= 1
                while k >= 0 and left[large[k]] == 0:
                    k -= 1
            m = large[k] if k >= 0 else None
            if m is None:
                put([(n, 1)], left[n], capacity - n)
                left[n] = 0
            elif m == n:
                put([(n, 2)], left[n] // 2, capacity - 2 * n)
                left[n] %= 2
                if left[n]:  # the odd one takes a shorter partner, if there is one
                    shorter = next((x for x in reversed(large[:bisect_left(large, n)]) if left[x]), None)
                    put([(n, 1)] + ([(shorter, 1)] if shorter else []), 1, capacity - n - (shorter or 0))
                    left[n] = 0
                    if shorter:
                        left[shorter] -= 1
            else:
                bins = min(left[n], left[m])
                put([(n, 1), (m, 1)], bins, capacity - n - m)
                left[n] -= bins
                left[m] -= bins
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        while c > 0:
            k = bisect_left(free, n)
            if k == len(free):
                copies = capacity // n
                put([(n, copies)], c // copies, capacity - n * copies)
                if c % copies:
                    put([(n, c % copies)], 1, capacity - n * (c % copies))
                break
            gap = free[k]
            content, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], free[k]
            copies = min(gap // n, c)
            filled = min(bins, c // copies)
            put(content, bins - filled, gap)
            put(content + [(n, copies)], filled, gap - n * copies)
            c -= copies * filled
    return [(content, bins) for groups in gaps.values() for content, bins in groups]


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A null or empty text is its end_id alone. Repeated rows are packed as often as they come;
    rows with a null id are packed too. Each sequence is filled gaplessly from offset 0. Texts of
    any length are cut into pieces; an empty table gives an empty one, and other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut = written(pieces(id_and_text(docs, id_col, text_col), path, capacity, end_id, keep_ids), "pieces")
    n = cut.count()
    buckets = n // BUCKET + 1
    own = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    per = written(own.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows

    # Ranges of ranks within a length, each with its first sequence and its offset there.
    rows, taken, first = [], dict.fromkeys(counts, 0), 0
    for content, bins in plan(counts, capacity):
        at = 0
        for length, copies in content:
            rows.append((length, taken[length], taken[length] + bins * copies, copies, first, at))
            taken[length] += bins * copies
            at += length * copies
        first += bins
    # The number of ranges depends on the capacity alone, not on the number of documents: F.broadcast is safe.
    ranges = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "length long, low long, high long, copies long, first long, at long")
    ranges = F.broadcast(ranges.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "copies", "first", "at"))).alias("ranges")))

    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "bucket", "before")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    placed = own.withColumn("rank", rank).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).join(ranges, "length")
    hit = F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]
    placed = placed.withColumn("hit", hit).withColumn("place", F.col("rank") - F.col("hit.low"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []),
        (F.col("hit.first") + F.floor(F.col("place") / F.col("hit.copies"))).cast("long").alias("sequence_id"),
        (F.col("hit.at") + F.col("place") % F.col("hit.copies") * F.col("length")).cast("long").alias("offset"))
