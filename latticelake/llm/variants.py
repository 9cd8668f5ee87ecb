"""Spelling variants: near words found by an edit matrix over sorted lists.

The vocabulary is sorted twice, by word and by reversed word, and cut into ranges; a pair one edit
apart shares its first or its last half, so it meets in one of the lists. Within a range, all
queries walk down the list together: a group of adjacent words with a common prefix (as long as
their LCP) shares one banded row of the edit matrix, and a group whose row exceeds one edit is
skipped with all its words.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, small_batches, texts_of, written

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lower-cased letters that a run can hold, as Latin-1.
LETTERS = bytes([*range(97, 123), *range(0xC0, 0x100)])
#: Words of one range of a sorted list, and queries that walk it together.
RANGE, BLOCK = 8192, 4096
#: From this depth on, groups of one word are compared directly.
DEEP = 64


def counted(docs: DataFrame, shortest: int = 7, noise: int = 31) -> DataFrame:
    """(word, n) of all runs of letters, counted by partition first.

    A run of whose checksum (of `<doc_id>:<run>`, nothing for a null id) `noise` is a divisor
    loses one letter; runs that end up shorter than `shortest` are left out.
    """
    run_of = re.compile(rf"[a-zÀ-ÿ]{{{shortest},}}")

    def run(batches):
        total: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(run_of.findall(raw.translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < shortest:
                            continue
                    total[word] += n
                if len(total) > 100_000:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class SortedList:
    """Distinct Latin-1 words in ascending order, with the LCP of each with the one before."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.start = np.cumsum(self.size) - self.size
        self.buf = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        self.lcp = np.full(len(words), -1)
        open_, d = np.arange(1, len(words)), 0
        while len(open_):
            self.lcp[open_] = d
            open_ = open_[(self.size[open_] > d) & (self.size[open_ - 1] > d)]
            open_ = open_[self.buf[self.start[open_] + d] == self.buf[self.start[open_ - 1] + d]]
            d += 1

    def near(self, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) indices of all pairs one edit apart whose first half, rounded down, of the query is shared.

        A state is a query, a group of words with a common prefix of d letters, and three cells of
        the row of that prefix: the distances to the query's first d - 1, d and d + 1 letters.
        """
        size = np.fromiter(map(len, queries), dtype=np.int64, count=len(queries))
        start = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(queries) + b"\0", dtype=np.uint8)
        half = (size - 1) // 2
        low, high = (np.fromiter(x, dtype=np.int64, count=len(queries)) for x in zip(*(span(self.words, x[:h]) for x, h in zip(queries, half, strict=True)), strict=True)) if queries else (size, size)
        found_q, found_w = [], []
        order = np.argsort(half, kind="stable")
        waiting, d = 0, int(half.min()) if len(queries) else 0
        q = s = e = np.zeros(0, dtype=np.int64)
        left = mid = right = np.zeros(0, dtype=np.uint8)
        while len(q) or waiting < len(order):
            to = int(np.searchsorted(half[order], d, side="right"))
            new = order[waiting:to]
            new, waiting = new[low[new] < high[new]], to
            q, s, e = np.concatenate([q, new]), np.concatenate([s, low[new]]), np.concatenate([e, high[new]])
            one = np.ones(len(new), dtype=np.uint8)
            left, mid, right = np.concatenate([left, one if d else one * 2]), np.concatenate([mid, one * 0]), np.concatenate([right, one])
            # words that end here
            ends = np.flatnonzero(self.size[s] == d)
            k = size[q[ends]] - d
            cell = np.select([k == -1, k == 0, k == 1], [left[ends], mid[ends], right[ends]], 2)
            hit = ends[cell == 1]
            found_q.append(q[hit]), found_w.append(s[hit])
            s = s.copy()
            s[ends] += 1
            go = s < e
            if d >= DEEP:
                alone = np.flatnonzero(go & (e - s == 1))
                hit = np.array([i for i in alone if one_edit(queries[q[i]], self.words[s[i]])], dtype=np.int64)
                found_q.append(q[hit]), found_w.append(s[hit])
                go[alone] = False
            q, s, e, left, mid, right = (x[go] for x in (q, s, e, left, mid, right))
            # groups by the next letter: a row for each, whatever the number of its words
            edge = np.flatnonzero(self.lcp <= d)
            first, last = np.searchsorted(edge, s, side="right"), np.searchsorted(edge, e, side="left")
            many = last - first + 1
            own = np.repeat(np.arange(len(q)), many)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            at = first[own] + nth
            lows = np.where(nth == 0, s[own], edge[np.maximum(at - 1, 0)])
            highs = np.where(nth == many[own] - 1, e[own], edge[np.minimum(at, len(edge) - 1)])
            q, s, e, left, mid, right = q[own], lows, highs, left[own], mid[own], right[own]
            letter = self.buf[self.start[s] + d]
            length, base = size[q], start[q] + d
            differs = [((length <= d + k) | (buf[np.minimum(np.maximum(base + k, 0), len(buf) - 1)] != letter)).astype(np.uint8) for k in (-1, 0, 1)]
            if d == 0:
                differs[0][:] = 2
            row_left = np.where(length >= d, np.minimum(left + differs[0], mid + 1), 2)
            row_mid = np.where(length > d, np.minimum(np.minimum(mid + differs[1], right + 1), row_left + 1), 2)
            row_right = np.where(length > d + 1, np.minimum(right + differs[2], row_mid + 1), 2)
            go = np.minimum(np.minimum(row_left, row_mid), row_right) < 2
            q, s, e = q[go], s[go], e[go]
            left, mid, right = (np.minimum(x[go], 2).astype(np.uint8) for x in (row_left, row_mid, row_right))
            d += 1
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_w])


def span(words: list[bytes], prefix: bytes) -> tuple[int, int]:
    """The part of sorted words that starts with prefix, as (from, to)."""
    stem = prefix.rstrip(b"\xff")
    end = bisect_left(words, stem[:-1] + bytes([stem[-1] + 1])) if stem else len(words)
    return bisect_left(words, prefix), end


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether a and b differ by exactly one letter inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)
    while low < high:  # length of the common prefix
        m = (low + high + 1) // 2
        low, high = (m, high) if a[:m] == b[:m] else (low, m - 1)
    return a[low + (len(a) == len(b)):] == b[low + 1:]


def other_ranges(word: bytes, lows: list[bytes]) -> set[int]:
    """Ranges beside its own that can hold words one edit from word with its first half: none, unless a prefix of it spans ranges."""
    home = lambda x: max(0, bisect_right(lows, x) - 1)
    out: set[int] = set()
    for i in range((len(word) - 1) // 2, len(word) + 1):
        if home(word[:i]) >= span(lows, word[:i])[1] - 1:
            break
        out.add(home(word[:i] + word[i + 1:]))
        for c in LETTERS:
            out |= {home(word[:i] + bytes([c]) + word[i + 1:]), home(word[:i] + bytes([c]) + word[i:])}
    return out - {home(word)}


def _links(vocabulary: DataFrame, n_words: int, backwards: bool, per_range: int) -> tuple[DataFrame, DataFrame]:
    """(word, n_near, best_n, best) of words with near words in one of the two sorted lists, and the written list.

    The list of words owns the pairs that share the first half of the shorter word, the list of
    reversed words all others.
    """
    key = F.reverse("word") if backwards else F.col("word")
    ranges = -(-max(n_words, 1) // per_range)
    ranged = vocabulary.select(key.alias("word"), "n").repartitionByRange(ranges, "word").sortWithinPartitions("word").withColumn("r", F.spark_partition_id())
    ranged = written(ranged, "sorted")
    first = sorted((r.low, r.r) for r in ranged.groupBy("r").agg(F.min("word").alias("low")).collect())
    lows, ids = [x.encode("latin-1") for x, _ in first], [r for _, r in first]

    def route(batches):
        for b in batches:
            rows = [(w, n, ids[r]) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in sorted(other_ranges(w.encode("latin-1"), lows))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32()), strict=True)], names=["word", "n", "r"])

    guests = ranged.select("word", "n").mapInArrow(route, "word string, n long, r int")

    def compared(words: SortedList, counts: np.ndarray, rank: np.ndarray, queries: list[bytes]):
        q, w = words.near(queries)
        half = np.minimum(np.fromiter(map(len, queries), np.int64, len(queries))[q], words.size[w]) // 2
        shared = [queries[i][-h:] == words.words[j][-h:] if backwards else queries[i][:h] == words.words[j][:h] for i, j, h in zip(q.tolist(), w.tolist(), half.tolist(), strict=True)]
        mine = np.array(shared, dtype=bool) != backwards
        q, w = q[mine], w[mine]
        order = np.lexsort((rank[w], -counts[w], q))
        q, w = q[order], w[order]
        at = np.flatnonzero(np.diff(q, prepend=-1))
        text = (lambda x: x[::-1].decode("latin-1")) if backwards else (lambda x: x.decode("latin-1"))
        return pa.RecordBatch.from_arrays([pa.array([text(queries[i]) for i in q[at]], pa.string()), pa.array(np.diff(at, append=len(q)), pa.int64()), pa.array(counts[w[at]], pa.int64()),
                                           pa.array([text(words.words[i]) for i in w[at]], pa.string())], names=["word", "n_near", "best_n", "best"])

    def walk(batches):
        rows = ((r, guest, w.encode("latin-1"), n) for b in batches for w, n, r, guest in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        for _, own in groupby(rows, key=lambda x: x[0]):
            members, counts, queries, words = [], [], [], None
            for _, guest, w, n in own:
                if not guest:
                    members.append(w), counts.append(n)
                    continue
                if words is None:
                    words = SortedList(members)
                    rank = np.argsort(sorted(range(len(members)), key=lambda i: members[i][::-1])) if backwards else np.arange(len(members))
                queries.append(w)
                if len(queries) == BLOCK:
                    yield compared(words, np.array(counts), rank, queries)
                    queries = []
            words = words or SortedList(members)
            rank = np.argsort(sorted(range(len(members)), key=lambda i: members[i][::-1])) if backwards else np.arange(len(members))
            for block in [queries] + [members[i:i + BLOCK] for i in range(0, len(members), BLOCK)]:
                if block:
                    yield compared(words, np.array(counts), rank, block)

    all_rows = ranged.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    dealt = all_rows.repartition(max(ranges, 1), "r").sortWithinPartitions("r", "guest", "word")
    return dealt.mapInArrow(walk, "word string, n_near long, best_n long, best string"), ranged


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, times: int = 10, noise: int = 31, per_range: int = RANGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of `least` occurrences or more.

    form is the near word (one edit) of largest n, of equal ones the smallest, if that n is
    `times` the word's own or more, else null; root is where the forms lead, the word itself
    without a form; n_near counts near words. Only ranges of the vocabulary meet in a task, and a
    prefix that spans ranges sends its words to the ranges that can hold near ones. Null and empty
    texts have no words; words of any length are compared whole; repeated rows count again. An
    empty table gives an empty one; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    vocabulary = written(counted(id_and_text(docs, id_col, text_col), shortest, noise).where(F.col("n") >= least), "vocabulary")
    n_words = vocabulary.count()
    ahead, list_ahead = _links(vocabulary, n_words, False, per_range)
    behind, list_behind = _links(vocabulary, n_words, True, per_range)
    none = F.lit(None)
    rows = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("long").alias("best_n"), none.cast("string").alias("best"))
    for links in (ahead, behind):
        rows = rows.unionByName(links.select("word", none.cast("long").alias("n"), "n_near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), "best")))
    near = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("x"))
    follows = -F.col("x.n") >= times * F.col("n")
    near = written(near.select("word", "n", "n_near", F.when(follows, F.col("x.best")).alias("form"), F.when(follows, -F.col("x.n")).alias("form_n")), "near")
    discard(vocabulary, list_ahead, list_behind)
    roots = written(near.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the number of forms followed; n grows along them, so they end
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(roots)
        roots = step
        if roots.where("moved").isEmpty():
            break
    out = near.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
