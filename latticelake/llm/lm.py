"""Scoring by a hashed maximum-entropy language model.

A token is predicted in two steps, its class and then the word within the class. Each frequent word
has a place of its own in one of the head classes; all other words are dealt to tail classes by
their hash and have their share of the class by their counts. Features are the previous word, the
word before it (a skip feature) and a hash of both. Spark adds up, over all training documents, how
often each pair of context buckets occurs and each feature with each class and head word. Then
every update is a step along the gradient, observed minus expected counts: tasks compute the
expected counts of their contexts with the broadcast weights, Spark adds them up, and the driver
moves the weights. Texts are scored in numpy batches by three lookups a token and the contexts'
normalisers, without any dense softmax.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, id_and_text, small_batches, texts_of, written
from .textcore import U, Words, mix

CLASS_SIZE = 64
#: Words with a place of their own, the end of a text among them, and words whose counts every task knows.
HEAD, KNOWN = 4096, 65536
HEADS, TAILS = HEAD // CLASS_SIZE, 64
CLASSES = HEADS + TAILS
#: Buckets of a context word where the word within the class is predicted.
COARSE = 32
ROUNDS, RATE = 14, 0.6
#: Numbers of a block in which expected counts travel, and bytes of texts that are worked on at once.
BLOCK, CHUNK = 16384, 500_000


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


class Sizes:
    """Hash table sizes of the model, which grow with the square root of the training tokens.

    They end at most_buckets and most_pairs, as every task holds the weights: 35 MB at the most.
    """

    def __init__(self, tokens: int, most_buckets: int = 1024, most_pairs: int = 65536):
        half = np.log2(max(tokens, 2)) / 2
        self.buckets = int(min(most_buckets, 2 ** max(6, round(half - 5))))
        self.pairs = int(min(most_pairs, 2 ** max(8, round(half - 1))))
        #: Frequent words have a bucket each, others share the rest; the last two are the beginning.
        self.own = self.buckets * 3 // 4
        self.contexts = {"ctx": self.buckets**2, "inner": HEADS * COARSE**2}
        self.weights = {"one": self.buckets * CLASSES, "two": self.buckets * CLASSES, "both": self.pairs * CLASSES, "w_one": COARSE * HEAD, "w_two": COARSE * HEAD}
        self.tables = self.contexts | self.weights
        self.total = sum(self.tables.values())
        self.first = dict(zip(self.tables, np.cumsum([0, *self.tables.values()])[:-1].tolist(), strict=True))

    def pair_bucket(self, b1, b2):
        return (mix((b1 * self.buckets + b2).astype(U)) % U(self.pairs)).astype(np.int64)


class Vocabulary:
    """The most frequent words by hash: their counts, and their place in the model; place 0 is the end of a text."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int):
        rank = np.lexsort((hashes, -counts))
        place = np.full(len(hashes), HEAD, dtype=np.int64)
        place[rank[:HEAD - 1]] = np.arange(1, min(HEAD, len(hashes) + 1))
        order = np.argsort(hashes)
        self.hashes, self.counts, self.place = hashes[order], counts[order], place[order]
        self.head = np.zeros(HEAD)
        self.head[0] = ends
        self.head[self.place[self.place < HEAD]] = self.counts[self.place < HEAD]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are listed, and where."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h, at


def events(t: Words, v: Vocabulary, z: Sizes):
    """Tokens of all texts, each text's end included: doc, place (HEAD: other), class, context buckets; and of the words: known, at."""
    n = len(t.hash)
    known, at = v.find(t.hash)
    place = np.where(known, v.place[at] if len(v.place) else 0, HEAD)
    kind = np.where(place < HEAD, place // CLASS_SIZE, HEADS + (t.hash % U(TAILS)).astype(np.int64))
    bucket = np.where(place <= z.own, place, z.own + 1 + (t.hash % U(z.buckets - z.own - 3)).astype(np.int64))
    # one slot more for each text: its end
    word_slot = np.arange(n) + t.doc
    end_slot = t.first[1:] + np.arange(t.n_docs)
    doc, w, c, b = (np.zeros(n + t.n_docs, np.int64) for _ in range(4))
    doc[word_slot], w[word_slot], c[word_slot], b[word_slot] = t.doc, place, kind, bucket
    doc[end_slot] = np.arange(t.n_docs)
    begin = t.first[:-1] + np.arange(t.n_docs)
    b1 = np.concatenate([[0], b[:-1]])
    b1[begin] = z.buckets - 1
    b2 = np.concatenate([[0], b1[:-1]])
    b2[begin] = z.buckets - 2
    return doc, w, c, b1, b2, known, at


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each word occurs in the training documents, by hash; h null counts those documents."""

    def run(batches):
        for b in batches:
            train = np.array([not held_out(i) for i in b.column(0).to_pylist()], dtype=bool)
            texts = [x for x, ok in zip(texts_of(b.column(1)), train, strict=True) if ok]
            for i, j in chunks(texts):
                h, c = np.unique(Words(texts[i:j], lower=True).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([None, *h.view(np.int64).tolist()], pa.int64()), pa.array(np.concatenate([[j - i], c]))], names=["h", "c"])

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def corpus_sums(docs: DataFrame, shared) -> DataFrame:
    """(i, n): the sums of Sizes.tables over all training documents, in one numbering."""

    def run(batches):
        v, z = shared.value
        total = np.zeros(z.total, dtype=np.int64)

        def add(name, index):
            found, count = np.unique(index, return_counts=True)
            total[z.first[name] + found] += count

        for b in batches:
            train = np.array([not held_out(i) for i in b.column(0).to_pylist()], dtype=bool)
            texts = [x for x, ok in zip(texts_of(b.column(1)), train, strict=True) if ok]
            for i, j in chunks(texts, CHUNK):
                _, w, c, b1, b2, _, _ = events(Words(texts[i:j], lower=True), v, z)
                add("ctx", b1 * z.buckets + b2)
                add("one", b1 * CLASSES + c)
                add("two", b2 * CLASSES + c)
                add("both", z.pair_bucket(b1, b2) * CLASSES + c)
                own = w < HEAD
                w, b1, b2, c = w[own], b1[own] % COARSE, b2[own] % COARSE, c[own]
                add("inner", (c * COARSE + b1) * COARSE + b2)
                add("w_one", b1 * HEAD + w)
                add("w_two", b2 * HEAD + w)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k:k + 50_000]), pa.array(total[at[k:k + 50_000]])], names=["i", "n"])

    return docs.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))


def _normal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of probabilities, and the logarithm of the sum of the unnormalised ones."""
    top = x.max(axis=-1, keepdims=True)
    z = top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True))
    return x - z, z[..., 0]


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows, with repeated places."""
    order = np.argsort(at, kind="stable")
    start = np.flatnonzero(np.diff(at[order], prepend=-1))
    out[at[order][start]] += np.add.reduceat(rows[order], start, axis=0)


class Model:
    """Weights of the class and word features, in float32."""

    def __init__(self, z: Sizes, seen: np.ndarray, head: np.ndarray):
        """seen: observed counts of z.weights, in that order; head: counts of the places."""
        self.z = z
        self.w = np.zeros(sum(z.weights.values()), np.float32)
        prior = seen[:z.weights["one"]].reshape(z.buckets, CLASSES).sum(axis=0)
        self.bias = np.log(prior + 0.01).astype(np.float32)
        self.word_bias = np.log(np.maximum(head, 0.01)).astype(np.float32)
        self.word_bias[(head == 0) & (np.arange(HEAD) > 0)] = -60.0  # places that no word has
        self.norms: dict[int, np.ndarray] = {}

    def part(self, name: str, of: np.ndarray | None = None) -> np.ndarray:
        names, x = list(self.z.weights), self.w if of is None else of
        start = sum(self.z.weights[k] for k in names[:names.index(name)])
        shape = (-1, HEADS, CLASS_SIZE) if name.startswith("w_") else (-1, CLASSES)
        return x[start:start + self.z.weights[name]].reshape(shape)

    def class_logs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms of the class probabilities in the contexts b1 * buckets + b2, and their normalisers."""
        b1, b2 = i // self.z.buckets, i % self.z.buckets
        return _normal(self.bias + self.part("one")[b1] + self.part("two")[b2] + self.part("both")[self.z.pair_bucket(b1, b2)])

    def word_logs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the probabilities of a class's words in the contexts (class * COARSE + g1) * COARSE + g2, and their normalisers."""
        c, g1, g2 = i // COARSE**2, i // COARSE % COARSE, i % COARSE
        return _normal(self.word_bias.reshape(HEADS, CLASS_SIZE)[c] + self.part("w_one")[g1, c] + self.part("w_two")[g2, c])

    def expected(self, kind: np.ndarray, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected counts of all features over the given contexts; kind 0 are those of classes, 1 those of words."""
        out = np.zeros_like(self.w)
        for k in range(0, len(i), 8192):
            at, m, own = i[k:k + 8192], n[k:k + 8192].astype(np.float32)[:, None], kind[k:k + 8192]
            a = at[own == 0]
            if len(a):
                p = np.exp(self.class_logs(a)[0]) * m[own == 0]
                b1, b2 = a // self.z.buckets, a % self.z.buckets
                for name, b in (("one", b1), ("two", b2), ("both", self.z.pair_bucket(b1, b2))):
                    _add_rows(self.part(name, out), b, p)
            a = at[own == 1]
            if len(a):
                p = np.exp(self.word_logs(a)[0]) * m[own == 1]
                c = a // COARSE**2
                for name, g in (("w_one", a // COARSE % COARSE), ("w_two", a % COARSE)):
                    _add_rows(self.part(name, out).reshape(-1, CLASS_SIZE), g * HEADS + c, p)
        return out

    def step(self, seen: np.ndarray, expected: np.ndarray, rate: float = RATE, smooth: float = 2.0) -> None:
        """One step along the gradient, each component over its own scale."""
        gradient = seen - expected
        self.w += (rate * gradient / (np.maximum(seen, expected) + smooth)).astype(np.float32)

    def class_score(self, b1: np.ndarray, b2: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of class c in each context."""
        i = b1 * self.z.buckets + b2
        own = self.bias[c] + self.part("one")[b1, c] + self.part("two")[b2, c] + self.part("both")[self.z.pair_bucket(b1, b2), c]
        return own.astype(np.float64) - self._norm(0, i, self.class_logs)

    def word_score(self, w: np.ndarray, g1: np.ndarray, g2: np.ndarray) -> np.ndarray:
        c, k = w // CLASS_SIZE, w % CLASS_SIZE
        own = self.word_bias[w] + self.part("w_one")[g1, c, k] + self.part("w_two")[g2, c, k]
        return own.astype(np.float64) - self._norm(1, (c * COARSE + g1) * COARSE + g2, self.word_logs)

    def _norm(self, kind: int, i: np.ndarray, logs) -> np.ndarray:
        found = self.norms[kind][i]
        new = np.unique(i[np.isnan(found)])  # contexts that training didn't see
        if len(new):
            for k in range(0, len(new), 8192):
                self.norms[kind][new[k:k + 8192]] = logs(new[k:k + 8192])[1]
            found = self.norms[kind][i]
        return found


def _arrays(table: DataFrame, *columns: str) -> list[np.ndarray]:
    found = table.select(*columns).toArrow()
    return [found.column(c).to_numpy() for c in columns]


def trained(spark, z: Sizes, sums: DataFrame, head: np.ndarray, rounds: int = ROUNDS, parts: int = 8) -> Model:
    """Rounds of gradient steps. Contexts stay a Spark table; observed counts and weights are as many as Sizes says."""
    start = z.first["one"]
    seen = np.zeros(z.total - start)
    at, n = _arrays(sums.where(F.col("i") >= start), "i", "n")
    seen[at - start] = n
    model = Model(z, seen, head)
    kind = (F.col("i") >= z.first["inner"]).cast("int")
    table = written(sums.where(F.col("i") < start).select(kind.alias("kind"), (F.col("i") - F.when(kind == 1, z.first["inner"]).otherwise(0)).alias("i"), "n").repartition(parts), "contexts")

    def gathered(batches):
        columns = [[np.asarray(b.column(k)) for k in range(3)] for b in batches]
        return [np.concatenate(x) for x in zip(*columns, strict=True)] if columns else None

    def added(block: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in block.column("sums").to_pylist())
        return pa.table({"block": block.column("block").slice(0, 1), "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def run(batches, now=now):
            found = gathered(batches)
            if found:
                out = now.value.expected(*found)
                for k in range(0, len(out), BLOCK):
                    if out[k:k + BLOCK].any():
                        yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([out[k:k + BLOCK].astype("<f4").tobytes()], pa.binary())], names=["block", "sums"])

        blocks = table.coalesce(parts).mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(added, "block int, sums binary").toArrow()
        expected = np.zeros_like(seen)
        for k, x in zip(blocks.column("block").to_pylist(), blocks.column("sums").to_pylist(), strict=True):
            own = np.frombuffer(x, "<f4")
            expected[k * BLOCK:k * BLOCK + len(own)] = own
        model.step(seen, expected)
        now.destroy()

    now = spark.sparkContext.broadcast(model)

    def norms(batches):
        found = gathered(batches)
        if found:
            kind, i, _ = found
            for which, logs in ((0, now.value.class_logs), (1, now.value.word_logs)):
                own = i[kind == which]
                for k in range(0, len(own), 8192):
                    part = own[k:k + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), which)), pa.array(part), pa.array(logs(part)[1].astype(float))], names=["kind", "i", "z"])

    kind, i, value = _arrays(table.coalesce(parts).mapInArrow(norms, "kind long, i long, z double"), "kind", "i", "z")
    for which, n in enumerate(z.contexts.values()):
        model.norms[which] = np.full(n, np.nan)
        model.norms[which][i[kind == which]] = value[kind == which]
    now.destroy()
    discard(table)
    return model


def fitted(source: DataFrame):
    """What scoring needs, from all training documents: the table of all word counts, their sums, the vocabulary, and the model with the denominators of the tail classes."""
    spark = source.sparkSession
    counts = written(word_counts(source), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("h").alias("v"), F.coalesce(F.max(F.when(F.col("h").isNull(), F.col("c"))), F.lit(0)).alias("ends")).first()
    n_all, ends = int(total.n), int(total.ends)
    h, c = _arrays(counts.where("h is not null").orderBy(F.desc("c"), "h").limit(KNOWN), "h", "c")
    vocabulary = Vocabulary(h.astype(np.int64).view(U), c.astype(np.int64), ends)
    z = Sizes(n_all)
    shared = spark.sparkContext.broadcast((vocabulary, z))
    sums = written(corpus_sums(source, shared), "sums")
    model = trained(spark, z, sums, vocabulary.head)
    discard(sums)
    shared.destroy()
    # what the tail classes hold: all words but those with a place
    k, n, v = _arrays(counts.where("h is not null").groupBy(F.pmod("h", F.lit(TAILS)).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")), "k", "n", "v")
    held, kinds = np.zeros(TAILS), np.zeros(TAILS)
    held[k.astype(np.int64)], kinds[k.astype(np.int64)] = n, v
    own = vocabulary.place < HEAD
    of = (vocabulary.hashes[own] % U(TAILS)).astype(np.int64)
    held -= np.bincount(of, vocabulary.counts[own], minlength=TAILS)
    kinds -= np.bincount(of, minlength=TAILS)
    tails = np.log10(np.maximum(held, 0) + 0.1 * (np.maximum(kinds, 0) + 1))
    return counts, (n_all, int(total.v) + (ends > 0), ends), vocabulary, model, tails


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Words are runs of non-white-space with A-Z lower-cased, and each text has one end token. The
    model learns from all documents whose crc32(doc_id as text) % 10 is not 0. base_score is the
    add-0.1 unigram score, score the model's; both are sums of log10 probabilities. A null or
    empty text is its end alone. Without training documents the unigram score is 0. Repeated rows
    give repeated rows; a null id counts as the text "None". Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = id_and_text(docs, id_col, text_col)
    counts, (n_all, v_all, ends), vocabulary, model, tails = fitted(source)
    base_log = np.log10(n_all + 0.1 * (v_all + 1))
    shared = spark.sparkContext.broadcast((vocabulary, model))

    def run(batches):
        vocabulary, model = shared.value
        for b in batches:
            texts, ids = texts_of(b.column(1)), b.column(0).to_pylist()
            for i, j in chunks(texts, CHUNK):
                t = Words(texts[i:j], lower=True)
                n = t.n_docs
                doc, w, c, b1, b2, known, at = events(t, vocabulary, model.z)
                logs = model.class_score(b1, b2, c)
                own = w < HEAD
                logs[own] += model.word_score(w[own], b1[own] % COARSE, b2[own] % COARSE)
                logs /= np.log(10)
                logs[~own] -= tails[c[~own] - HEADS]
                count = np.bincount(t.doc, minlength=n)
                of_known = np.log10(vocabulary.counts[at[known]] + 0.1) if known.any() else np.zeros(0)
                base = np.bincount(t.doc[known], of_known, minlength=n) + np.log10(ends + 0.1) - (count + 1) * base_log
                tail = np.zeros(len(known), bool)
                tail[known] = vocabulary.place[at[known]] == HEAD
                whole = np.bincount(doc, logs, minlength=n) + np.bincount(t.doc[tail], np.log10(vocabulary.counts[at[tail]] + 0.1) if tail.any() else None, minlength=n)
                # words that only the table of all counts knows
                rest = np.flatnonzero(~known)
                order = rest[np.lexsort((t.hash[rest], t.doc[rest]))]
                h, d = t.hash[order], t.doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(h)))
                cut = np.searchsorted(d[first], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j], pa.int64()), pa.array([held_out(x) for x in ids[i:j]]), pa.array(count + 1), pa.array(np.bincount(t.doc[known], minlength=n) + (ends > 0)), pa.array(base.astype(float)), pa.array(whole.astype(float)),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "whole", "h", "times"])

    scored = written(source.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, whole double, h array<long>, times array<int>").withColumn("row", F.monotonically_increasing_id()), "scores")
    shared.destroy()
    rest = scored.select("row", F.explode(F.arrays_zip("h", "times")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.times").alias("times"))
    found = rest.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("h", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("whole") + more).alias("score"))
