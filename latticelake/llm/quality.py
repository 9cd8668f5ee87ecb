"""Quality rules by distribution divergence.

A document's histogram of character classes and of common words is compared with the
reference of its language, the sum over that language's documents, by Jensen-Shannon
distance. Counts that need no reference (dup lines, repeated words, symbols) come along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, texts_of, written
from .textcore import Hasher, U, Words, mix

# Frequent words of four languages.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "de la le et les des en un du une que est pour qui dans par sur pas au plus ce il avec "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er "
    "el que los se del las por con una su para al lo como más pero sus este"
).split()

N_CLASSES = 12
_CLASS = np.full(256, 11, dtype=np.int64)
_CLASS[0x80:0xC0] = 0  # inside a code point
_CLASS[0x20] = 1
_CLASS[[9, 10, 11, 12, 13]] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[0xC0:] = 6
_CLASS[[ord("."), ord(",")]] = 7
_CLASS[[ord("!"), ord("?")]] = 8
_CLASS[ord("|")] = 9
_CLASS[[ord(c) for c in "#*$%&<>"]] = 10

_words = sorted(set(COMMON_WORDS))
_listed = Words([w.encode() for w in _words])
_order = np.argsort(_listed.hash)
_LISTED = _listed.hash[_order]
N_WORDS = len(_words) + 1  # the last bin: any other word

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: A reference of fewer words says too little: its documents are judged by the base counts alone.
LEAST_REFERENCE = 1000


def measured(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts and histograms of each text."""
    t = Words(texts)
    n = t.n_docs
    lens = t.doc_end - t.doc_start + 1
    owner = np.repeat(np.arange(n), lens)
    kinds = np.bincount(owner * N_CLASSES + _CLASS[t.buf], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    kinds[:, 2] -= 1  # the line feed that ends each text in the buffer
    kinds[:, 0] = 0
    n_words = np.diff(t.first)
    place = np.minimum(np.searchsorted(_LISTED, t.hash), len(_LISTED) - 1)
    bin_of = np.where(_LISTED[place] == t.hash, _order[place], N_WORDS - 1)
    words = np.bincount(t.doc * N_WORDS + bin_of, minlength=n * N_WORDS).reshape(n, N_WORDS)

    at, value = t.windows(8)
    key = mix(value + mix(t.doc[at].astype(U)))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[back] > 1] if len(at) else at
    cover = np.zeros(len(t.start) + 9, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 8, -1)
    covered = np.flatnonzero(np.cumsum(cover)[:len(t.start)] > 0)
    repeats = np.bincount(t.doc[covered], minlength=n)

    dup_lines = np.zeros(n, dtype=np.int64)
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines[i] = len(lines) - len(set(lines))
    return {"n_words": n_words, "word_chars": kinds[:, 3:].sum(axis=1), "n_symbols": kinds[:, 9] + kinds[:, 10],
            "n_dup_lines": dup_lines, "n_repeat_words": repeats, "kinds": kinds, "words": words}


def _lists(a: np.ndarray) -> pa.ListArray:
    n, k = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(a.astype(np.int32).ravel()))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, counts, kinds, words) of every text; null text counts as empty."""

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(2))
            for i, j in chunks(texts):
                m = measured(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(m[c].astype(np.int64)) for c in COUNTS), _lists(m["kinds"]), _lists(m["words"])],
                    names=["doc_id", "lang", *COUNTS, "kinds", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", kinds array<int>, words array<int>")


def _summed(batches):
    for b in batches:
        langs = np.array(b.column(0).to_pylist(), dtype=object)
        kinds = np.array(b.column(1).flatten()).reshape(len(langs), N_CLASSES)
        words = np.array(b.column(2).flatten()).reshape(len(langs), N_WORDS)
        for lang in set(langs):
            own = langs == lang
            both = np.concatenate([[own.sum()], kinds[own].sum(axis=0), words[own].sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(both)), pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both.astype(np.int64))], names=["lang", "bin", "n"])


def _summed_texts(batches):
    """_summed of the texts (lang, text) that pass the base counts, measured in the same pass: a task needs one Python worker, not two."""
    for b in batches:
        langs, texts = b.column(0), texts_of(b.column(1))
        for i, j in chunks(texts):
            m = measured(texts[i:j])
            ok = np.flatnonzero(~_base_failed(m))
            yield from _summed([pa.RecordBatch.from_arrays([langs.slice(i, j - i).take(pa.array(ok)), _lists(m["kinds"][ok]), _lists(m["words"][ok])], names=["lang", "kinds", "words"])])


SUMS = "lang string, bin int, n long"


def references(profiled: DataFrame) -> DataFrame:
    """(lang, sums): the summed classes and words of each language that has LEAST_REFERENCE words.

    Only documents that pass the base counts take part. Every language has its own row, however
    small its share of the corpus.
    """
    return _references(profiled.where(~base_failed()).select("lang", "kinds", "words").mapInArrow(_summed, SUMS))


def _references(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("sums"))
    n_words = F.aggregate(F.slice("sums", 2 + N_CLASSES, N_WORDS), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.where(n_words >= LEAST_REFERENCE)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts to the reference's row; 0 for empty rows."""
    total = counts.sum(axis=1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(kl.sum(axis=1) / 2, 0, 1)), 0.0)


def distances(kinds: np.ndarray, words: np.ndarray, sums: list) -> tuple[np.ndarray, np.ndarray]:
    """class_js and word_js of texts against their references' sums (None: no reference, distance 0)."""
    known = np.array([x is not None for x in sums], dtype=bool)
    rows = np.array([x for x in sums if x is not None]).reshape(-1, 1 + N_CLASSES + N_WORDS)[:, 1:]
    out = np.zeros(len(known)), np.zeros(len(known))
    for value, counts, ref in zip(out, (kinds, words), (rows[:, :N_CLASSES], rows[:, N_CLASSES:]), strict=True):
        value[known] = js_distance(counts[known], ref / np.maximum(ref.sum(axis=1, keepdims=True), 1))
    return out


def _base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, most_class: float = 0.30, most_sum: float = 0.50, least_chars: int = 200, least_words: int = 50) -> DataFrame:
    """One row per document: counts, class_js, word_js, base_failed, kept.

    A document is rejected if it fails the base counts, if its character classes are further
    than most_class from its language's reference, or if the distances of its classes and of its
    common words together exceed most_sum. The first test needs least_chars characters in words,
    the second least_words words: histograms of shorter texts say little. Null languages count as one
    language. Documents of a language with too few words for a reference have distance 0. Null and empty texts have zero counts and fail the base
    test. Repeated rows give repeated rows; columns other than doc_id, lang and text are ignored.
    """
    small_batches(docs.sparkSession)
    profiled = written(profiles(docs), "profiles")
    # Written, so that Spark knows its size: a small table is broadcast, a large one is shuffled with the profiles.
    refs = written(references(profiled), "references")

    def run(batches):
        for b in batches:
            n = b.num_rows
            kinds = np.array(b.column(1).flatten()).reshape(n, N_CLASSES)
            words = np.array(b.column(2).flatten()).reshape(n, N_WORDS)
            class_js, word_js = distances(kinds, words, b.column(3).to_numpy(zero_copy_only=False).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[4:], pa.array(class_js), pa.array(word_js)], names=["doc_id", *COUNTS, "class_js", "word_js"])

    scored = profiled.join(refs, "lang", "left").select("doc_id", "kinds", "words", "sums", *COUNTS).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", class_js double, word_js double")
    failed = base_failed()
    far = too_far(F.col("word_chars"), F.col("n_words"), F.col("class_js"), F.col("word_js"), most_class, most_sum, least_chars, least_words)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)


def too_far(word_chars, n_words, class_js, word_js, most_class: float = 0.30, most_sum: float = 0.50, least_chars: int = 200, least_words: int = 50):
    """Whether the distances reject a text; for columns and for arrays."""
    return ((word_chars >= least_chars) & (class_js > most_class)) | ((n_words >= least_words) & (class_js + word_js > most_sum))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs (text, lang) that judge() keeps, with all their columns.

    Every row is judged by its own text and its language's reference, in a second pass over the
    texts: no row is looked up by its id, and texts are neither shuffled nor copied.
    """
    small_batches(docs.sparkSession, 256)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    lang, sums = "reference_lang", "reference_sums"
    while {lang, sums} & set(docs.columns):
        lang, sums = lang + "_", sums + "_"
    refs = written(_references(rows.mapInArrow(_summed_texts, SUMS)), "references").toDF(lang, sums)

    @F.arrow_udf("boolean")
    def good(text: pa.Array, sums: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        whole, own = texts_of(text), sums.to_numpy(zero_copy_only=False).tolist()
        for i, j in chunks(whole):
            m = measured(whole[i:j])
            class_js, word_js = distances(m["kinds"], m["words"], own[i:j])
            out[i:j] = ~_base_failed(m) & ~too_far(m["word_chars"], m["n_words"], class_js, word_js)
        return pa.array(out)

    told = docs.join(refs, F.coalesce(docs["lang"].cast("string"), F.lit("")) == refs[lang], "left")
    return told.where(good(F.col("text").cast("string"), F.col(sums))).select(*(docs[f"`{c}`"] for c in docs.columns))
