"""Corpus pipeline: quality rules, near-duplicates, repeated strings, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of documents. SQL can't
express the stages, so ORACLE_SQL is None and tests compare the result with brute force.

For all stages: an empty table gives an empty one; texts of any length are worked on whole; further
columns stay, whatever their names (the last stage drops them), and none is confused with one of a
stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelake.llm import minhash, packing, quality, repeats, secrets
from latticelake.llm.common import written
from latticelake.llm.queries import vocabulary

ORACLE_SQL = None


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Every row is judged by its own text and language, whatever its id: null and repeated ids and
    repeated rows change nothing. Null and empty texts are rejected; an empty table stays empty.
    """
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id (five words, similarity 0.8).

    Rows that repeat an id with the same text count once; different texts of one id stay or go
    together. Rows with a null id stay. Documents without words have no copies and stay.
    """
    first = minhash.near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that occurred earlier are cut out; documents of which nothing but white space is left go.

    A character of which a cut takes only some bytes goes as a whole. Texts come back from the
    operator with their row's other columns, so no row is looked up by its id: rows with a null
    id stay as they are, repeated rows are cut alike, null texts stay null.
    """
    missing = "no_text"
    while missing in docs.columns:
        missing += "_"
    others = [c for c in docs.columns if c != "text"]
    left = repeats.without_repeats(docs.withColumn(missing, F.col("text").isNull()), length=100, others=[*others, missing], as_text=True)
    out = left.withColumn("text", F.when(~F.col(f"others.`{missing}`"), F.col("kept"))).where("n_removed = 0 or length(trim(text)) > 0")
    column = {c: F.col(f"others.`{c}`").alias(c) for c in others} | {"text": F.col("text")}
    if "n_chars" in others:
        column["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("others.n_chars")).alias("n_chars")
    return out.select(*(column[c] for c in docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, also in rows with null or repeated ids; every row stays."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4,096 tokens; a null text is an empty one, and repeated rows are packed each."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", keep_good_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", remove_repeats),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
