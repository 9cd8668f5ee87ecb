"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Rules find the protected entities: e-mail addresses, IP addresses, card and phone numbers. The
corpus then tells how strongly other terms reveal them: with PMI(e; t) of an entity and a term
near it, and the entity's information content IC(e) = -log2 p(e), a term discloses the entity if
PMI(e; t) >= alpha * IC(e), that is, if knowing the term leaves little to learn. Such a term is
generalised where its general form (first letter, or first digit and length) does not disclose
the entity itself, and removed otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone", "term")
#: Java patterns of the rules. Possessive and anchored where a match stopped or a run begins: each text is read in linear time.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of the kind has.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
WORD = r"[\p{L}\p{N}]+"
#: Matches that are added up together.
BLOCK = 256
SPAN = "struct<kind:string,start:long,end:long,entity:string,near:array<string>>"
PLAIN = "array<struct<kind:string,start:long,end:long>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    place = F.split(F.reverse(digits), "")

    def weighed(d: Column, i: Column) -> Column:
        twice = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.filter(place, lambda d: d != ""), weighed), F.lit(0), lambda a, d: a + d) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(12, 19), _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
#: One name for all spellings of an entity.
ENTITY = {"email": F.lower, "ip": lambda m: m, "card": _digits, "phone": _digits}


def _walk(blocks: str, made, kept, out: str) -> Column:
    """The spans made(match struct, start) of the kept matches, from blocks of (text before, match, text after).

    Starts add up the lengths of all that comes before. Spans are gathered block by block, so
    that the work stays far from the square of their number.
    """
    size = lambda x: F.length(x["before"]) + F.length(x["match"])

    def within(block: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.length(x["before"])
            spans = F.when(kept(x["match"]), F.concat(acc["spans"], F.array(made(x, at)))).otherwise(acc["spans"])
            return F.struct((acc["at"] + size(x)).cast("long").alias("at"), spans.alias("spans"))

        return F.aggregate(block, F.struct(start.cast("long").alias("at"), F.array().cast(f"array<{out}>").alias("spans")), step, lambda acc: acc["spans"])

    def step(acc: Column, block: Column) -> Column:
        length = F.aggregate(block, F.lit(0).cast("long"), lambda n, x: n + size(x))
        return F.struct((acc["at"] + length).alias("at"), F.concat(acc["spans"], F.array(within(block, acc["at"]))).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{out}>>").alias("spans"))
    return F.aggregate(blocks, start, step, lambda acc: F.flatten(acc["spans"]))


def _with_matches(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """rows and, for each pattern, the array `m_<name>` of blocks of (before, match, after) of all its matches in text.

    inline() evaluates the arrays once for each row; as mere columns they would be computed again for every element that a lambda looks up.
    """
    lists = []
    for k, p in patterns.items():
        here = F.contains("text", F.lit(NEEDS[k])) if k in NEEDS else F.lit(True)
        lists += [F.when(here, F.split("text", p, -1)).alias(f"p_{k}"), F.when(here, F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"f_{k}")]
    parts = rows.select("*", F.inline(F.array(F.struct(*lists))))
    zipped = []
    for k in patterns:
        n = F.size(f"f_{k}")
        whole = F.arrays_zip(F.slice(f"p_{k}", F.lit(1), n).alias("before"), F.col(f"f_{k}").alias("match"), F.slice(f"p_{k}", F.lit(2), n).alias("after"))
        zipped.append(F.when(n > 0, whole).alias(f"z_{k}"))
    parts = parts.select(*rows.columns, F.inline(F.array(F.struct(*zipped))))
    none = F.array().cast("array<array<struct<before:string,match:string,after:string>>>")

    def cut(k: str) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(f"z_{k}") - 1) / BLOCK).cast("int"))
        return F.coalesce(F.transform(numbers, lambda b: F.slice(f"z_{k}", b * BLOCK + 1, F.lit(BLOCK))), none).alias(f"m_{k}")

    blocks = [cut(k) for k in patterns]
    return parts.select(*rows.columns, F.inline(F.array(F.struct(*blocks))))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """(doc_id, own, base): per row, the digest of its text and the entities that the rules find, each with the words near it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    matches = _with_matches(rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("own")), PATTERNS)
    words = lambda part: F.regexp_extract_all(F.lower(part), F.lit(WORD), F.lit(0))

    def made(kind: str):
        def span(x: Column, at: Column) -> Column:
            near = F.concat(F.slice(F.reverse(words(x["before"])), 1, window), F.slice(words(x["after"]), 1, window))
            return F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("start"), (at + F.length(x["match"])).cast("long").alias("end"), F.concat(F.lit(f"{kind}:"), ENTITY[kind](x["match"])).alias("entity"), near.alias("near"))

        return span

    return matches.select("doc_id", "own", F.concat(*(_walk(f"m_{k}", made(k), VALID[k], SPAN) for k in PATTERNS)).alias("base"))


def general(term: Column) -> Column:
    """First digit and length of a number, first letter of anything else; no form is a term itself."""
    return F.when(term.rlike("^[0-9]+$"), F.concat(F.substring(term, 1, 1), F.repeat(F.lit("#"), F.length(term) - 1))).otherwise(F.concat(F.substring(term, 1, 1), F.lit("*")))


def _terms(words: Column) -> Column:
    """Words of three characters or more, and their general forms, each once."""
    long = F.filter(words, lambda w: F.length(w) >= 3)
    return F.array_distinct(F.concat(long, F.transform(long, general)))


def disclosing(docs: DataFrame, base: DataFrame, text_col: str = "text", alpha: float = 0.95, support: int = 3, few: int = 100_000) -> DataFrame:
    """(entity, term, form, pmi, ic): terms that disclose an entity, and their general form where that discloses less (else null).

    p(e), p(t) and p(e, t) count rows of all documents: those with the entity, with the term, and
    with the term near the entity. A pair counts only if it stands in `support` different
    contexts (windows of words) at least, as copies of a text are no evidence.
    """
    texts = base.groupBy("own").agg(F.count("*").alias("n"), F.first("base").alias("base")).select("own", "n", F.explode("base").alias("x"))
    near = texts.select("own", "n", "x.entity", F.xxhash64("x.near").alias("context"), F.explode(_terms(F.col("x.near"))).alias("term")).distinct()
    pairs = near.groupBy("entity", "term", "own").agg(F.first("n").alias("n"))
    contexts = near.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= support)
    both = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both"))
    candidates = written(contexts.join(both, ["entity", "term"]).select("entity", "term", "n_both"), "candidates")
    terms = written(candidates.select("term").distinct(), "terms")
    n_terms = terms.count()
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
    said = docs.select(F.explode(_terms(words)).alias("term")) if n_terms else terms
    if n_terms <= few:  # small for certain: filter while reading; else count first and join the counts
        n_docs = said.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    else:
        n_docs = said.groupBy("term").agg(F.count("*").alias("n_term")).join(terms, "term", "left_semi")
    entities = texts.select("own", "n", "x.entity").distinct().groupBy("entity").agg(F.sum("n").alias("n_entity"))
    total = base.count()
    ic = F.log2(F.lit(total) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    told = written(candidates.join(n_docs, "term").join(entities, "entity").select("entity", "term", pmi.alias("pmi"), ic.alias("ic")).where((F.col("ic") > 0) & (F.col("pmi") >= alpha * F.col("ic"))), "disclosing")
    forms = told.select("entity", F.col("term").alias("form"), F.lit(True).alias("also"))
    whole = told.where(~F.col("term").rlike(r"[*#]$")).withColumn("form", general(F.col("term")))
    return whole.join(forms, ["entity", "form"], "left").select("entity", "term", F.when(F.col("also").isNull(), F.col("form")).alias("form"), "pmi", "ic")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, alpha: float = 0.95, support: int = 3) -> DataFrame:
    """(doc_id, own, base, added): per row, the spans of the rules and the terms that disclose an entity of the same text.

    Spans are structs of kind, start and end in code points (exclusive), added ones with the
    general form of the term, null where the term has to go. A term is added wherever it stands
    in a text with the entity, but not inside a span of the rules. own is the digest of the text.
    Null and empty texts have no spans; texts of any length are read whole; rows with null or
    repeated ids and repeated rows are judged by their text alone. An empty table gives an empty
    one, and other columns are ignored.
    """
    base = written(found(docs, id_col, text_col, window), "entities")
    told = written(disclosing(docs, base, text_col, alpha, support).select("entity", "term", "form"), "told")
    held = base.select("own", F.explode("base").alias("x")).select("own", "x.entity").join(told.select("entity").distinct(), "entity", "left_semi").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    touched = docs.select(text.alias("text"), F.unhex(F.md5(text)).alias("own"))
    touched = (touched.join(held.select("own").distinct(), "own", "left_semi") if not told.isEmpty() else touched.where("false")).dropDuplicates(["own"])
    token = lambda x, at: F.struct(at.cast("long").alias("start"), (at + F.length(x["match"])).cast("long").alias("end"), F.lower(x["match"]).alias("term"))
    tokens = _with_matches(touched, {"word": WORD}).select("own", F.explode(_walk("m_word", token, lambda m: F.length(m) >= 3, "struct<start:long,end:long,term:string>")).alias("x")).select("own", "x.*")
    hits = tokens.join(told, "term").join(held, ["own", "entity"], "left_semi")
    spans = hits.groupBy("own", "start", "end").agg(F.min(F.struct(F.col("form").isNotNull().alias("k"), "form")).alias("x"))
    spans = spans.groupBy("own").agg(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", F.col("x.form").alias("form"))).alias("added"))
    plain = F.transform("base", lambda x: F.struct(x["kind"], x["start"], x["end"])).cast(PLAIN)
    out = base.select("doc_id", "own", plain.alias("base")).join(spans, "own", "left")
    free = F.filter(F.coalesce("added", F.array()), lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return out.select("doc_id", "own", "base", free.alias("added"))


def ordered(spans: Column) -> Column:
    """Spans by start, then by kind as listed, then by end."""
    place = F.array(*(F.lit(k) for k in KINDS))
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], F.array_position(place, x["kind"]).alias("place"), x["end"], x["kind"].alias("kind"))))


def sanitised(docs: DataFrame, text_col: str = "text", window: int = 8, alpha: float = 0.95, support: int = 3) -> DataFrame:
    """docs with every entity of text replaced by its kind in brackets, and every disclosing term by its general form or by [...].

    Of spans that overlap, the first one stands for all. Rows are matched by the digest of their
    text, so null and repeated ids change nothing; null texts stay null, all other columns stay.
    """
    spans = scan(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")), window=window, alpha=alpha, support=support)
    mark = lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
    base = F.transform("base", lambda x: F.struct(x["start"], x["end"], mark(x).alias("mark")))
    added = F.transform("added", lambda x: F.struct(x["start"], x["end"], F.coalesce(x["form"], F.lit("[...]")).alias("mark")))
    marks = spans.dropDuplicates(["own"]).select("own", F.array_sort(F.concat(base, added)).alias("marks")).where(F.size("marks") > 0)
    own, names = F.unhex(F.md5(F.col(f"`{text_col}`").cast("string"))), [c for c in docs.columns]
    key, said = "own", "marks"
    while key in names or said in names:
        key, said = key + "_", said + "_"
    joined = docs.withColumn(key, own).join(marks.select(F.col("own").alias(key), F.col("marks").alias(said)), key, "left")
    text = F.col(f"`{text_col}`").cast("string")

    def step(acc: Column, x: Column) -> Column:
        skip = x["start"] < acc["at"]
        before = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], before, x["mark"])).alias("out"))

    clean = F.aggregate(said, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    joined = joined.withColumn(key, F.when(F.col(said).isNotNull(), clean).otherwise(text))
    return joined.select(*(F.col(key).alias(c) if c == text_col else F.col(f"`{c}`") for c in names))
