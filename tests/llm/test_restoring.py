"""Personal data, fill-in-middle and spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from latticelake.llm import disclosure, infill, queries, variants

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
BITS = ["a", "b.c", "@", ".", "_", "%", "+", "1", "23", "4539 1488 0343 6467", "+1 (663) 555-6869", "1.2.3.4", "255", "é", "\n", " ", "-", "x@y.z", "😀", "0"]
SCHEMA = "doc_id long, text string, own string, n long, word string"


@pytest.fixture(scope="module")
def docs(spark, sf, tmp_path_factory):
    """The documents with further rows: nulls, repeats, long texts, and columns whose names the operators use."""
    g = random.Random(3)
    rows = [(-i - 1, "".join(g.choice(BITS) for _ in range(g.randint(0, 40)))) for i in range(400)]
    rows += [(-1001, None), (-1002, ""), (-1003, "<P> inside"), (None, "a null id, me@here.org"), (None, "another null id"), (None, None), (-1004, "twice +1 (663) 555-6869"), (-1004, "twice +1 (663) 555-6869"), (-1004, "twice"), (-1005, "é😀<S" * 60_000), (-1006, "wordwordword " * 20_000), (-1007, "x" * 50_000 + " " + "x" * 50_001)]
    rows += [(-1010 - i, w) for i, w in enumerate(["Planning planning planning planing", "planninng PLANNING planning", "planing planning", "planning planning planning " * 5, "àbcdefgh àbcdefgh Àbcdefgh abcdefgh abcdefgh", "plannin planing"])]
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit("x").alias("own"), F.lit(1).cast("long").alias("n"), F.lit("y").alias("word"))
    path = str(tmp_path_factory.mktemp("docs"))
    own.unionByName(spark.createDataFrame([(d, t, "o", 1, "w") for d, t in rows], SCHEMA)).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, docs):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{docs}/documents.parquet").collect()]


def nothing(spark, path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def entities(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == "email" or k == "ip" and max(map(int, m.group().split("."))) < 256 or k == "card" and 12 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), list(PATTERNS).index(k), m.end(), k))
    return sorted(out)


def test_base_spans(spark, docs, rows):
    got = queries.op11_pii(spark, docs).collect()
    want = []
    for d, t in rows:
        found = entities(t)
        n = collections.Counter(x[3] for x in found)
        want.append((str(d), *(n[k] for k in PATTERNS), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in found))))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)


def test_no_documents(spark, tmp_path):
    path = nothing(spark, tmp_path / "none")
    for f in (queries.op11_pii, queries.op12_fill_in_middle, queries.op13_spelling_variants):
        assert f(spark, path).count() == 0


@pytest.fixture(scope="module")
def letters(spark):
    """A rare name that always stands with one address, the address in further documents, and the name's ending and a common word elsewhere."""
    g = random.Random(9)
    word = lambda: "".join(g.choice("aeiou") + g.choice("bdfgklmnprst") for _ in range(3))
    said = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{said(12)} meeting Ottokar {said(2)} ann.o@mail.example.com {said(9)} Ottokar {said(3)}", "k") for i in range(6)]
    rows += [(100 + i, f"{said(20)} Oregon meeting {said(5)}", "k") for i in range(80)]
    rows += [(200 + i, f"{said(10)} someone{i}@mail.example.com {said(10)}", "k") for i in range(20)]
    rows += [(300, rows[0][1], "k"), (301, None, "k"), (None, rows[1][1], None)]
    return spark.createDataFrame(rows, "doc_id long, text string, marks string")


def test_terms_that_disclose(letters):
    found = {r.doc_id: [(r.text[a.start:a.end], a.form) for a in r.added] for r in disclosure.scan(letters).join(letters, "doc_id").collect()}
    assert all(found[i] == [("Ottokar", "o*"), ("Ottokar", "o*")] for i in [*range(6), 300])
    assert not any(v for k, v in found.items() if k is not None and 6 <= k < 300)


def test_sanitised_texts(letters):
    clean = disclosure.sanitised(letters)
    assert clean.columns == letters.columns and clean.count() == letters.count()
    before = {(r.doc_id, r.marks): r.text for r in letters.collect()}
    for r in clean.collect():
        old = before[r.doc_id, r.marks]
        assert r.text == (old and re.sub(r"[a-z0-9.]+@mail.example.com", "[EMAIL]", old).replace("Ottokar", "o*"))


def test_general_forms_that_disclose_go(spark):
    g = random.Random(4)
    said = lambda: " ".join("".join(g.choice("bcdfgh") + g.choice("aeiou") for _ in range(4)) for _ in range(6))
    docs = spark.createDataFrame([(i, f"{said()} Xaver {said()[:8]} x@y.org {said()}" if i < 5 else said()) for i in range(200)], "doc_id long, text string")
    seen = [a.form for r in disclosure.scan(docs).collect() for a in r.added]
    assert seen == [None] * 5


def formed(doc_id, text):
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, docs, rows):
    got = [tuple(r) for r in queries.op12_fill_in_middle(spark, docs).collect()]
    want = [(d, len(t), *formed(d, t)[:3], sha(formed(d, t)[3]), sha(t)) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_small_chunks_and_whole_outputs(spark, docs, rows):
    source = spark.read.parquet(f"{docs}/documents.parquet").where("length(text) < 3000")
    plain = sorted((str(tuple(r)) for r in infill.digests(source).collect()))
    assert sorted(str(tuple(r)) for r in infill.digests(source, chunk=5).collect()) == plain
    made = infill.outputs(source)
    assert sorted(f"{r.doc_id} {r.output}" for r in made.collect()) == sorted(f"{d} {formed(d, t)[3]}" for d, t in rows if len(t) < 3000 and (d, t) in rows and (t or d not in (-1001, None)))
    back = made.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(f"{r.doc_id} {r.text}" for r in back) == sorted(f"{r.doc_id} {r.text}" for r in source.collect())


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(rows):
    n = collections.Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [] for w in n}
    by = collections.defaultdict(set)  # words that share a word with one letter deleted at the same place, or are that word
    for w in n:
        if len(w) < 1000:
            for i in range(len(w)):
                by[w[:i] + w[i + 1:]].add(w)
    for short, ws in by.items():
        for a in ws:
            near[a] += [b for b in ws if b != a and one_edit(a, b)]
            if short in n:
                near[a].append(short)
                near[short].append(a)
    long = [w for w in n if len(w) >= 1000]
    for a in long:
        near[a] += [b for b in long if one_edit(a, b)]
    form = {}
    for w in n:
        near[w] = set(near[w])
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def test_spelling_variants(spark, docs, rows):
    got = [tuple(r) for r in queries.op13_spelling_variants(spark, docs).collect()]
    want = grouped(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in got)


def test_ranges_of_a_few_words(spark, docs):
    source = spark.read.parquet(f"{docs}/documents.parquet").where("doc_id < 20")
    whole = variants.variants(source, shortest=4)
    assert {tuple(r) for r in variants.variants(source, shortest=4, per_range=40).collect()} == {tuple(r) for r in whole.collect()}


def test_walk_against_all_pairs(monkeypatch):
    g = random.Random(5)
    for deep in (64, 3):
        monkeypatch.setattr(variants, "DEEP", deep)
        for _ in range(25):
            letters = g.choice([b"ab", b"abc", b"abcdef\xe0\xff"])
            make = lambda: bytes(g.choice(letters) for _ in range(g.randint(1, 11)))  # noqa: E731, B023
            words = sorted({make() for _ in range(g.randint(1, 200))})
            asked = words + [make() for _ in range(30)]
            q, w = variants.SortedList(words).near(asked)
            want = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if a[:(len(a) - 1) // 2] == b[:(len(a) - 1) // 2] and one_edit(a, b)}
            assert sorted(zip(q.tolist(), w.tolist(), strict=True)) == sorted(want)
            lows = words[::7]
            home = lambda x: max(0, variants.bisect_right(lows, x) - 1)  # noqa: E731, B023
            for i, a in enumerate(words):
                assert {home(words[j]) for k, j in want if k == i} <= variants.other_ranges(a, lows) | {home(a)}
