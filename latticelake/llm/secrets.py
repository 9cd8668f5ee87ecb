"""Secret scans: fixed rules, and a small character convolutional network over every other candidate.

The network learns from all labelled findings: those of the rules, runs of the corpus with a
harmless shape, and planted ones, secrets of many kinds and hard negatives that are set into the
contexts of the corpus. It sees the candidate and its context as characters. Each round, every part
of the examples is gone through by a task in numpy, and the parts' networks are averaged. A
candidate of unknown kind is added if its calibrated score reaches the highest threshold that
recalls the wanted share of held-out findings, raised if need be until enough of what passes are
findings. Runs of a harmless shape are never added.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, id_and_text, small_batches, texts_of, written

# Fixed patterns of the rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")
#: Part of every keyword of ASSIGN, lower-cased.
HINTS = ("passw", "secret", "token", "api")

#: Runs that may be secrets, whatever stands before them, and runs beside a key-like name.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9@])[A-Za-z0-9+/_](?:[A-Za-z0-9+/_=.~-]{12,})[A-Za-z0-9=](?![A-Za-z0-9@])")
NAMED = re.compile(r"""(?<![A-Za-z0-9])(?:(?:bearer|basic)[\x20:]\x20*|(?:[A-Za-z]++[_-])?(?:key|auth|authorization|credentials?|pwd|pass(?:phrase|code)|jwt|session(?:_?id)?|signature|cookie)["']?\x20*[:=]\x20*)["']?([A-Za-z0-9+/_.=~-]{8,})""", re.ASCII | re.IGNORECASE)
#: Enough variety for a secret: a digit, or three changes of case.
VARIED = re.compile(r"[0-9]|[a-z][A-Z].*[a-z][A-Z]|[A-Z][a-z][A-Z]")
#: Shapes of what is no secret: numbers, plain words and short numbers joined by marks (paths, hosts, dates, versions), camel case, one character repeated, identifiers of 8-4-4-4-12.
HARMLESS = re.compile(
    r"[0-9.:/+_=~-]+|(?:[A-Za-z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8})(?:[._/=+~-]+(?:[A-Za-z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8}))*[._/=+~-]*"
    r"|[A-Za-z]?[a-z]+(?:[A-Z][a-z]{2,})+[0-9]{0,4}|(.)\1*|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PLAIN_WORD = re.compile(r"[A-Za-z]{12,}")

BEFORE, INSIDE, AFTER = 12, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Planted runs of either label, each shown once at least; examples that a task learns from at once; rounds over all of them, however many parts they make.
PLANTED, PART, ROUNDS = 1500, 50_000, 6


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the rules, sorted by start, then by kind as listed."""
    found = []
    small = text.lower()
    if any(h in small for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _pieces(text: str, start: int, end: int) -> list[str]:
    """The whole candidate in pieces of INSIDE characters, each with its context at fixed places, padded with NUL."""
    out = []
    for s in range(start, max(end, start + 1), INSIDE):
        e = min(end, s + INSIDE)
        out.append(text[max(0, s - BEFORE):s].rjust(BEFORE, "\0") + text[s:e].ljust(INSIDE, "\0") + text[e:e + AFTER].ljust(AFTER, "\0"))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, window, label) of every piece of every candidate: 1 a rule's finding, 0 harmless by its shape, -1 unknown.

    Candidates are runs of 14 characters and more with a digit or changes of case, and runs of 8
    and more beside a key-like name. One plain word of each text, that of the least checksum, is a
    harmless example too.
    """
    found = [(s, e, w, 1) for _, s, e in base for w in _pieces(text, s, e)]
    free = lambda s, e: not any(s < y and x < e for _, x, y in base)
    named = {m.span(1) for m in NAMED.finditer(text) if free(*m.span(1))}
    runs = {m.span() for m in CANDIDATE.finditer(text) if VARIED.search(text, *m.span()) and free(*m.span()) and not any(m.start() < y and x < m.end() for x, y in named)}
    for s, e in sorted(named | runs):
        label = 0 if HARMLESS.fullmatch(text, s, e) else -1
        found += [(s, e, w, label) for w in _pieces(text, s, e)]
    plain = min(PLAIN_WORD.finditer(text), key=lambda m: zlib.crc32(m.group().encode()), default=None)
    if plain:
        found += [(*plain.span(), w, 0) for w in _pieces(text, *plain.span())]
    return found


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
NAMES = ("Authorization: Bearer ", "private_key = ", "access-key: ", "client_key=", "pwd: ", "passphrase = ", "session_id=", "signature: ", "key=", "auth = ", "jwt: ")


def planted(g: np.random.Generator, n: int) -> list[tuple[str, str, int]]:
    """n secrets (name before, run, 1) of many kinds and n hard negatives (name before, run, 0)."""
    run = lambda letters, low, high: "".join(g.choice(list(letters), int(g.integers(low, high))))
    word = lambda: run(LOWER, 3, 9)
    pick = lambda x: x[int(g.integers(len(x)))]
    secret = [lambda: run(LOWER + UPPER + DIGITS, 20, 48), lambda: run(LOWER + UPPER + DIGITS + "+/", 24, 64) + "=" * int(g.integers(0, 3)), lambda: f"{pick(('sk', 'pk', 'gh', 'xo', 'rk'))}{pick('_-')}{run(LOWER + UPPER + DIGITS, 24, 40)}",
              lambda: ".".join(run(LOWER + UPPER + DIGITS + "_-", 16, 30) for _ in range(3)), lambda: run(DIGITS + "ABCDEF", 24, 48), lambda: run(UPPER + DIGITS, 20, 40), lambda: run(LOWER + DIGITS, 20, 40), lambda: run(LOWER + UPPER, 20, 40)]
    harmless = [lambda: f"{word()}.{word()}{int(g.integers(99))}.com", lambda: "/".join(word() for _ in range(4)) + ".py", lambda: f"20{g.integers(10, 40)}-{g.integers(10, 13)}-{g.integers(10, 29)}T{g.integers(10, 24)}", lambda: run(DIGITS, 14, 20), lambda: "_".join(word() for _ in range(3)) + str(g.integers(99)),
                lambda: word() + "".join(word().capitalize() for _ in range(3)), lambda: f"v{g.integers(9)}.{g.integers(30)}.{g.integers(99)}-{word()}.{g.integers(9)}", lambda: pick("=-_.x0") * int(g.integers(14, 40)), lambda: word() + word() + word(), lambda: "-".join(word() for _ in range(4))]
    letters = lambda: run(LOWER, 10, 28) + run(UPPER, 3, 12)  # noqa: E731  a secret only beside a name
    return [(pick(NAMES), letters(), 1) if i % 4 == 0 else (pick(NAMES) if i % 2 else "", pick(secret)(), 1) for i in range(n)] + [(pick(NAMES) if i % 8 == 0 else "", pick(harmless)(), 0) for i in range(n)]


def examined(docs: DataFrame) -> DataFrame:
    """Per text: the rules' spans, and its candidates with their windows and labels."""

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in chunks(texts):
                spans, cands = [], []
                for raw in texts[i:j]:
                    text = raw.decode()
                    base = base_spans(text)
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                    cands.append([{"start": s, "end": e, "window": w, "label": label} for s, e, w, label in candidates(text, base)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array(cands, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("window", pa.string()), ("label", pa.int32())])))],
                    names=["doc_id", "base", "found"])

    return docs.mapInArrow(run, "doc_id long, base array<struct<kind:string,start:long,end:long>>, found array<struct<start:long,end:long,window:string,label:int>>")


def coded(windows: list[str]) -> np.ndarray:
    """Character codes: printable ASCII as itself, anything else as one code."""
    out = np.zeros((len(windows), WIDTH), dtype=np.int64)
    for i, w in enumerate(windows):
        out[i] = np.frombuffer(w.encode("utf-32-le"), dtype="<u4")
    return np.where(out < 127, out, 127)


class CharCNN:
    """Character embedding and an inside mark, one convolution, max and mean pooling, a logistic unit."""

    def __init__(self, seed: int = 7, size: int = 8, filters: int = 24, reach: int = 5):
        g = np.random.default_rng(seed)
        self.reach = reach
        self.p = {"emb": g.normal(0, 0.3, (128, size)), "w": g.normal(0, (reach * (size + 1)) ** -0.5, (reach * (size + 1), filters)), "b": np.zeros(filters),
                  "v": g.normal(0, 0.1, 2 * filters), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1
        self.rows = self.seen = 0  # labelled rows of the corpus that it was fitted on; examples gone through in all rounds

    def _forward(self, x: np.ndarray):
        p, r = self.p, self.reach
        mark = np.zeros((len(x), WIDTH, 1), p["emb"].dtype)
        mark[:, BEFORE:BEFORE + INSIDE, 0] = x[:, BEFORE:BEFORE + INSIDE] > 0
        h = np.concatenate([p["emb"][x], mark], axis=2)
        cols = np.concatenate([h[:, k:WIDTH - r + 1 + k] for k in range(r)], axis=2)
        z = (cols.reshape(-1, cols.shape[2]) @ p["w"]).reshape(*cols.shape[:2], -1)
        z += p["b"]
        np.maximum(z, 0, out=z)
        top = z.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None], 1)[:, 0], z.mean(axis=1)], axis=1)
        return cols, z, top, pooled, pooled @ p["v"] + p["c"]

    def margin(self, windows: list[str]) -> np.ndarray:
        return np.concatenate([self._forward(coded(windows[i:i + 512]))[-1] for i in range(0, len(windows), 512)] or [np.zeros(0)])

    def fit(self, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, rate: float, seed: int) -> None:
        """Adam on the weighted logistic loss, once over all rows of character codes."""
        g, own_type = np.random.default_rng(seed), np.float32
        self.p = {k: v.astype(own_type) for k, v in self.p.items()}
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        r, size = self.reach, 64 if len(x) < 10_000 else 256
        order = g.permutation(len(x))
        for step, i in enumerate(range(0, len(x), size), 1):
            own = order[i:i + size]
            codes = x[own].astype(np.int64)
            cols, z, top, pooled, out = self._forward(codes)
            d = ((1 / (1 + np.exp(-out)) - labels[own]) * weights[own] / len(own)).astype(own_type)
            half = z.shape[2]
            dp = d[:, None] * self.p["v"]
            dz = np.repeat(dp[:, None, half:] / z.shape[1], z.shape[1], axis=1)
            np.put_along_axis(dz, top[:, None], np.take_along_axis(dz, top[:, None], 1) + dp[:, None, :half], 1)
            dz *= z > 0
            flat = dz.reshape(-1, half)
            dcols = (flat @ self.p["w"].T).reshape(*z.shape[:2], r, -1)
            dh = np.zeros((*codes.shape, dcols.shape[3] - 1), own_type)
            for k in range(r):
                dh[:, k:WIDTH - r + 1 + k] += dcols[:, :, k, :-1]
            demb = np.stack([np.bincount(codes.ravel(), dh[:, :, c].ravel(), 128) for c in range(dh.shape[2])], axis=1)
            grads = {"emb": demb, "w": cols.reshape(-1, cols.shape[2]).T @ flat, "b": flat.sum(axis=0), "v": d @ pooled, "c": d.sum(keepdims=True)}
            for k, grad in grads.items():
                m[k] += 0.1 * (grad - m[k])
                s[k] += 0.001 * (grad**2 - s[k])
                self.p[k] = self.p[k] - own_type(rate) * (m[k] / own_type(1 - 0.9**step)) / (np.sqrt(s[k] / own_type(1 - 0.999**step)) + own_type(1e-8))
        self.p = {k: v.astype(float) for k, v in self.p.items()}

    def calibrate(self, margins: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float, precision: float) -> None:
        """Platt scaling on counted margins of held-out rows, then the highest threshold that recalls the wanted share of their findings, raised to the first one of the wanted precision; either label weighs the same."""
        totals = [max(counts[labels == v].sum(), 1) for v in (0, 1)]
        weights = counts / np.where(labels == 1, totals[1], totals[0])
        for _ in range(300):
            error = (1 / (1 + np.exp(-(self.scale * margins + self.shift))) - labels) * weights / weights.sum()
            self.scale -= 0.02 * (error * margins).sum()
            self.shift -= 0.02 * error.sum()
        p = self.probability(margins)
        levels = np.unique(p[labels == 1])
        passed = lambda v: np.array([weights[(labels == v) & (p >= t)].sum() for t in levels])
        if len(levels):
            true, false = passed(1), passed(0)
            wanted = np.flatnonzero(true >= recall - 1e-9)[-1]
            good = [t for t, a, b in zip(levels[wanted:], true[wanted:], false[wanted:], strict=True) if a >= precision * (a + b)]
            self.threshold = float(good[0]) if good else 1.1

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * margin + self.shift)))


def examples(rows: DataFrame, n: int) -> DataFrame:
    """(part, codes, label, held) of n labelled rows (doc_id, start, window, label): each row itself, and planted runs in its context.

    Every other finding of the rules, and every planted run, is shown in the context of another
    row, so that the candidate itself has to tell. A fifth is held out for the threshold. Parts
    are dealt and sorted by a hash of the row, so that they don't depend on how rows come.
    """
    pool = planted(np.random.default_rng(11), PLANTED)
    each = -(-len(pool) // max(n, 1)) if n < len(pool) else 1

    def shown(context: str, run: str, before: str = "") -> list[str]:
        text = context[:BEFORE].replace("\0", "") + before
        return _pieces(text + run + " " + context[-AFTER + 1:].replace("\0", ""), len(text), len(text) + len(run))

    def run(batches):
        last = " " * WIDTH
        for b in batches:
            own, labels = [], []
            for h, w, label in zip(*(b.column(c).to_pylist() for c in ("h", "window", "label")), strict=True):
                if label >= 0:
                    own += shown(last, w[BEFORE:BEFORE + INSIDE].strip("\0")) if label and h % 2 else [w]
                for j in range(each):
                    labels += [label] * (len(own) - len(labels))
                    before, text, kind = pool[(h + j) % len(pool)]
                    own += shown(last, text, before)
                    labels += [kind] * (len(own) - len(labels))
                last = w
            codes = coded(own).astype(np.uint8)
            held = [zlib.crc32(c) % 5 == 0 for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(labels, pa.int32()), pa.array(held)], names=["codes", "label", "held"])

    parts = 2 * n // PART + 1
    dealt = rows.select(F.xxhash64("doc_id", "start", "window").alias("h"), "window", "label")
    dealt = dealt.repartition(parts, "h").sortWithinPartitions("h", "window", "label").mapInArrow(run, "codes binary, label int, held boolean")
    return dealt.select(F.spark_partition_id().alias("part"), "codes", "label", "held")


def _by_part(batches):
    """(part, codes, labels) of each part, from batches in which the rows of a part lie together."""
    now, codes, labels = None, [], []
    for b in batches:
        part, label = b.column(0).to_numpy(), b.column(2).to_numpy()
        own = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, WIDTH)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j and part[i] != now and codes:
                yield now, np.concatenate(codes), np.concatenate(labels)
                codes, labels = [], []
            if i < j:
                now = part[i]
                codes.append(own[i:j])
                labels.append(label[i:j])
    if codes:
        yield now, np.concatenate(codes), np.concatenate(labels)


def trained(found: DataFrame, recall: float = 0.98, precision: float = 0.98) -> CharCNN:
    """A network fitted on all labelled rows of the corpus and on planted ones in their contexts.

    Each round, a task takes the network on over the examples of a part, and the networks of all
    parts are averaged by their numbers of examples: a few kB a part go to the driver. A large
    corpus gets as many rounds as a small one. The threshold is that of the counts of all held-out
    rows by label and margin, to a hundredth.
    """
    spark = found.sparkSession
    rows = found.where("label >= 0").select("doc_id", "start", "window", "label")
    n = rows.count()
    context = spark.createDataFrame([(0, 0, " " * WIDTH, -1)], "doc_id long, start long, window string, label int")  # of an empty corpus
    seen = written(examples(rows if n else context, n), "examples")
    model = CharCNN()
    model.rows = n
    totals = {r.label: r.n for r in seen.where("not held").groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = np.array([sum(totals.values()) / (2 * totals[v]) for v in (0, 1)])
    shapes, names = {k: v.shape for k, v in model.p.items()}, list(model.p)

    for k in range(ROUNDS):

        def learn(batches, k=k):
            for part, codes, labels in _by_part(batches):
                own = CharCNN()
                own.p = dict(model.p)
                own.fit(codes, labels.astype(float), weight[labels], 0.01 / (1 + k) ** 0.5, seed=k)
                flat = np.concatenate([own.p[x].ravel() for x in names])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(codes)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["part", "n", "p"])

        done = sorted((r.part, r.n, bytes(r.p)) for r in seen.where("not held").select("part", "codes", "label").mapInArrow(learn, "part int, n long, p binary").collect())
        model.seen += sum(m for _, m, _ in done)
        mean = np.average([np.frombuffer(p) for *_, p in done], axis=0, weights=[m for _, m, _ in done])
        at = np.cumsum([0, *(int(np.prod(shapes[x])) for x in names)])
        model.p = {x: mean[i:j].reshape(shapes[x]) for x, i, j in zip(names, at, at[1:], strict=False)}

    def score(batches):
        for b in batches:
            codes = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, WIDTH)
            margins = np.concatenate([model._forward(codes[i:i + 512].astype(np.int64))[-1] for i in range(0, len(codes), 512)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(margins * 100).astype(np.int64)), b.column(1)], names=["at", "label"])

    counted = seen.where("held").select("codes", "label").mapInArrow(score, "at long, label int").groupBy("at", "label").agg(F.count("*").alias("n")).collect()
    columns = [np.array([r[i] for r in counted], dtype=float) for i in range(3)]
    model.calibrate(columns[0] / 100, columns[1], columns[2], recall, precision)
    discard(seen)
    return model


def _added(model: CharCNN, found: list[list[tuple[int, int, str, int]]]) -> list[list[tuple[int, int]]]:
    """Of each text's candidates (start, end, window, label), the unknown ones that the network adds: those of which a piece passes."""
    flat = [(i, s, e, w) for i, own in enumerate(found) for s, e, w, label in own if label < 0]
    good = model.probability(model.margin([w for *_, w in flat])) >= model.threshold
    out: list[set] = [set() for _ in found]
    for (i, s, e, _), ok in zip(flat, good, strict=True):
        if ok:
            out[i].add((s, e))
    return [sorted(x) for x in out]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.98) -> DataFrame:
    """(doc_id, base, added): per row, the rules' spans and those that the network adds, in code points.

    Spans are structs of kind, start and end (exclusive). A null or empty text has none. Every
    text is examined whole, and every row by itself, whatever its id. An empty table gives an empty
    one, and other columns are ignored.
    """
    small_batches(docs.sparkSession)
    seen = written(examined(id_and_text(docs, id_col, text_col)), "candidates")
    model = trained(seen.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*"), recall=recall)

    def run(batches):
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[(x["start"], x["end"], x["window"], x["label"]) for x in own] for own in b.column(2).to_pylist()]
            added = [[{"kind": "cnn", "start": s, "end": e} for s, e in own] for own in _added(model, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(added, span)], names=["doc_id", "base", "added"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return seen.select("doc_id", "base", "found").mapInArrow(run, f"doc_id long, base {span}, added {span}")


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with each span, and each run of spans that overlap, replaced by mark."""
    at, out = 0, []
    for s, e in sorted(spans):
        if e > at:
            out += [text[at:max(at, s)], mark] if s >= at else []
            at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]", recall: float = 0.98) -> DataFrame:
    """docs with every found span of text replaced by mark; n_chars of changed rows follows. Other columns stay as they are.

    Texts are masked in the pass that finds the spans, so no row is joined to anything: rows with
    null or repeated ids lose their secrets too. A null text stays null.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(examined(source).select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*").where("label >= 0"), "labelled")
    model = trained(found, recall=recall)
    discard(found)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        whole = [t or "" for t in texts.to_pylist()]
        base = [base_spans(t) for t in whole]
        added = _added(model, [candidates(t, b) for t, b in zip(whole, base, strict=True)])
        return pa.array([masked(t, [*((s, e) for _, s, e in b), *a], mark) if b or a else None for t, b, a in zip(whole, base, added, strict=True)], pa.string())

    name = "clean"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, clean(F.col("text").cast("string")))
    changed = F.col(name).isNotNull()
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(name).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce(F.col(name), F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns))
