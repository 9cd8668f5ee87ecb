"""Main text of web pages by site style trees.

The element trees of one host's pages are merged: a style node is a path of elements with their
classes. The importance of a content node falls with the entropy of its contents over the pages:
what stands in many pages is presentation, what stands in one is content. A branch also has the
importance of its presentation, by the entropy of the kinds of children that it has over the pages;
half of it and half of what its content nodes have is the branch's own. Branches and nodes of low
importance are removed from every page, besides those that their elements or classes mark as no
article. The tree of all hosts weighs in where a host has few pages.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of, written

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head title script style noscript template iframe svg math canvas object audio video select button textarea form nav footer aside menu dialog".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
KNOWN = NO_TEXT | ENDS_P | frozenset("html body li dt dd tr td th tbody thead tfoot caption figure figcaption details summary".split())
# Names (of classes, ids, roles) of what is no article anywhere, of what is none outside an article, and parts of names that say nothing.
NEVER = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus pager pagination login signup form".split())
OUTSIDE = frozenset("banner promo promotion notice alert overlay side widget replies respond share sharing social related recommended recommendation recommendations recommends search header masthead".split())
FILLING = frozenset("site page main top bottom left right global list area section box wrap wrapper container block bar inner content item items thread link links button buttons slot unit text primary secondary posts post articles entry mobile desktop sticky fixed".split())
#: Weight of the tree of all hosts beside a host's own pages, and of no judgement beside all hosts' pages.
PRIOR = 2
#: Labels of a path with their classes; deeper ones are merged by their element.
DEPTH = 24

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)?(?:\s*+(=)\s*+)?")
_BARE = re.compile(r"[^\s>]*+")
_LONG_NUMBER = re.compile(r"&#0*+[0-9]{8,};?")


def tokens(page: str):
    """("text", text), ("start", (name, attributes)) and ("end", name) of a page, in one pass over it.

    What the end of the page cuts off (a tag, a comment, a script) is dropped; a quote that is
    never closed is a plain character. Searches that find nothing end the page or are not
    repeated, so no page takes more than linear time.
    """
    at, n, unclosed = 0, len(page), set()
    last_tag = page.rfind(">")
    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at:
            yield "text", page[at:i]
        if i >= n:
            return
        if page.startswith("<!--", i):
            end = page.find("-->", i + 2)
            if end < 0:
                return
            at = end + 3
            continue
        close = page.startswith("/", i + 1)
        name = _NAME.match(page, i + 1 + close)
        if not name:
            if page[i + 1:i + 2] not in ("!", "?", "/"):
                yield "text", "<"
                at = i + 1
                continue
            at = page.find(">", i) + 1
            if not at:
                return
            continue
        if i > last_tag:
            return
        at, own = name.end(), {}
        while at < n and page[at] != ">":
            m = _ATTRIBUTE.match(page, at)
            at = max(m.end(), at + (m.end() == at))
            if m[2] is None:
                if m[1]:
                    own.setdefault(m[1].lower(), "")
                continue
            quote, value = page[at:at + 1], None
            if quote in ("'", '"') and quote not in unclosed:
                end = page.find(quote, at + 1)
                if end < 0:
                    unclosed.add(quote)
                else:
                    value, at = page[at + 1:end], end + 1
            if value is None:
                m2 = _BARE.match(page, at)
                value, at = m2.group(), m2.end()
            if m[1]:
                own.setdefault(m[1].lower(), value)
        if at >= n:
            return
        at += 1
        tag = name.group().lower()
        if close:
            yield "end", tag
            continue
        yield "start", (tag, own)
        if page[at - 2] == "/" and tag not in VOID and tag not in RAW:
            yield "end", tag
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if not end:
                return
            at = end.start()


def decoded(text: str) -> str:
    """text with its character references decoded; a number that no character has is the replacement character."""
    return entities.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def _named(own: dict[str, str], names: frozenset) -> bool:
    """Whether a class, id or role says one of names: as a whole, or beside parts that say nothing."""
    for token in " ".join(own.get(k, "") for k in ("class", "id", "role")).lower().split():
        if token in names:
            return True
        parts = re.split("[-_]+", token)
        if len(parts) > 1 and any(p in names for p in parts) and all(p in names or p in FILLING or p.isdigit() for p in parts):
            return True
    return False


class _Blocks:
    """Blocks of text with the path of their elements."""

    def __init__(self):
        #: Element, path, labels below DEPTH, dropped (2 by its element, 1 by its name), inside an article, open elements of the same name within.
        self.stack: list[list] = []
        self.open: dict[str, int] = {}
        self.blocks: list[tuple[str, bool, str]] = []
        self.set_aside: list[tuple[str, bool, str]] = []
        self.text: list[str] = []

    def state(self) -> tuple[str, tuple, int, bool]:
        return tuple(self.stack[-1][1:5]) if self.stack else ("", (), 0, False)

    def flush(self):
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            path, tail, dropped, inside = self.state()
            (self.set_aside if dropped else self.blocks).append((">".join([path, *tail] if path else tail), inside, words))

    def pop(self, k: int):
        for x in self.stack[k:]:
            self.open[x[0]] -= 1
        del self.stack[k:]

    def start(self, tag: str, own: dict[str, str]):
        """Inline elements are open only where they drop their text; it doesn't break the block around it."""
        if tag in INLINE:
            if tag == "br":
                self.text.append(" ")
            if self.stack and self.stack[-1][0] == tag:
                self.stack[-1][5] += 1
            elif tag not in VOID and not self.state()[2] and ("hidden" in own or _named(own, NEVER if self.state()[3] else NEVER | OUTSIDE)):
                self.push(tag, *self.state()[:2], 2, self.state()[3])
            return
        self.flush()
        if tag in VOID:
            return
        shut = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else set())
        if any(self.open.get(x) for x in shut):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in shut:
                    self.pop(k)
                    break
                if self.stack[k][0] not in INLINE and self.stack[k][0] != "p":
                    break
        path, tail, dropped, inside = self.state()
        if dropped < 2:
            if tag in NO_TEXT or "hidden" in own or tag == "header" and not inside:
                dropped = 2
            elif tag not in ("html", "body") and _named(own, NEVER if inside else NEVER | OUTSIDE):
                dropped = 1
        inside = inside or (tag in ("article", "main") and dropped < 2)
        names = ".".join(own.get("class", "").split())
        label = f"{tag}.{names if len(names) <= 24 else format(zlib.crc32(names.encode()), 'x')}" if names else tag
        if not tail and path.count(">") < DEPTH:
            path = f"{path}>{label}" if path else label
        else:
            label = tag if tag in KNOWN else "other"
            tail = tail[:tail.index(label) + 1] if label in tail else (*tail, label)
        self.push(tag, path, tail, dropped, inside)

    def push(self, tag: str, *state):
        self.stack.append([tag, *state, 0])
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str):
        if tag not in INLINE:
            self.flush()
        if not self.open.get(tag):
            return
        if tag in INLINE:
            if self.stack[-1][0] == tag:
                self.stack[-1][5] -= 1
                if self.stack[-1][5] < 0:
                    self.pop(len(self.stack) - 1)
            return
        k = len(self.stack) - 1
        while self.stack[k][0] != tag:
            k -= 1
        self.pop(k)

    def data(self, text: str):
        if self.state()[2] < 2:
            self.text.append(decoded(text))


def blocks(html: str) -> list[tuple[str, bool, str]]:
    """(path, inside an article, text) of each block that isn't marked as no article, in page order.

    Where a page has an article or main element, blocks outside it don't belong to the article. An
    article within an element whose name alone speaks against it counts if the page has no other.
    """
    p = _Blocks()
    for kind, x in tokens(html):
        if kind == "text":
            p.data(x)
        elif kind == "start":
            p.start(*x)
        else:
            p.end(x)
    p.flush()
    return [b for b in p.blocks if b[1]] or [b for b in p.set_aside if b[1]] or p.blocks


def styles(paths) -> list[dict]:
    """Path and style of each branch above the given content nodes."""
    children: dict[str, dict[str, None]] = {}
    order: dict[str, None] = {}
    for path in dict.fromkeys(paths):
        chain = []
        while ">" in path:
            above, _, label = path.rpartition(">")
            if label in children.get(above, ()):
                break
            children.setdefault(above, {})[label] = None
            chain.append(above)
            path = above
        order.update(dict.fromkeys(reversed(chain)))
    return [{"path": p, "style": zlib.crc32(">".join(children[p]).encode())} for p in order]


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks, styles) of every page; a style is a branch's path and a checksum of its different children in order."""

    def run(batches):
        kind = pa.list_(pa.struct([("path", pa.string()), ("inside", pa.bool_()), ("text", pa.string())]))
        for b in batches:
            found = [[{"path": p, "inside": i, "text": t} for p, i, t in blocks(h.decode())] for h in texts_of(b.column(3))]
            kinds = pa.list_(pa.struct([("path", pa.string()), ("style", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, kind), pa.array([styles(x["path"] for x in own) for own in found], kinds)], names=["page_id", "url", "host", "blocks", "styles"])

    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, host string, blocks array<struct<path:string,inside:boolean,text:string>>, styles array<struct<path:string,style:long>>")


def _measured(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pages, importance) of (page, path, content ..., distinct in a page): 1 minus the mean, over a node's contents, of log(pages with it) / log(pages)."""
    n = rows.select(*keys, "page").distinct().groupBy(*keys).agg(F.count("*").alias("pages"))
    c = rows.groupBy(*keys, "content").agg(F.count("*").alias("c")).groupBy(*keys).agg((F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("mean"))
    return n.join(c, keys).withColumn("importance", F.when(F.col("pages") > 1, 1 - F.col("mean") / F.log("pages")).otherwise(F.lit(1.0))).drop("mean")


def _both(rows: DataFrame) -> DataFrame:
    """(host, path, value): importance within the host's tree; the fewer pages a host has, the more the tree of all hosts counts."""
    own = _measured(rows, ["host", "path"])
    mixed = lambda other: (F.col("pages") * F.col("importance") + PRIOR * other) / (F.col("pages") + PRIOR)
    every = _measured(rows, ["path"]).select("path", mixed(F.lit(1.0)).alias("everywhere"))
    return own.join(every, "path").select("host", "path", "pages", mixed(F.col("everywhere")).alias("value"))


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, value) of the content nodes of pages (host, page, blocks, styles): the least of their own importance and that of the branches above them."""
    entry = lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("content"))
    contents = pages.select("host", "page", F.explode(F.array_distinct(F.transform("blocks", entry))).alias("x")).select("host", "page", "x.*")
    nodes = written(_both(contents), "nodes")
    shown = pages.select("host", "page", F.explode("styles").alias("x")).select("host", "page", "x.path", F.col("x.style").alias("content"))
    parts = F.split("path", ">")
    above = nodes.select("host", "pages", "value", F.col("path").alias("node"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ">"))).alias("path"))
    content = above.groupBy("host", "path").agg((F.sum(F.col("value") * F.col("pages")) / F.sum("pages")).alias("content"))
    branches = _both(shown).join(content, ["host", "path"]).select("host", "path", ((F.col("value") + F.col("content")) / 2).alias("branch"))
    least = above.select("host", "node", "path").join(branches, ["host", "path"]).groupBy("host", F.col("node").alias("path")).agg(F.min("branch").alias("branch"))
    return nodes.select("host", "path", "value").join(least, ["host", "path"], "left")


def different(found: DataFrame) -> DataFrame:
    """One row of each different page of a host: copies count once in its tree."""
    first = found.groupBy("host", "same").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("host", "same", "first")
    return found.join(written(first, "copies"), ["host", "same"], "left").where("first is null or row = first").select("host", F.col("row").alias("page"), "blocks", "styles")


def main_text(pages: DataFrame, least: float = 0.3, least_inside: float = 0.05, least_branch: float = 0.1) -> DataFrame:
    """(page_id, url, text) of every row; text is empty if nothing remains.

    Content nodes below `least` importance are removed, and branches below least_branch; inside an
    article element only those below least_inside, which stand in nearly every page. Copies of a
    page count once. A null or empty page has an empty text; pages without a host share one tree.
    Repeated rows give repeated rows. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    found = written(parsed(pages).withColumn("same", F.xxhash64("blocks")).withColumn("row", F.monotonically_increasing_id()), "blocks")
    lowest = F.least("value", "branch") < least_inside
    low = importance(different(found)).where((F.col("value") < least) | (F.col("branch") < least_branch)).groupBy("host").agg(
        F.collect_list("path").alias("low"), F.collect_list(F.when(lowest, F.col("path"))).alias("lowest"))
    # Written, so that Spark knows its size: a small table is broadcast, a large one is shuffled with the pages.
    low = written(low, "low")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.when(b["inside"], F.array_contains("lowest", b["path"])).otherwise(F.array_contains("low", b["path"])), F.lit(False)))
    return found.join(low, "host", "left").select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
