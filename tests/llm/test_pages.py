"""HTML extraction: names, malformed pages, the style tree against a plain one, and shares of article and template words."""

import html
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

from latticelake.llm import siteguide

PAGE = "<html><body><nav>menu</nav>{}<footer>foot</footer></body></html>"


@pytest.mark.parametrize(("page", "want"), [
    ("<article><h1>T</h1><div class='share price'>The share price</div></article>", ["T", "The share price"]),
    ("<article><section class='related work'>Related work</section><p>p</p></article>", ["Related work", "p"]),
    ("<div class='post side-a'><article><p>whole</p></article></div>", ["whole"]),
    ("<div class='layout sidebar-right'><article><p>whole</p></article></div><p>no", ["whole"]),
    ("<div class='related'><article>teaser</article></div><article>own</article>", ["own"]),
    ("<article><p>a <span class=ad>buy <span>now</span></span> b</p><div id='comments'>c<article class=comment>d</article></div></article>", ["a b"]),
    ("<div class='site-footer'>x</div><p>body &amp; &lt;b&gt; &#x41; 3 < 4 <b>bold</b><br>next</p><div class=comment-list>y</div>", ["body & <b> A 3 < 4 bold next"]),
    ("<p title=it's>one<p data-x='a>b'>two", ["one", "two"]),
    ("<article><form>q</form><header><h1>Head</h1></header><div class='advert'>z</div><p>text</article>", ["Head", "text"]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>", ["a", "b", "c", "1", "2", "3"]),
    ("<div hidden>h</div><p>&#99999999999; &nochar; &nbsp;x", ["� &nochar; x"])])
def test_names_and_markup(page, want):
    assert [t for *_, t in siteguide.blocks(PAGE.format(page))] == want


def test_cut_off_pages():
    for cut in ("<a href='x", "<!-- a", "<script>var a = '</p>'", "<p", "</", "<!doctype"):
        assert [t for *_, t in siteguide.blocks(f"<p>text {cut}")] == ["text"]


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<div><p class=a>t" * 20_000, "<a " * 20_000, "<!--" * 20_000, "<b>" * 20_000 + "<p></p>" * 20_000, "<div>" * 20_000 + "</span></ul>" * 20_000, '<a href="x>' * 20_000,
                                  "<ul><li>x" * 20_000, "&" * 60_000 + "&#" + "9" * 60_000 + ";", "".join(f"<div class=c{i}>t" for i in range(20_000)), "<" * 60_000, "".join(f'<div class="c{i % 50} a"><b class=ad>' for i in range(20_000)),
                                  "<script>" * 20_000, "<a " + "= " * 60_000 + ">", "<!" * 30_000, '<div class="' + "a-" * 60_000 + '">x', "</p" * 20_000, "<p><!-- a --" * 20_000])
def test_any_page_takes_linear_time(page):
    start = time.process_time()
    found = siteguide.blocks(page)
    siteguide.styles(p for p, *_ in found)
    assert time.process_time() - start < 5
    assert max((len(p) for p, *_ in found), default=0) < 2000


def plain_tree(pages, least=0.3, inside=0.05, branch=0.1):
    """{id: text} of pages (id, host, html) by the definition, in plain Python."""
    found = {i: (h, siteguide.blocks(x)) for i, h, x in pages}
    unique = {(h, tuple(b)): i for i, (h, b) in reversed(found.items())}
    trees = {i: found[i] for i in unique.values()}

    def measured(rows):  # node: contents over pages
        out = {}
        for node, contents in rows.items():
            n = len({p for p, _ in contents})
            c = Counter(x for _, x in contents)
            mean = sum(k * math.log(k) for k in c.values()) / sum(c.values())
            out[node] = n, (1 - mean / math.log(n) if n > 1 else 1.0)
        return out

    def both(rows):  # (host, path, page, content), distinct
        own, every = defaultdict(set), defaultdict(set)
        for h, p, page, x in rows:
            own[h, p].add((page, x))
            every[p].add((page, x))
        mix = lambda n, v, other: (n * v + 2 * other) / (n + 2)
        every = {p: mix(n, v, 1) for p, (n, v) in measured(every).items()}
        return {k: (n, mix(n, v, every[k[1]])) for k, (n, v) in measured(own).items()}

    nodes = both({(h, p, i, t) for i, (h, b) in trees.items() for p, _, t in b})
    shown = set()
    for i, (h, b) in trees.items():
        children = defaultdict(dict)
        for p, *_ in b:
            labels = p.split(">")
            for k in range(1, len(labels)):
                children[">".join(labels[:k])][labels[k]] = None
        shown |= {(h, p, i, ">".join(c)) for p, c in children.items()}
    branches, below = both(shown), defaultdict(list)
    above = lambda p: [">".join(p.split(">")[:k]) for k in range(1, max(2, p.count(">") + 1))]
    for (h, p), x in nodes.items():
        for a in above(p):
            below[h, a].append(x)
    whole = {k: (v + sum(a * b for a, b in below[k]) / sum(a for a, _ in below[k])) / 2 for k, (_, v) in branches.items()}
    out = {}
    for i, (h, b) in found.items():
        kept = []
        for p, within, t in b:
            value, least_branch = nodes[h, p][1], min((whole[h, a] for a in above(p) if (h, a) in whole), default=1.0)
            low = value < least or least_branch < branch
            if not (low and (not within or min(value, least_branch) < inside)):
                kept.append(t)
        out[i] = "\n".join(kept)
    return out


def test_style_tree(spark):
    rows = []
    for i in range(60):
        host = f"h{i % 7 if i < 40 else i % 3}.example.com"
        box = f"<div class=box><h4>Same</h4><p>Often {i if i % 9 == 0 else 'x'}</p></div>"
        body = f"<div class=entry><p>Own {i}</p><p>{'Twice' if i % 2 else i}</p><div class=tail>{'Read on' if i % 5 else f'End {i}'}</div></div>"
        rows.append((i, host, f"<body>{box}{body}<section><p>All of us</p></section></body>" if i % 4 else f"<body>{box}<article>{body}<p>All of us</p></article></body>"))
    rows += [(100 + i, "h1.example.com", rows[1][2]) for i in range(5)]
    got = siteguide.main_text(spark.createDataFrame([(i, f"http://{h}/", x) for i, h, x in rows], "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == plain_tree(rows)


def test_article_words_stay_and_template_words_go(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    text = {r.page_id: r.text for r in siteguide.main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    kept = article = left = 0
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        words = Counter(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())
        got = Counter(text[r.page_id].split())
        article, kept, left = article + words.total(), kept + (words & got).total(), left + (got - words).total()
    assert kept == article and left == 0


def test_styles_are_checksums_of_children():
    assert siteguide.styles(["a>b>c", "a>b>d", "a>e"]) == [{"path": "a", "style": zlib.crc32(b"b>e")}, {"path": "a>b", "style": zlib.crc32(b"c>d")}]
