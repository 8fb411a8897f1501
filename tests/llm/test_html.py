"""HTML extraction: tree matching against the plain recursion, wrappers that decide the text, odd and hostile pages."""

import random
import re
import time

import pytest
from oracle import SMALL

from chronoset.llm import html_extract
from chronoset.llm.html_extract import Shapes, Tree, align, extract, parse

PAGES = "page_id long, url string, html string, runs string, host string, pivot string, text string"


def pages_of(spark, rows):
    """Pages with extra columns whose names clash."""
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in rows], PAGES)


def page(body, head=""):
    return f"<html><head><title>t</title>{head}</head><body>{body}</body></html>"


def own_text(html):
    tree = parse(html)
    own = html_extract.own_content(tree)
    return " ".join(run for node, run, _ in tree.runs if node in own)


def plain_matching(a, x, b, y):
    """Simple tree matching as published: a table over the children of each pair of nodes."""
    if a.tags[x] != b.tags[y]:
        return 0
    rows = [[0] * (len(b.children[y]) + 1)]
    for u in a.children[x]:
        row = [0]
        for j, v in enumerate(b.children[y]):
            row.append(max(row[j], rows[-1][j + 1], rows[-1][j] + plain_matching(a, u, b, v)))
        rows.append(row)
    return rows[-1][-1] + 1


def random_tree(rnd, n):
    tree = Tree()
    for _ in range(n):  # in page order, so that subtrees are numbered without gaps
        at = len(tree.tags) - 1
        while at and rnd.random() < 0.5:
            at = tree.parent[at]
        tree.add(rnd.choice(("p", "p", "div", "ul")), at)
    return tree


def test_tree_matching_is_exact():
    rnd, shapes = random.Random(5), Shapes()
    for _ in range(400):
        a, b = random_tree(rnd, rnd.randrange(14)), random_tree(rnd, rnd.randrange(14))
        of_a, of_b = shapes.of(a), shapes.of(b)
        best = plain_matching(a, 0, b, 0)
        assert shapes.weight(of_a[0], of_b[0]) == best
        found = align(shapes, a, of_a, b, of_b)
        assert sum(y >= 0 for y in found) == best
        for x, y in enumerate(found):  # tags, parents and order are kept
            if x and y >= 0:
                assert a.tags[x] == b.tags[y] and found[a.parent[x]] == b.parent[y]
        used = [y for y in found if y >= 0]
        assert used == sorted(set(used))


def test_blocks():
    cases = {
        page("<nav>menu</nav><article><h1>A &amp; B</h1><p>one<b>two</b>\n three&nbsp;four<br>five<p>six</article><footer>f</footer>"): "A & B onetwo three four five six",
        page("<div class='sidebar'>s</div><main><p>x</p><form>f</form></main>"): "x",
        page("<p>no article</p><ul><li><a href=x>link</a></li></ul><p>text <a href=y>l</a></p>"): "no article link text l",
        page("<article>a<script>var x = '<p>no</p>';</script><style>p{}</style><!-- c <p>no</p> -->b</article>"): "ab",
        page("<article><p>1 < 2 &lt; 3 &#x41;&#66;</p></article>"): "1 < 2 < 3 AB",
        page("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>"): "a b c d",
        page("<article><p>short</p></article><div>beside</div><article><p>the long one</p></article>"): "short the long one",
        page("<article><p class='related'>Related work</p><p id='notice'>A notice</p><div class='comments-policy'>Be kind</div><p class='ad'>kept</p></article>"): "Related work A notice Be kind kept",
        page("<div class='page has-sidebar'><main class='content-nav'><article class='post'><header><h1>T</h1></header><p>x</p><aside>b</aside></article></main><div class='left'>s</div></div>"): "T x",
        page("<main><article><p>x</p></article><section class='c'><article><p>a long comment by someone</p></article></section></main>"): "x",
        page("<article><p>x</p><section><article><p>a reply</p></article></section></article>"): "x",
        page("<header>site</header><div role='banner'>site</div><div hidden>c</div><div style='display: none'>d</div><p>x</p>"): "x",
        page("<article><p title='hidden gem'>a</p><p hidden>b</p><p data-hidden='1'>c</p></article>"): "a c",
        page("<div>short</div><div><h1>Head</h1><div><p>" + "long text " * 50 + "</p></div></div><div>short</div>"): "Head " + ("long text " * 50).strip(),
        "": "",
        "plain text": "plain text",
        page("<article><p>never closed"): "never closed",
        "<article><p>x</p>y <!-- open": "x y",
        "<article><p>x</p>y <!-- open <p>z</p>": "x y",
        "<article><p>x</p>1 < 2 <b": "x 1 < 2 <b",
        page("<article><p>x<script>never closed"): "x",
    }
    for html, want in cases.items():
        assert own_text(html) == want, html


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000,
        "<div>" * 40_000 + "<p>deep</p>" + "</span></b></section>" * 40_000,
        "<article>" + "<div><p>x</p></div><p>y</p>" * 4000 + "</article>",
        "<article>" + "".join(f"<{t}><p>z</p></{t}>" for t in random.Random(1).choices(("div", "section", "ul", "ol"), k=4000)) + "</article>",
        "<table>" + "<tr><td>a" * 3000,
    ],
)
def test_deep_and_wide_pages(html):
    began, shapes = time.time(), Shapes()
    tree, other = parse(page(html)), parse(page("<h1>t</h1>" + html.replace("<p>", "<p>w</p><p>", 1000)))
    found = align(shapes, tree, shapes.of(tree), other, shapes.of(other))
    assert sum(y >= 0 for y in found) > 0.9 * len(tree.tags)
    assert own_text(page(html)) and time.time() - began < 30


@pytest.mark.parametrize("unit", ["<a ", "<", '<a "', "<!-- ", "</", "<p>", "&", "<a href='"])
def test_long_junk_takes_no_time(unit):
    began = time.time()
    for html in (unit * 200_000, unit * 200_000 + ">", "<p>x</p>" + unit * 200_000):
        parse(html)
    assert time.time() - began < 20


def words(rnd, n):
    return " ".join(rnd.choice(("lorem", "ipsum", "dolor", "sit", "amet")) + str(rnd.randrange(99)) for _ in range(n))


def test_wrapper_is_learned(spark):
    rnd = random.Random(6)
    rows, want = [], {}
    for k in range(30):
        body = [words(rnd, 12) for _ in range(rnd.randrange(1, 6))]
        want[k] = " ".join(body)
        rows.append((k, f"https://user@Site.example:80/{k}", page("<div class=top>Welcome</div><div><p>Read this first, all of you</p>" + "".join(f"<p>{b}</p>" for b in body) + "</div><div>Nothing more</div>")))
    rows += [(100 + k, "http://same.example/", page("<article><p>all alike</p></article>")) for k in range(9)]
    rows += [(200, None, None), (201, "", ""), (202, "http://single.example/x", page("<article><p>alone</p></article>")), (202, "http://single.example/x", page("<article><p>alone</p></article>"))]
    want |= {100 + k: "all alike" for k in range(9)} | {200: "", 201: "", 202: "alone"}
    for broadcast_bytes in (html_extract.BROADCAST_BYTES, 0):
        got = extract(pages_of(spark, rows), broadcast_bytes=broadcast_bytes).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    alone = {r.page_id: r.text for r in extract(pages_of(spark, rows), min_pages=99).collect()}
    assert all("Read this first" in alone[k] for k in range(30))  # without a wrapper nothing tells it from the text
    assert extract(pages_of(spark, [])).count() == 0


def test_wrapper_decides_without_article_elements(spark):
    """Pages of plain elements: what varies beside the text, and links, are told apart by the host's pages together."""
    rnd = random.Random(8)
    rows, want = [], {}
    for k in range(60):
        host, body = k % 3, [words(rnd, rnd.randrange(1, 40)) for _ in range(rnd.choice((1, 1, 3, 9)))]
        menu = "".join(f"<li><a href=x>{words(rnd, 2)}</a></li>" for _ in range(5))
        extra = f"<div class=x>{words(rnd, 5)}</div>" if k % 2 else ""
        want[k] = " ".join([f"Title {k}", *body])
        rows.append((k, f"http://host{host}.example/{k}", page(f"<div><ul>{menu}</ul></div>{extra}<div><p>By the staff</p></div><div><h1>Title {k}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div>&copy; {words(rnd, 4)}</div>")))
    assert {r.page_id: r.text for r in extract(pages_of(spark, rows)).collect()} == want
    bare = {r.page_id: r.text for r in extract(pages_of(spark, rows), induce=False).collect()}
    assert all(bare[k] != want[k] for k in want)
    alone = {r.page_id: r.text for r in extract(pages_of(spark, rows), min_pages=99).collect()}
    assert sum(alone[k] != want[k] for k in want) > 10  # short articles need the other pages


def test_small_table_without_semantic_elements(spark):
    """The given pages of one host keep their text when <article>, <nav> and <footer> become plain elements."""
    rows = [(r.page_id, "http://one.example/", r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    plain = [(i, u, re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", h or "")) for i, u, h in rows]
    texts = [{r.page_id: r.text for r in extract(pages_of(spark, x)).collect()} for x in (rows, plain)]
    assert texts[0] == texts[1] and all(texts[0].values())
    bare = {r.page_id: r.text for r in extract(pages_of(spark, rows), induce=False).collect()}
    assert sum(bare[i] != texts[0][i] for i in bare) > 0.9 * len(bare)


def test_pages_that_the_pivot_does_not_know(spark):
    """Elements that the pivot lacks belong to the text by their label; a page that fits no wrapper is searched alone."""
    rnd = random.Random(9)
    rows, want = [], {}
    for k in range(40):
        parts = [words(rnd, 30) for _ in range(1 if k % 4 else 3)]
        want[k] = " ".join([f"Head {k}", *parts])
        rows.append((k, "http://a.example/", page(f"<h1>Head {k}</h1><div>Top</div>" + "".join(f"<article><p>{p}</p></article>" for p in parts) + f"<div>{words(rnd, 4)}</div>")))
    rows.append((99, "http://a.example/other", page("<h1>Another</h1><table><tr><td><p>nothing like the others</p></table>")))
    want[99] = "Another nothing like the others"
    assert {r.page_id: r.text for r in extract(pages_of(spark, rows)).collect()} == want


@pytest.mark.parametrize("copies, others", [(6, 20), (40, 1)])
def test_copies_make_no_template(spark, copies, others):
    names = lambda name, n: [f"{name} paragraph {k}" for k in range(n)]
    article = lambda paragraphs, k: page(f"<div>advert {k}</div><article><div>Read this first</div>" + "".join(f"<p>{p}</p>" if len(paragraphs) > 3 else f"<p>{p}</p><ul><li>own {p}</li></ul>" for p in paragraphs) + "</article>")
    template = "" if others >= 5 else "Read this first "
    rows, want = [], {}
    for h in range(12):  # whichever page is the pivot
        bodies = [names(f"long{h}", 9)] * copies + [names(f"short{h} {k}", 3) for k in range(others)]
        for k, body in enumerate(bodies):
            rows.append((h * 100 + k, f"http://host{h}.example/{k}", article(body, k)))
            want[h * 100 + k] = template + " ".join(body if len(body) > 3 else [f"{p} own {p}" for p in body])
    for broadcast_bytes in (html_extract.BROADCAST_BYTES, 0):
        got = extract(pages_of(spark, rows), broadcast_bytes=broadcast_bytes).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
