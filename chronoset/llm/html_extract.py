"""HTML extraction by wrapper induction.

Each host has a pivot page (that with the smallest hash of url and html). Every page's tree of block elements is aligned
with its host's pivot by simple tree matching. Each run of text so belongs to a slot: a node of the pivot or, where the page
has an element that the pivot lacks, the pivot's node above it and that element's label (its tag, and its class by hash).

Summed over all different pages of a host, the slots make the wrapper:
- a node that at least `held` of the pages hold, and whose runs are nearly always the pivot's, is template;
- what varies is content or not by where it stands. From the root down, the search enters the element, or else the elements of
  one label, that hold at least `share` of the varying text outside links (`semantic_share` for <article> and <main>), until it
  meets running text. All varying runs below are content, as are varying <h1> that it passes. Menus, adverts or comments that stand beside, vary
  as they may, are not.
No list of class names is used; elements that are never article text by their kind (nav, footer, form, role=banner, nested
articles, ...) are left out when pages are parsed.

A host of fewer than `min_pages` different pages gives no contrast: each of its pages is searched alone, nothing being
template, and <article> or <main> decide if they have any text. So is a page of which a wrapper keeps nothing but headings. Pages
whose own search gives equal text are one page in all counts, so that copies of a page make no template of its text.

Tree matching works on shapes (a tag and the shapes of its children): equal shapes match whole, others by an ordered
matching of children in linear space (Hirschberg), each pair of shapes once per task. It is exact and without recursion, however
wide or deep a page is. Character references are decoded, white space inside a run becomes one space, runs are joined in page
order by one space.

Pages are parsed once. Pivots go to the tasks by broadcast where their total size is below `broadcast_bytes`, otherwise by a
join on the host, where Spark splits skewed hosts; copies, and then the counts per slot, are combined before they are shuffled.
A host's slots are at most its pivot's nodes times the labels, of which there are a bounded number.

Defined results: null or empty html, and pages without text outside left-out elements, give the empty string; a null or odd
url is a host of its own name (''); each row is a page, repeated rows included; unclosed and misnested elements are closed as
browsers close them; text after an unclosed comment, script or style is part of it; only page_id, url and html are read, so
other columns may have any name. Reader comments that share one element with the article's paragraphs, and adverts inside
an <article>, are kept where no left-out element holds them: nothing but their names would tell them apart.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

MIN_PAGES, SAME = 5, 0.9
#: Least share of a host's different pages that must hold a template node.
HELD = 0.5
#: Least share of the varying text of an element by which the search enters elements below it.
SHARE, SEMANTIC_SHARE = 0.8, 0.5
#: An element of which more than this is running text of its own is not left for one below.
OWN_TEXT = 0.02
#: In place of a slot: the whole page.
WHOLE = -2
BROADCAST_BYTES = 32_000_000
#: Labels differ by at most so many classes a tag.
CLASSES = 64
#: Shapes, and pairs of shapes, that a task remembers.
REMEMBERED = 1_000_000

# Elements of HTML by their kind.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("script style noscript template head title nav footer aside form button select textarea iframe noembed noframes xmp svg canvas object audio video dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
PEERS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
SEMANTIC = frozenset("article main".split())
TAGS = INLINE | VOID | RAW | LEFT_OUT | CLOSES_P | CONTAINERS | frozenset("thead tfoot th caption option")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$)")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


class Tree:
    """Block elements by number, parents before children: tags, labels, parents, children, and the runs of text in page order."""

    def __init__(self) -> None:
        self.tags, self.labels, self.parent, self.children, self.out, self.inside = ["#page"], ["#page"], [0], [[]], [False], [""]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters outside links

    def add(self, tag: str, parent: int, out: bool = False, inside: str = "", label: str | None = None) -> int:
        self.tags.append(tag)
        self.labels.append(tag if label is None else label)
        self.parent.append(parent)
        self.children.append([])
        self.out.append(out)
        self.inside.append(inside)
        self.children[parent].append(len(self.tags) - 1)
        return len(self.tags) - 1


def _described(tag: str, attributes: str, inside: str) -> tuple[bool, str]:
    """(whether the element is left out, its label). inside: the nearest <article> or <main> around it."""
    known = tag if tag in TAGS else "?"
    out = tag in LEFT_OUT or (tag == "header" and not inside) or (tag == "article" and inside == "article")
    if not attributes:
        return out, known
    name = ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "class":
            name = value
        elif tag not in ("html", "body"):
            if key == "role" and value.lower() == "main":
                known = "main"
            out |= key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true" or key == "style" and bool(_NO_DISPLAY.search(value))
    out |= tag not in ("html", "body") and bool(_HIDDEN.search(_ATTRIBUTE.sub("", attributes)))
    return out, f"{known}.{zlib.crc32(name.encode('utf-8', 'replace')) % CLASSES}" if name else known


def parse(html: str) -> Tree:
    tree, stack, opened, text, links, in_link = Tree(), [0], Counter(), [], 0, 0
    tags, at, skip_to = tree.tags, 0, None

    def flush() -> None:
        nonlocal links
        if text:
            if not tree.out[stack[-1]]:
                raw = "".join(text)
                if run := " ".join(unescape(raw).split()):
                    tree.runs.append((stack[-1], run, round(len(run) * (1 - links / len(raw)))))
            text.clear()
        links = 0

    def close(wanted: tuple, stops: tuple) -> None:
        if not any(opened[w] for w in wanted):
            return
        for k in range(len(stack) - 1, 0, -1):
            if tags[stack[k]] in wanted:
                flush()
                opened.subtract(tags[n] for n in stack[k:])
                del stack[k:]
                return
            if tags[stack[k]] in stops:
                return

    # after the last ">" nothing but a comment can begin, so that no "<" there is looked at again and again
    end, unclosed = html.rfind(">") + 1, False
    for m in _TOKEN.finditer(html, 0, end):
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if skip_to is not None and not (tag and slash and tag.lower() == skip_to):
            continue
        if m.start() > at and skip_to is None:
            text.append(html[at : m.start()])
            if in_link:
                links += m.start() - at
        at, skip_to = m.end(), None
        if not tag:
            unclosed = m[0].startswith("<!--") and not m[0].endswith("-->")
            continue
        tag = tag.lower()
        if tag in ("script", "style"):  # no block: the text around them runs on
            skip_to = None if slash else tag
            continue
        if tag in INLINE and (slash or tag in VOID or not attributes or not _described(tag, attributes, "main")[0]):
            if tag == "a":
                in_link = 0 if slash else 1
            elif tag == "br":
                text.append(" ")
            continue
        if slash:
            if tag == "p" or tag not in VOID:
                close((tag,), ())
            continue
        flush()
        in_link = 0
        if tag in CLOSES_P:
            close(("p",), ("td", "th", "button", "object", "table"))
        if tag in PEERS:
            close(tuple(PEERS[tag][0].split()), PEERS[tag][1])
            if tag == "tr":
                close(("tr",), ("table",))
        if tag in VOID:
            continue
        top = stack[-1]
        out, label = _described(tag, attributes, tree.inside[top])
        kind = label.partition(".")[0]
        stack.append(tree.add(tag, top, tree.out[top] or out, kind if kind in SEMANTIC else tree.inside[top], label))
        opened[tag] += 1
        if tag in RAW:
            skip_to = tag
    if skip_to is None and not unclosed:
        text.append(html[at:].partition("<!--")[0])
    flush()
    return tree


class Shapes:
    """Shapes of subtrees by number, and how many nodes two of them match: simple tree matching, each pair once."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.matched: dict[tuple[int, int], int] = {}

    def of(self, tree: Tree) -> list[int]:
        """The shape of each node."""
        out = [0] * len(tree.tags)
        for k in range(len(out) - 1, -1, -1):
            name = (tree.tags[k], *(out[c] for c in tree.children[k]))
            if (found := self.known.get(name)) is None:
                found = self.known[name] = len(self.tag)
                self.tag.append(name[0])
                self.kids.append(name[1:])
                self.size.append(1 + sum(self.size[c] for c in name[1:]))
            out[k] = found
        return out

    def weight(self, x: int, y: int) -> int:
        """The most nodes of two subtrees that can be paired in order below equal tags."""
        todo, matched = [(x, y)], self.matched
        while todo:
            a, b = todo[-1]
            if (a, b) not in matched:
                if self.tag[a] != self.tag[b]:
                    matched[a, b] = 0
                elif a == b:
                    matched[a, b] = self.size[a]
                else:
                    before, left, right = trimmed(self.kids[a], self.kids[b])
                    same = self.kids[a][:before] + (self.kids[a][before + len(left) :])
                    if missing := [p for p in ((i, j) for i in set(left) for j in set(right)) if p not in matched]:
                        todo += missing
                        continue
                    matched[a, b] = 1 + sum(self.size[k] for k in same) + (int(_scores(*self.table(left, right))[-1]) if left and right else 0)
            todo.pop()
        return matched[x, y]

    def table(self, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights of the kinds on either side, kind of each on the left, on the right)."""
        kinds = [sorted(set(x)) for x in (left, right)]
        at = [{k: j for j, k in enumerate(x)} for x in kinds]
        weights = np.array([[self.weight(i, j) for j in kinds[1]] for i in kinds[0]], np.int64)
        return weights, *(np.array([a[k] for k in x]) for a, x in zip(at, (left, right), strict=True))


def trimmed(left: tuple, right: tuple) -> tuple[int, tuple, tuple]:
    """(length of the common beginning, what is left of either side without common beginning and end).

    Equal shapes at the same end are always paired by some best matching, as no other partner can give either of them more.
    """
    lo, hi = 0, min(len(left), len(right))
    while lo < hi and left[lo] == right[lo]:
        lo += 1
    end = 0
    while end < hi - lo and left[-1 - end] == right[-1 - end]:
        end += 1
    return lo, left[lo : len(left) - end], right[lo : len(right) - end]


def _scores(weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Best weights of pairing all of left, in order, with each beginning of right."""
    row = np.zeros(len(right) + 1, np.int64)
    for kind in left:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[kind, right]))
    return row


def paired(weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The places that a best ordered matching pairs, in linear space: halves of the left with the best cut of the right."""
    out, todo = [], [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            own = weights[left[a], right[c:d]]
            if own.max() > 0:
                out.append((a, c + int(own.argmax())))
            continue
        mid = (a + b) // 2
        cut = c + int((_scores(weights, left[a:mid], right[c:d]) + _scores(weights, left[mid:b][::-1], right[c:d][::-1])[::-1]).argmax())
        todo += [(a, mid, c, cut), (mid, b, cut, d)]
    return out


def align(shapes: Shapes, page: Tree, of_page: list[int], pivot: Tree, of_pivot: list[int]) -> list[int]:
    """Page node to pivot node of a best simple tree matching; -1 for nodes without one."""
    found, todo = [-1] * len(page.tags), [(0, 0)]
    while todo:
        x, y = todo.pop()
        if of_page[x] == of_pivot[y]:  # subtrees are numbered without gaps
            found[x : x + shapes.size[of_page[x]]] = range(y, y + shapes.size[of_page[x]])
            continue
        found[x] = y
        left, right = page.children[x], pivot.children[y]
        lo, inner_l, inner_r = trimmed(tuple(of_page[k] for k in left), tuple(of_pivot[k] for k in right))
        end = len(left) - lo - len(inner_l)
        todo += zip(left[:lo], right[:lo], strict=True)
        todo += zip(left[len(left) - end :], right[len(right) - end :], strict=True)
        if inner_l and inner_r:
            todo += [(left[lo + i], right[lo + j]) for i, j in paired(*shapes.table(inner_l, inner_r))]
    return found


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def skeleton(html: str) -> str:
    """A pivot as JSON: tags, labels, parents, and the hashes of each node's runs."""
    tree = parse(html)
    hashes: list[list[int]] = [[] for _ in tree.tags]
    for node, run, _ in tree.runs:
        hashes[node].append(_hash(run))
    return json.dumps([tree.tags, tree.labels, tree.parent, hashes])


def bare_tree(text: str) -> tuple[Tree, list[set[int]]]:
    """A pivot's tree without its runs, and their hashes by node."""
    tags, labels, parents, hashes = json.loads(text)
    tree = Tree()
    for tag, label, parent in zip(tags[1:], labels[1:], parents[1:], strict=True):
        tree.add(tag, parent, label=label)
    return tree, [set(h) for h in hashes]


def content(tree: Tree, mass: list[int], extra: dict[tuple[int, str], int], share: float = SHARE, semantic_share: float = SEMANTIC_SHARE) -> tuple[set[int], set[tuple[int, str]], set[int]]:
    """(nodes, (node, label) of elements that the tree lacks, headings on the way to them) whose text is content. mass: varying text outside
    links of each node itself; extra: that of elements that the tree lacks, by the node above and their label."""
    below, missing = list(mass), {}
    for (node, label), m in extra.items():
        below[node] += m
        missing.setdefault(node, {})[label] = m
    for k in range(len(below) - 1, 0, -1):
        below[tree.parent[k]] += below[k]
    kept, lacking, headings, roots, at = set(), set(), set(), [], 0
    while True:
        groups: dict[str, list] = {}
        text = mass[at]
        for c in tree.children[at]:
            if tree.labels[c].partition(".")[0] in CONTAINERS:
                group = groups.setdefault(tree.labels[c], [0, []])
                group[0] += below[c]
                group[1].append(c)
            elif tree.tags[c] not in ("h1", "header"):
                text += below[c]
        for label, m in missing.get(at, {}).items():
            if label.partition(".")[0] in CONTAINERS:
                groups.setdefault(label, [0, []])[0] += m
            elif label.partition(".")[0] not in ("h1", "header"):
                text += m
        semantic = [k for k in groups if k.partition(".")[0] in SEMANTIC]
        chosen = []
        if below[at] and tree.tags[at] != "article":
            if semantic and (m := sum(groups[k][0] for k in semantic)) and m >= semantic_share * below[at]:
                chosen = semantic
            elif groups and text <= OWN_TEXT * below[at]:
                lone = max(((below[c] + missing.get(at, {}).get(k, 0), -c) for k, (_, nodes) in groups.items() for c in nodes), default=(0, 0))
                best = max(groups, key=lambda k: (groups[k][0], k))
                if lone[0] >= share * below[at]:  # one element before all of its label
                    chosen, groups = [tree.labels[-lone[1]]], {tree.labels[-lone[1]]: [lone[0], [-lone[1]]]}
                elif groups[best][0] >= share * below[at]:
                    chosen = [best]
        if not chosen:
            roots = [at]
            break
        for c in tree.children[at]:  # headings on the way
            heads = [c] if tree.tags[c] == "h1" else [g for g in tree.children[c] if tree.tags[g] == "h1"] if tree.tags[c] == "header" else []
            headings.update(heads)
        lacking.update((at, k) for k in chosen)
        if missing.get(at):
            lacking.update((at, k) for k in missing[at] if k.partition(".")[0] == "h1")
        roots = [c for k in chosen for c in groups[k][1]]
        if len(roots) != 1:
            break
        at = roots[0]
    kept.update(roots)
    for k in range(1, len(tree.tags)):
        if tree.parent[k] in kept:
            kept.add(k)
        elif tree.parent[k] in headings:
            headings.add(k)
    return kept, lacking, headings


def own_content(tree: Tree) -> set[int]:
    """Nodes whose text is content where the page is all that is known."""
    mass = [0] * len(tree.tags)
    for node, _, prose in tree.runs:
        mass[node] += prose
    kept, _, headings = content(tree, mass, {}, semantic_share=0)
    return kept | headings


def runs_of(html: str, pivot: tuple[Tree, list[set[int]], list[int]], shapes: Shapes) -> list[tuple[int, str, bool, bool, int, str]]:
    """(pivot's node, label of an element below that it lacks or '', whether the pivot has the same run there, whether the page's own
    search picks it, characters outside links, text) of the runs."""
    tree = parse(html)
    if not tree.runs:
        return []
    tops, own = align(shapes, tree, shapes.of(tree), pivot[0], pivot[2]), own_content(tree)
    lacking = [""] * len(tops)
    for k in range(1, len(tops)):
        if tops[k] < 0:
            tops[k], lacking[k] = tops[tree.parent[k]], lacking[tree.parent[k]] or tree.labels[k]
    return [(tops[n], lacking[n], not lacking[n] and _hash(run) in pivot[1][tops[n]], n in own, prose, run) for n, run, prose in tree.runs]


_RUNS = pa.list_(pa.struct([("node", pa.int32()), ("label", pa.string()), ("same", pa.bool_()), ("own", pa.bool_()), ("text", pa.string())]))
_SLOTS = pa.list_(pa.struct([("node", pa.int32()), ("label", pa.string()), ("n", pa.int32()), ("same", pa.int32()), ("prose", pa.int64())]))
_RUNS_SQL = "array<struct<node: int, label: string, same: boolean, own: boolean, text: string>>"
_SLOTS_SQL = "array<struct<node: int, label: string, n: int, same: int, prose: long>>"


def _slots(runs: list[tuple]) -> list[dict]:
    """Per slot: how many runs the page has there, how many of them are the pivot's, and their characters outside links."""
    found: dict[tuple[int, str], list[int]] = {}
    for node, label, same, _, prose, _ in runs:
        counts = found.setdefault((node, label), [0, 0, 0])
        counts[0] += 1
        counts[1] += same
        counts[2] += prose
    return [{"node": k, "label": label, "n": n, "same": same, "prose": prose} for (k, label), (n, same, prose) in found.items()]


def _digest(runs: list[tuple]) -> int:
    """Equal for pages whose own search gives equal text."""
    return int.from_bytes(xxhash.xxh64_digest("\n".join(r[5] for r in runs if r[3]).encode("utf-8", "replace")), "big", signed=True)


def aligned_runs(pages: DataFrame, pivots: DataFrame) -> DataFrame:
    """(page_id, url, host, runs, digest of the text of its own search, slots) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shapes = {}, Shapes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, found, digests, slots = whole.slice(at, 500), [], [], []
                for host, html, pivot in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                    host, html = host.as_py(), html.as_py()
                    runs = []
                    if html:
                        if len(known) > 2000 or len(shapes.tag) + len(shapes.matched) > REMEMBERED:
                            known, shapes = {}, Shapes()
                        if host not in known:
                            tree, hashes = bare_tree(pivot.as_py())
                            known[host] = tree, hashes, shapes.of(tree)
                        runs = runs_of(html, known[host], shapes)
                    found.append([{"node": r[0], "label": r[1], "same": r[2], "own": r[3], "text": r[5]} for r in runs])
                    digests.append(_digest(runs))
                    slots.append(_slots(runs))
                columns = [*batch.columns[:3], pa.array(found, _RUNS), pa.array(digests, pa.int64()), pa.array(slots, _SLOTS)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "runs", "digest", "slots"])

    return pages.join(pivots, "host", "left").select("page_id", "url", "host", "html", "pivot").mapInArrow(run, f"page_id long, url string, host string, runs {_RUNS_SQL}, digest long, slots {_SLOTS_SQL}")


def pivots_of(pages: DataFrame) -> DataFrame:
    """(host, pivot): one page of each host, as a skeleton. Combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([skeleton(h.as_py()) for h in batch.column(1)], pa.string())], ["host", "pivot"])

    first = pages.where("html <> ''").groupBy("host").agg(F.min(F.struct(F.xxhash64("url", "html"), "html")).alias("first"))
    return first.select("host", "first.html").mapInArrow(run, "host string, pivot string")


def induced(pivot: str, pages: int, slots: list[dict], same: float, held: float) -> str:
    """A host's wrapper as JSON: content nodes, labels of content that the pivot lacks, headings on the way, and template nodes."""
    tree, _ = bare_tree(pivot)
    constant = {s["node"] for s in slots if not s["label"] and s["pages"] >= held * pages and s["same"] >= same * s["n"]}
    mass, extra = [0] * len(tree.tags), {}
    for s in slots:
        if s["label"]:
            extra[s["node"], s["label"]] = s["prose"]
        elif s["node"] not in constant:
            mass[s["node"]] = s["prose"]
    kept, lacking, headings = content(tree, mass, extra)
    return json.dumps([sorted(kept), sorted(lacking), sorted(headings), sorted(constant)])


def wrappers_of(found: DataFrame, pivots: DataFrame, min_pages: int = MIN_PAGES, same: float = SAME, held: float = HELD) -> DataFrame:
    """(host, wrapper) of the hosts of at least min_pages different pages, from the runs of all pages."""
    different = found.where("size(slots) > 0").groupBy("host", "digest").agg(F.min("slots").alias("slots"))
    whole = F.array(F.struct(F.lit(WHOLE).alias("node"), F.lit("").alias("label"), F.lit(0).alias("n"), F.lit(0).alias("same"), F.lit(0).cast("long").alias("prose")))
    each = different.select("host", F.explode(F.concat(whole, "slots")).alias("r"))
    slot = each.groupBy("host", "r.node", "r.label").agg(F.count("*").alias("pages"), F.sum("r.n").alias("n"), F.sum("r.same").alias("same"), F.sum("r.prose").alias("prose"))
    host = slot.groupBy("host").agg(F.max(F.when(F.col("node") == WHOLE, F.col("pages"))).alias("pages"), F.collect_list(F.when(F.col("node") != WHOLE, F.struct("node", "label", "pages", "n", "same", "prose"))).alias("slots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [induced(p.as_py(), n.as_py(), s.as_py(), same, held) for p, n, s in zip(*batch.columns[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["host", "wrapper"])

    return host.where(F.col("pages") >= min_pages).join(pivots, "host").select("host", "pivot", "pages", "slots").mapInArrow(run, "host string, wrapper string")


def text_of_runs(runs: list[tuple[int, str, bool, bool, str]], wrapper: tuple[set, set, set, set] | None) -> str:
    """The text of a page by its host's wrapper, or by its own search if there is none or it keeps nothing but headings."""
    if wrapper:
        kept, lacking, headings, constant = wrapper
        picked, beyond = [], False
        for node, label, same, _, t in runs:
            if not (same and node in constant):
                inside = node in kept or ((node, label) in lacking and not label.startswith("h1"))
                beyond |= inside
                if inside or node in headings or (node, label) in lacking:
                    picked.append(t)
        if beyond:
            return " ".join(picked)
    return " ".join(t for _, _, _, own, t in runs if own)


def _texts(joined: DataFrame, induce: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            runs, out = batch.column(2), []
            values, offsets = runs.flatten(), runs.offsets.to_pylist()
            columns = [values.field(k).to_pylist() for k in range(5)]
            for row, wrapper in enumerate(batch.column(3)):
                lo, hi = offsets[row] - offsets[0], offsets[row + 1] - offsets[0]
                if not induce:
                    out.append(" ".join(columns[4][lo:hi]))
                    continue
                if (name := wrapper.as_py()) and name not in known:
                    if len(known) > 2000:
                        known.clear()
                    kept, lacking, headings, constant = json.loads(name)
                    known[name] = set(kept), {tuple(x) for x in lacking}, set(headings), set(constant)
                out.append(text_of_runs([tuple(c[k] for c in columns) for k in range(lo, hi)], known[name] if name else None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "runs", "wrapper").mapInArrow(run, "page_id long, url string, text string")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, same: float = SAME, held: float = HELD, broadcast_bytes: int = BROADCAST_BYTES, induce: bool = True) -> DataFrame:
    """(page_id, url, text) of every page. Without `induce`: all text outside left-out elements, for comparison."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    pivots = stored(pivots_of(rows), "pivots")
    bytes_ = pivots.agg(F.coalesce(F.sum(F.length("pivot") + F.length("host")), F.lit(0))).first()[0]
    small = bytes_ <= broadcast_bytes
    found = stored(aligned_runs(rows, F.broadcast(pivots) if small else pivots), "runs")
    wrappers = stored(wrappers_of(found, pivots, min_pages, same, held), "wrappers")  # no larger than the pivots
    return _texts(found.join(F.broadcast(wrappers) if small else wrappers, "host", "left"), induce)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
