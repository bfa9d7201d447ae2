"""Main text of web pages by wrapper induction.

The DOM trees of blocks (with runs of like siblings folded into one repeated node) of all pages of a host are aligned one
after the other by simple tree matching, the largest set of node pairs that keeps parents and order. Nodes that stand on
``LEAST_PAGES`` pages make the host's wrapper. All pages are aligned with that, to count on how many each block text stands
in a node's place: a text on ``CONSTANT`` of them or more, and on ``LEAST_PAGES`` at least, is template, the others fill slots. The
article is where the slots are: from the root down, the child that holds ``MAIN`` of the varying text outside links is
followed, and the last such node is the main node. Extraction aligns each page with its host's wrapper, keeps what is below
its main node and leaves out template. Within that, menus, notices, adverts, forms and comments that vary from page to page
go by their elements, roles and class names. Pages that no wrapper covers (a host of fewer than ``LEAST_PAGES`` different
pages, another layout) keep their article or main elements, or all if they have none. Where template would take more than half of
a page's article, the article itself stands on many pages of the host, and its paragraphs and headings stay.

Scale: pages of one shape are merged once, with their number. A host's shapes are merged in blocks of ``SHAPES``, the wrappers
of blocks by ``REFERENCES`` until there is one; texts are counted where pages are read, by 64-bit names. So one task holds a
host's wrapper, never its pages. Wrappers are broadcast if there are at most ``BROADCAST_HOSTS`` hosts, else the pages are
joined to them by host. Pages are otherwise handled where they are read, so a host with a third of all pages is as spread out
as the rest.

Defined cases: a null or empty page has an empty text; a null url has no host and gets no wrapper; unclosed and misnested
tags are closed where a block begins or a parent ends; very long pages are parsed whole in one pass, nesting beyond
``MAX_DEPTH`` is flattened; repeated rows give repeated rows, and equal pages of a host count once; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.batches import by_bytes
from mnemoloom.session import stash

LEAST_PAGES, BROADCAST_HOSTS, BROADCAST_PLACES = 3, 20_000, 1_000_000
#: Different shapes of pages that one task merges to a wrapper, and wrappers of a host that one task then merges.
SHAPES, REFERENCES = 256, 16
#: Share of the pages with a node on which a text must stand there to be template.
CONSTANT = 0.5
#: Share of a node's varying text that one of its children must hold to be where the article is; weight of text in article elements.
MAIN, REGION_WEIGHT = 0.7, 3
#: Nodes of one level whose matching is weighed by what is below them; longer levels are paired by label.
ALIGN = 64
#: Elements nested deeper than this are siblings of their parent's text, as in browsers.
MAX_DEPTH = 512

_TOKEN = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What ends an open paragraph; and, by element, the siblings that its start closes and the parents that this stops at.
ENDS_P = BLOCKS - {"html", "body", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: What no reader sees.
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas audio video select option button input textarea title noembed noframes".split())
DROPPED = UNSEEN | frozenset("nav footer aside form dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup share sharing social related recommended recommendations comment comments commentlist disqus respond replies widget widgets toolbar "
    "pagination pager login copyright".split()
)
OUTSIDE_MARKS = frozenset({"header", "top", "topbar"})
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())


class Node:
    """An element: ``items`` holds child nodes and strings in order."""

    __slots__ = ("tag", "label", "items", "off", "region")

    def __init__(self, tag: str, label: str, off: bool, region: bool):
        self.tag, self.label, self.off, self.region, self.items = tag, label, off, region, []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _open(tag: str, attributes: str, parent: Node) -> Node:
    """A node with its label, whether it is no article by its place, and whether it is inside an article."""
    a = _attributes(attributes)
    names = re.findall(r"[a-z0-9]+", f"{a.get('class', '')} {a.get('id', '')}".lower())
    region = parent.region or tag in ("article", "main") or a.get("role", "").lower() in ("article", "main")
    off = parent.off or tag in DROPPED or not MARKS.isdisjoint(names) or a.get("role", "").lower() in ROLES or "hidden" in a
    if not off and not parent.region:
        off = tag == "header" or not OUTSIDE_MARKS.isdisjoint(names)
    label = f"{tag}.{'.'.join(sorted(set(a.get('class', '').lower().split())))}" if a.get("class") else tag
    return Node(tag, label, off, region and not off)


def parse(html: str) -> Node:
    """The DOM tree of ``html``."""
    root = Node("#", "#", False, False)
    stack, at, n = [root], 0, len(html)

    def close_to(names, stops) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                close_to(names, stops)
                return
            if stack[i].tag in stops:
                return

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].items.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].items.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "p" and all(x.tag != "p" for x in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS and tag not in BLOCKS:
                    break  # an inline element doesn't end the block around it
            continue
        if tag in ENDS_P:
            close_to({"p"}, {"table", "td", "th", "button", "object", "caption", "html"})
        if tag in CLOSES:
            close_to(*CLOSES[tag])
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        node = _open(tag, m[3] if m[2] else m[6], stack[-1])
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(html, at)
            node.items.append(unescape(html[at : end.start()]) if tag in ("title", "textarea") else html[at : end.start()])
            after = html.find(">", end.start())
            at = n if after < 0 else after + 1
        elif tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def squeeze(text: str) -> str:
    return " ".join(text.split())


class Folded:
    """A node of the folded tree: the nodes folded into it, and the folded nodes below."""

    __slots__ = ("label", "tag", "kids", "nodes")

    def __init__(self, label: str, tag: str, kids: list, nodes: list):
        self.label, self.tag, self.kids, self.nodes = label, tag, kids, nodes


def fold(nodes: list[Node]) -> Folded:
    """One folded node for a run of siblings with one label. Inline elements are part of their block's text, not nodes of their own."""
    runs: list[list[Node]] = []
    for node in nodes:
        for x in node.items:
            if isinstance(x, Node) and x.tag in BLOCKS:
                if runs and runs[-1][0].label == x.label:
                    runs[-1].append(x)
                else:
                    runs.append([x])
    return Folded(nodes[0].label, nodes[0].tag, [fold(r) for r in runs], nodes)


def own_text(node: Node) -> tuple[str, int]:
    """(text, characters of it in links) of a block without the blocks below it."""
    parts: list[str] = []
    linked, stack = 0, [(x, False) for x in reversed(node.items)]
    while stack:
        x, link = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            linked += len(x) if link else 0
        elif x.tag not in BLOCKS and x.tag not in UNSEEN:
            stack += [(y, link or x.tag == "a") for y in reversed(x.items)]
    return squeeze("".join(parts)), linked


def pairing(x: list, y: list) -> list[tuple[int, int]]:
    """A longest common subsequence of the labels of two long levels, by bit vectors: exact at any length."""
    places: dict[str, int] = {}
    for i, p in enumerate(x):
        places[p.label] = places.get(p.label, 0) | 1 << i
    full = (1 << len(x)) - 1
    rows = [full]
    for q in y:
        u = rows[-1] & places.get(q.label, 0)
        rows.append((rows[-1] + u | rows[-1] - u) & full)
    i, j, out = len(x), len(y), []
    while i and j:
        if rows[j] >> i - 1 & 1:
            i -= 1
        elif not rows[j - 1] >> i - 1 & 1:
            j -= 1
        else:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return out


def match(a, b, pairs: list) -> int:
    """Simple tree matching of two folded trees with equal root labels: its size, with the node pairs added to ``pairs``.

    Levels of more than ``ALIGN`` nodes are paired by label first and matched below the pairs.
    """
    pairs.append((a, b))
    x, y = a.kids, b.kids
    if not x or not y:
        return 1
    size = 1
    if len(x) == len(y) and all(p.label == q.label for p, q in zip(x, y)):
        for p, q in zip(x, y):
            size += match(p, q, pairs)
        return size
    if len(x) > ALIGN or len(y) > ALIGN:
        for i, j in pairing(x, y):
            size += match(x[i], y[j], pairs)
        return size
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    held: dict = {}
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            gain = 0
            if p.label == q.label:
                own: list = []
                gain = match(p, q, own)
                held[i, j] = (gain, own)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain if gain else 0)
    i, j = len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += held[i - 1, j - 1][1]
            i, j = i - 1, j - 1
    return 1 + best[len(x)][len(y)]


class Wrapper:
    """A node of a wrapper: on how many pages it stood.

    ``common`` are the names of the texts that make its blocks template, ``main`` marks the node that holds the article.
    """

    __slots__ = ("label", "tag", "seen", "common", "main", "kids")

    def __init__(self, label: str, tag: str, seen: int = 0):
        self.label, self.tag, self.seen, self.common, self.main, self.kids = label, tag, seen, frozenset(), False, []

    def merge(self, other: Wrapper) -> None:
        """Align ``other`` with this wrapper; nodes that it lacks are added after their aligned left neighbour."""
        pairs: list = []
        match(self, other, pairs)
        mine = {id(t): w for w, t in pairs}
        for w, t in pairs:
            w.seen += t.seen
            at, places = 0, None
            for kid in t.kids:
                if (own := mine.get(id(kid))) is not None:
                    places = places or {id(x): i for i, x in enumerate(w.kids)}
                    at = places[id(own)] + 1
                else:
                    w.kids.insert(at, kid)
                    at, places = at + 1, None

    def nodes(self) -> list[Wrapper]:
        """All nodes in the order of :meth:`dump`."""
        out, stack = [], [self]
        while stack:
            out.append(stack.pop())
            stack += reversed(out[-1].kids)
        return out

    def prune(self) -> None:
        """Drop what stood on fewer than ``LEAST_PAGES`` pages."""
        for w in self.nodes():
            w.kids = [k for k in w.kids if k.seen >= LEAST_PAGES]

    def settle(self, own: list[int]) -> None:
        """Mark the node that holds the article.

        The mass of a node is its varying text outside links, ``own`` by node, and that below; in article elements it counts
        ``REGION_WEIGHT`` times.
        """
        order = self.nodes()
        mass: dict[int, int] = {}
        for w, m in zip(reversed(order), reversed(own)):
            mass[id(w)] = m + sum(mass[id(k)] for k in w.kids)
        node = self
        while node.kids and mass[id(node)]:
            best = max(node.kids, key=lambda k: mass[id(k)])
            if best.tag in PROSE or best.tag in UNSEEN or mass[id(best)] < MAIN * mass[id(node)]:
                break
            node = best
        node.main = node.tag not in ("#", "html", "body")

    def dump(self) -> list:
        """Rows (parent's row, label, tag, common texts, main, pages), parents first."""
        at: dict[int, int] = {id(self): -1}
        rows = []
        for i, w in enumerate(self.nodes()):
            rows.append([at[id(w)], w.label, w.tag, sorted(w.common), w.main, w.seen])
            at.update((id(k), i) for k in w.kids)
        return rows

    @classmethod
    def load(cls, rows: list) -> Wrapper:
        made = []
        for parent, label, tag, common, main, seen in rows:
            w = cls(label, tag, seen)
            w.common, w.main = frozenset(common), main
            made.append(w)
            if parent >= 0:
                made[parent].kids.append(w)
        return made[0]


def name_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def outline(page: str) -> tuple[str, list[tuple[int, int, int]]]:
    """(shape, texts) of a page: its folded nodes (parent, label, tag), parents first, as JSON, and (node, name, mass) of each text there."""
    rows, texts, stack = [], [], [(fold([parse(page)]), -1)]
    while stack:
        tree, parent = stack.pop()
        own: dict[int, int] = {}
        for n in tree.nodes:
            text, linked = own_text(n)
            if text:
                name = name_of(text)
                own[name] = own.get(name, 0) + max(0, len(text) - linked) * (REGION_WEIGHT if n.region else 1)
        texts += [(len(rows), name, mass) for name, mass in own.items()]
        rows.append([parent, tree.label, tree.tag])
        stack += [(k, len(rows) - 1) for k in reversed(tree.kids)]
    return json.dumps(rows), texts


def shaped(shape: str, seen: int) -> Wrapper:
    """The wrapper of ``seen`` pages of one shape."""
    return Wrapper.load([[*row, (), False, seen] for row in json.loads(shape)])


def merged(parts: list[Wrapper]) -> Wrapper:
    for part in parts[1:]:
        parts[0].merge(part)
    return parts[0]


def skeleton(shapes: Iterable[tuple[str, int]]) -> Wrapper:
    """What pages of these shapes, given with the number of pages of each, have in common: the most frequent first."""
    return merged([shaped(s, n) for s, n in sorted(shapes, key=lambda x: (-x[1], x[0]))])


def places(wrapper: Wrapper, shape: str) -> list[tuple[int, bool]]:
    """For each node of ``shape`` the place of its node in ``wrapper`` and True, or of the nearest above that has one and False."""
    rows, pairs = json.loads(shape), []
    tree = shaped(shape, 1)
    match(wrapper, tree, pairs)
    number = {id(w): i for i, w in enumerate(wrapper.nodes())}
    mine = {id(t): number[id(w)] for w, t in pairs}
    out: list[tuple[int, bool]] = []
    for (parent, *_), t in zip(rows, tree.nodes()):
        at = mine.get(id(t))
        out.append((at, True) if at is not None else (out[parent][0], False))
    return out


def tally(where: list[tuple[int, bool]], texts: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int | None, int, int]]:
    """(place, name, pages, mass) of one page: each place's page under no name, with the mass of what has no place of its own; then each text."""
    seen = {at: 0 for at, _ in where}
    named: dict[tuple[int, int], int] = {}
    for node, name, mass in texts:
        at, own = where[node]
        if own:
            named[at, name] = named.get((at, name), 0) + mass
        else:
            seen[at] += mass
    yield from ((at, None, 1, mass) for at, mass in seen.items())
    yield from ((at, name, 1, mass) for (at, name), mass in named.items())


def is_common(n, seen):
    """Whether a text on ``n`` of a node's ``seen`` pages is template; of numbers or columns."""
    return (n >= LEAST_PAGES) & (n >= CONSTANT * seen)


def induce(pages: list[str]) -> Wrapper | None:
    """The wrapper of a host's ``pages``; None if too few differ. As :func:`wrappers` does, in one place."""
    outlines = [outline(p) for p in dict.fromkeys(pages)]
    if len(outlines) < LEAST_PAGES:
        return None
    wrapper = skeleton(Counter(shape for shape, _ in outlines).items())
    wrapper.prune()
    sums: dict[tuple, list[int]] = {}
    for shape, texts in outlines:
        for at, name, n, mass in tally(places(wrapper, shape), texts):
            held = sums.setdefault((at, name), [0, 0])
            held[0] += n
            held[1] += mass
    order = wrapper.nodes()
    own = [0] * len(order)
    for (at, name), (n, mass) in sums.items():
        if name is not None and is_common(n, sums[at, None][0]):
            order[at].common |= {name}
        else:
            own[at] += mass
    wrapper.settle(own)
    return wrapper


def align(root: Node, wrapper: Wrapper | None) -> tuple[set[int], set[int]]:
    """Ids of a page's nodes: the blocks whose own text is template, and those that the wrapper's main node stands for."""
    if wrapper is None:
        return set(), set()
    pairs: list = []
    match(wrapper, fold([root]), pairs)
    template, main = set(), set()
    for w, t in pairs:
        if w.common:
            template.update(id(n) for n in t.nodes if name_of(own_text(n)[0]) in w.common)
        if w.main:
            main.update(id(n) for n in t.nodes)
    return template, main


def blocks(root: Node, template: set[int], inside: set[int] | None, marks: bool = True) -> list[str]:
    """Texts of the blocks that count, in page order; of those below the nodes ``inside`` alone, if given."""
    out: list[str] = []
    open_: list[str] = []

    def flush() -> None:
        if text := squeeze("".join(open_)):
            out.append(text)
        open_.clear()

    stack: list[tuple[Node, int, bool, bool]] = [(root, 0, inside is None, True)]  # node, next item, inside, no template
    while stack:
        node, i, within, fresh = stack.pop()
        if i == 0 and node.tag in BLOCKS:
            flush()
            fresh = id(node) not in template
        if node.off if marks else node.tag in UNSEEN:
            open_.append(" ")
            continue
        within = within or id(node) in inside
        while i < len(node.items):
            x = node.items[i]
            i += 1
            if isinstance(x, str):
                if within and fresh:
                    open_.append(x)
            elif x.tag in ("br", "hr", "wbr") or x.tag in VOID:
                open_.append("" if x.tag == "wbr" else " ")
            else:
                stack.append((node, i, within, fresh))
                stack.append((x, 0, within, fresh))
                break
        else:
            if node.tag in BLOCKS:
                flush()
    flush()
    return out


def regions(root: Node) -> set[int] | None:
    """Ids of the outermost article and main elements; None if there is none."""
    found, stack = set(), [root]
    while stack:
        node = stack.pop()
        if node.region:
            found.add(id(node))
        elif not node.off:
            stack += [x for x in node.items if isinstance(x, Node)]
    return found or None


def prose(root: Node) -> set[int]:
    """Ids of the paragraphs, headings, items and cells of a page."""
    found, stack = set(), [root]
    while stack:
        node = stack.pop()
        if node.tag in PROSE:
            found.add(id(node))
        stack += [x for x in node.items if isinstance(x, Node)]
    return found


def extract(html: str | None, wrapper: Wrapper | None = None, marks: bool = True) -> str:
    """Main text of one page: its blocks joined by empty lines. Without ``marks``, by the wrapper alone."""
    if not html:
        return ""
    root = parse(html)
    template, main = align(root, wrapper)
    inside = main or (regions(root) if marks else None)
    found = blocks(root, template, inside, marks)
    if template and 2 * sum(map(len, found)) < sum(map(len, blocks(root, set(), inside, marks))):
        found = blocks(root, template - prose(root), inside, marks)
    return "\n\n".join(found)


def host_of(url: Column) -> Column:
    """The host of ``url`` in small letters, without user and port; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) for every host with enough different pages; the wrapper as JSON."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for host, page in zip(frame["host"], frame["html"]):
                shape, texts = outline(page)
                rows.append((host, xxhash.xxh3_128_hexdigest(page.encode("utf-8", "surrogatepass")), shape, *([t[i] for t in texts] for i in range(3))))
            yield pd.DataFrame(rows, columns=["host", "page", "shape", "nodes", "names", "masses"])

    rows = by_bytes(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host is not null and html <> ''"))
    drawn = rows.mapInPandas(draw, "host string, page string, shape string, nodes array<int>, names array<bigint>, masses array<bigint>")
    drawn = stash(drawn.dropDuplicates(["host", "page"]), "outlines")
    enough = drawn.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES).select("host")
    shapes = stash(drawn.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")).join(enough, "host", "left_semi"), "shapes")

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        made = skeleton(zip(frame["shape"], frame["n"].tolist()))
        return pd.DataFrame([(frame["host"].iloc[0], frame["block"].iloc[0], json.dumps(made.dump()))], columns=["host", "block", "wrapper"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        made = merged([Wrapper.load(json.loads(w)) for w in frame.sort_values("block")["wrapper"]])
        return pd.DataFrame([(frame["host"].iloc[0], frame["into"].iloc[0], json.dumps(made.dump()))], columns=["host", "block", "wrapper"])

    many = shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / SHAPES).alias("blocks"))
    dealt = shapes.join(many, "host").withColumn("block", F.pmod(F.xxhash64("shape"), F.col("blocks")).cast("int")).select("host", "block", "shape", "n")
    parts = stash(dealt.groupBy("host", "block").applyInPandas(part, "host string, block int, wrapper string"), "parts")
    while (parts.agg(F.max("block")).first()[0] or 0) > 0:
        into = parts.withColumn("into", F.floor(F.col("block") / REFERENCES).cast("int"))
        parts = stash(into.groupBy("host", "into").applyInPandas(join, "host string, block int, wrapper string"), "parts")

    def pruned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [Wrapper.load(json.loads(w)) for w in frame["wrapper"]]
            for w in made:
                w.prune()
            yield pd.DataFrame({"host": frame["host"], "wrapper": [json.dumps(w.dump()) for w in made]})

    whole = stash(by_bytes(parts.select("host", "wrapper")).mapInPandas(pruned, "host string, wrapper string"), "skeletons")
    small = whole.count() <= BROADCAST_HOSTS

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Wrapper] = {}
        known: dict[tuple, list] = {}
        for frame in frames:
            sums: dict[tuple, list[int]] = {}
            for host, shape, wrapper, *texts in zip(*(frame[c] for c in ("host", "shape", "wrapper", "nodes", "names", "masses"))):
                if host not in loaded:
                    if len(loaded) > 500:
                        loaded.clear()
                    loaded[host] = Wrapper.load(json.loads(wrapper))
                if (host, shape) not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[host, shape] = places(loaded[host], shape)
                for at, name, n, mass in tally(known[host, shape], zip(*(t.tolist() for t in texts))):
                    held = sums.setdefault((host, at, name), [0, 0])
                    held[0] += n
                    held[1] += mass
            out = pd.DataFrame([(host, at, *v) for (host, at, _), v in sums.items()], columns=["host", "place", "n", "mass"])
            out.insert(2, "name", pd.array([name for *_, name in sums], dtype="Int64"))  # no way by floats
            yield out

    met = by_bytes(drawn.join(F.broadcast(whole) if small else whole, "host").select("host", "shape", "wrapper", "nodes", "names", "masses"))
    sums = met.mapInPandas(count, "host string, place int, name bigint, n bigint, mass bigint")
    sums = stash(sums.groupBy("host", "place", "name").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")), "tallies")
    # sums by place first, so that no task holds all texts of a place
    total = sums.groupBy("host", "place").agg(F.sum(F.when(F.col("name").isNull(), F.col("n"))).alias("seen"), F.sum("mass").alias("mass"))
    total = stash(total, "places")
    seen = total.select("host", "place", "seen")
    often = sums.where(F.col("name").isNotNull() & (F.col("n") >= LEAST_PAGES)).join(F.broadcast(seen) if seen.count() <= BROADCAST_PLACES else seen, ["host", "place"])
    common = often.where(is_common(F.col("n"), F.col("seen"))).groupBy("host", "place").agg(F.collect_list("name").alias("common"), F.sum("mass").alias("less"))
    facts = total.join(common, ["host", "place"], "left")
    facts = facts.select("host", "place", F.coalesce("common", F.array().cast("array<bigint>")).alias("common"), (F.col("mass") - F.coalesce("less", F.lit(0))).alias("own"))
    facts = facts.groupBy("host").agg(F.collect_list("place").alias("places"), F.collect_list("common").alias("commons"), F.collect_list("own").alias("owns"))

    def settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for wrapper, at, commons, owns in zip(*(frame[c] for c in ("wrapper", "places", "commons", "owns"))):
                w = Wrapper.load(json.loads(wrapper))
                order = w.nodes()
                own = [0] * len(order)
                for i, names, mass in zip(at.tolist(), commons, owns.tolist()):
                    order[i].common, own[i] = frozenset(names.tolist()), mass
                w.settle(own)
                made.append(json.dumps(w.dump()))
            yield pd.DataFrame({"host": frame["host"], "wrapper": made})

    return by_bytes(whole.join(facts, "host")).mapInPandas(settled, "host string, wrapper string")


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    found = stash(wrappers(pages, url, html), "wrappers")
    small = found.count() <= BROADCAST_HOSTS
    rows = pages.select(F.col(key).cast("string").alias("k"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    joined = by_bytes(rows.join(F.broadcast(found) if small else found, "host", "left").select("k", "url", "html", "wrapper"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str | None, Wrapper | None] = {None: None}
        for frame in frames:
            texts = []
            for page, held in zip(frame["html"], frame["wrapper"]):
                if held not in loaded:
                    if len(loaded) > 500:
                        loaded = {None: None}
                    loaded[held] = Wrapper.load(json.loads(held))
                texts.append(extract(page, loaded[held]))
            yield pd.DataFrame({"k": frame["k"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    made = joined.mapInPandas(run, "k string, url string, text string, n_chars bigint")
    return made.select(F.col("k").cast(dict(pages.dtypes)[key]).alias(key), F.col("url").alias(url), "text", "n_chars")
