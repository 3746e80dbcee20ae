"""Main text of web pages by a tree-structured graphical model (operator 9).

Every block element of a page is a node that is content or not.  A node's own
potential comes from its tag, the words of its class and id, the share of
linked text, the length of its text and its place; a potential for each kind
of child connects it to its parent.  Sum-product messages run from the leaves
to the root and back, and give each node the exact probability that it is
content, given the whole tree.  Text of nodes of at least one half is the
page's text.

Training maximises the likelihood of labelled pages (gradients come from the
same messages).  Labelled are pages that mark their main part themselves
(``article``, ``main`` or such a role): its blocks are content, but for blocks
inside it that are navigation, notes, forms, adverts or comments by tag or
class; everything else is not.  At most ``SAMPLE`` pages (in the order of a
hash of the id) of at most ``LONGEST`` bytes and ``DEEPEST`` levels are used for the fit, besides a
few hand-labelled layouts that are part of this module; every page is scored
whole.

Defined results: a null or empty page, and one without content, has an empty
text; white space inside a block becomes one space and blocks are joined by
one; a line break counts as white space; repeated rows are extracted each for
itself; an empty table gives an empty table; unclosed and stray tags, cut-off
markup and unknown elements are taken as they come.  An element that is not
shown (``svg``, ``iframe``, ``noscript``, ...) hides what lies before its own
end tag, and nothing if that never comes; ``head`` ends at its end tag or at the
first thing that cannot be in it; a comment without an end goes on to the page's
end.  The work grows with the page's length, whatever its depth.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import free_name

#: Labelled pages for the fit, the longest and the deepest of them; hashed features; steps of the fit.
SAMPLE, LONGEST, DEEPEST, FEATURES, STEPS = 400, 200_000, 256, 1 << 13, 150
#: Nodes whose messages are passed together, and levels from which on a tree's go node by node.
TOGETHER, DEEP = 20_000, 1_000

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span "
                   "strike strong sub sup time tt u var".split())
UNSEEN = frozenset("head script style template noscript iframe object svg math audio video canvas map datalist "
                   "title".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FOREIGN = frozenset(("svg", "math"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr", "td", "th"},
            "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
KINDS = {tag: kind for kind, tags in enumerate((
    "p blockquote pre figcaption dd dt", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu", "li",
    "table thead tbody tfoot tr td th caption", "nav aside footer header form", "article main section")) for tag in tags.split()}
N_KINDS = 8
# Words of class and id that mark other parts within a main part (for labelling only).
OTHER_PARTS = re.compile(r"^(ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disclaimer|disqus|footer|form|login|menu|"
                         r"nav\w*|newsletter|notice|popup|promo\w*|recommend\w*|related|replies|share|sharing|sidebar|"
                         r"social|sponsor\w*|subscribe|tags|toolbar|widget)$")
MAIN_ROLES = frozenset(("main", "article"))


class Node:
    __slots__ = ("tag", "parent", "words", "text", "links", "n_text", "n_links", "n_children", "depth", "label")

    def __init__(self, tag, parent, words, depth):
        self.tag, self.parent, self.words, self.depth = tag, parent, words, depth
        self.n_text = self.n_links = self.n_children = 0


class Tree(HTMLParser):
    """Block elements of a page, and its text as (node, block, text) in page order."""

    def __init__(self, shown: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.shown = shown                                         # unseen elements, by number, that hide nothing
        self.n_unseen, self.unclosed = 0, set()
        self.hidden: list[tuple[str, int]] = []                    # from the outermost unseen element on: tag and number
        self.n_hidden = Counter()                                  # their tags
        self.nodes = [Node("body", -1, (), 0)]
        self.texts: list[tuple[int, int, str]] = []
        self.open: list[tuple[str, int]] = [("body", 0)]           # tag and node (inline elements keep their block's)
        self.places = defaultdict(list)                            # places in it of each tag, and of all blocks ("")
        self.block = self.links = 0

    def _push(self, tag: str, node: int):
        self.places[tag].append(len(self.open))
        if tag not in INLINE:
            self.places[""].append(len(self.open))
        self.open.append((tag, node))

    def _pop(self, at: int):
        for tag, _ in self.open[at:]:
            self.links -= tag == "a"
            self.places[tag].pop()
            if tag not in INLINE:
                self.places[""].pop()
                self.block += 1
        del self.open[at:]

    def _place(self, tag: str) -> int:
        """The place of the innermost open ``tag``, 0 if there is none."""
        at = self.places.get(tag)
        return at[-1] if at else 0

    def _hide(self, tag: str, number: int):
        self.hidden.append((tag, number))
        self.n_hidden[tag] += 1

    def handle_starttag(self, tag, attrs):
        if self.hidden and self.hidden[0][0] == "head" and (
                tag == "body" or len(self.hidden) == 1 and tag not in IN_HEAD):
            self.hidden, self.n_hidden = [], Counter()
        if tag in UNSEEN:
            self.n_unseen += 1
            if self.n_unseen not in self.shown:
                self._hide(tag, self.n_unseen)
            return
        if self.hidden:
            if tag not in VOID:
                self._hide(tag, 0)
            return
        if tag in ("html", "body"):
            return
        if tag in VOID:
            if tag == "br":
                self.texts.append((self.open[-1][1], self.block, " "))
            elif tag == "hr":
                self.block += 1
            return
        if tag in INLINE:
            self._push(tag, self.open[-1][1])
            self.links += tag == "a"
            return
        if tag in CLOSES_P:
            self._close("p", CLOSES_P - {"p"} | {"td", "th", "li", "button"})
        for other in SIBLINGS.get(tag, ()):
            self._close(other, HOLDS[tag])
        words = []
        for key, value in attrs:
            if value and key in ("class", "id", "role", "itemprop"):
                words += [f"{key[0]}:{w}" for w in dict.fromkeys(re.findall(r"[a-z]+", value.lower()))]
        parent = self.open[-1][1]
        self.nodes[parent].n_children += 1
        self.nodes.append(Node(tag, parent, tuple(words), self.nodes[parent].depth + 1))
        self._push(tag, len(self.nodes) - 1)
        self.block += 1

    def _close(self, tag, within):
        """Close the innermost open ``tag`` unless an element of ``within`` lies inside it."""
        at = self._place(tag)
        if at and all(self._place(other) <= at for other in within):
            self._pop(at)

    def _show(self):
        """End the unseen elements that are open.  Those that lack an end tag they need are noted.

        (A script or style without one goes on to the page's end.)
        """
        self.unclosed.update(number for tag, number in self.hidden if number and tag not in ("head", "script", "style"))
        self.hidden, self.n_hidden = [], Counter()

    def _opened(self, tag) -> int:
        """The place of the open element that an end tag closes, 0 if there is none."""
        at = self._place(tag)
        if tag in INLINE and self._place("") > at:
            return 0                                     # a stray end of an inline element closes no block
        return at

    def handle_startendtag(self, tag, attrs):
        if tag in UNSEEN or any(self.n_hidden[t] for t in FOREIGN):
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.n_hidden[tag]:
            closed = ""
            while closed != tag:
                closed, _ = self.hidden.pop()
                self.n_hidden[closed] -= 1
            return
        at = self._opened(tag)
        if at:
            if self.hidden:
                self._show()
            self._pop(at)

    def handle_data(self, data):
        if len(self.hidden) == 1 and self.hidden[0][0] == "head" and data.strip():
            self._show()
        if self.hidden or not data:
            return
        node = self.open[-1][1]
        self.texts.append((node, self.block, data))
        size = len(data.strip())
        if size:
            self.nodes[node].n_text += size
            self.nodes[node].n_links += size if self.links > 0 else 0


    def read(self, html: str) -> "Tree":
        self.feed(html)
        if self.rawdata.startswith("<!--") and self.cdata_elem is None:
            self.rawdata = ""                            # a comment without an end
        self.close()
        return self


def parse(html: str) -> Tree:
    tree = Tree().read(html)
    tree._show()
    if tree.unclosed:                                    # rare: read again, now that it is known which elements have no end
        tree = Tree(frozenset(tree.unclosed)).read(html)
    return tree


def _bucket(n: int) -> int:
    return min(n.bit_length(), 14)


def _hash(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % FEATURES


class _Hashes(dict):
    def __missing__(self, name):
        if len(self) > 200_000:
            self.clear()
        h = self[name] = _hash(name)
        return h


_hashes = _Hashes()


def node_features(tree: Tree) -> list[list[int]]:
    """Hashed features of every node."""
    nodes = tree.nodes
    text, links = [n.n_text for n in nodes], [n.n_links for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):               # children come behind their parents
        text[nodes[i].parent] += text[i]
        links[nodes[i].parent] += links[i]
    total = max(1, text[0])
    out = []
    for i, n in enumerate(nodes):
        up = nodes[n.parent].tag if n.parent >= 0 else ""
        linked = 4 if not text[i] else int(3.999 * links[i] / text[i])
        names = ["bias", f"t:{n.tag}", f"u:{up}>{n.tag}", f"l:{linked}", f"n:{_bucket(text[i])}",
                 f"o:{_bucket(n.n_text)}:{linked}", f"d:{min(n.depth, 8)}", f"c:{_bucket(n.n_children)}",
                 f"s:{int(4.999 * text[i] / total)}", f"tl:{n.tag}:{linked}"]
        names += n.words
        names += [f"{n.tag}.{w}" for w in n.words]
        out.append([_hashes[x] for x in names])
    return out


def labels(tree: Tree) -> list[int] | None:
    """1 for the nodes of the part that the page marks as its main one; None if it marks none."""
    nodes, main, out = tree.nodes, [], []
    found = False
    for n in nodes:
        roles = {w[2:] for w in n.words if w[0] == "r"}
        inside = n.parent >= 0 and main[n.parent] == 1
        other = (n.tag in ("nav", "aside", "form", "footer", "button", "select", "textarea")
                 or any(OTHER_PARTS.match(w[2:]) for w in n.words if w[0] in "ci"))
        below = n.parent >= 0 and main[n.parent] == 2
        if below or inside and other:
            main.append(2)                               # another part within the main one
        elif inside or n.tag in ("article", "main") or roles & MAIN_ROLES or "i:articlebody" in n.words:
            main.append(1)
            found = True
        else:
            main.append(0)
        out.append(int(main[-1] == 1))
    return out if found else None


# -- messages --------------------------------------------------------------------------------------------------------

class Forest:
    """The trees of several pages as arrays; nodes are numbered through, parents before children."""

    def __init__(self):
        self.parent, self.depth, self.kind, self.features, self.size, self.gold = [], [], [], [], [], []

    def add(self, tree: Tree, features: list[list[int]], gold: list[int] | None = None) -> int:
        base = len(self.parent)
        for n, f in zip(tree.nodes, features):
            self.parent.append(base + n.parent if n.parent >= 0 else -1)
            self.depth.append(n.depth)
            self.kind.append(KINDS.get(n.tag, N_KINDS - 1))
            self.features += f
            self.size.append(len(f))
        self.gold += gold or [0] * len(tree.nodes)
        return base

    def close(self):
        self.parent, self.depth, self.kind = (np.array(v, dtype=np.int64) for v in (self.parent, self.depth, self.kind))
        self.features, self.gold = np.array(self.features, dtype=np.int64), np.array(self.gold, dtype=np.int64)
        self.row = np.repeat(np.arange(len(self.parent)), self.size)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, self.depth.max(initial=0) + 1))
        self.levels = np.split(order, cuts)              # nodes by depth
        return self


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(forest: Forest, weights: np.ndarray, edges: np.ndarray, joint: bool = False):
    """Probability of content for every node; with ``joint`` also of each (parent, child) state pair.

    ``edges[kind, parent state, child state]`` are log potentials.
    """
    n = len(forest.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(forest.row, weights=weights[forest.features], minlength=n)
    if len(forest.levels) > DEEP and not joint:
        return _node_by_node(forest, own[:, 1], edges)
    up, message = own.copy(), np.zeros((n, 2))
    for level in forest.levels[:0:-1]:                   # from the leaves to the root
        message[level] = _lse(up[level][:, None, :] + edges[forest.kind[level]], 2)
        above, at = np.unique(forest.parent[level], return_inverse=True)
        for s in (0, 1):
            up[above, s] += np.bincount(at, weights=message[level, s])
    down = np.zeros((n, 2))
    pairs = np.zeros((n, 2, 2)) if joint else None
    for level in forest.levels[1:]:                      # and back
        above = up[forest.parent[level]] + down[forest.parent[level]] - message[level]
        both = above[:, :, None] + edges[forest.kind[level]]
        down[level] = _lse(both, 1)
        if joint:
            full = both + up[level][:, None, :]
            pairs[level] = np.exp(full - _lse(full.reshape(len(level), 4), 1)[:, None, None])
    belief = up + down
    content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    return (content, pairs) if joint else content


def _node_by_node(forest: Forest, own: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The same messages as log odds, for trees with few nodes a level."""
    def passed(odds, table):                             # log odds of what (0, odds) sends through a table of potentials
        (a, b), (c, d) = table
        low, high = max(a, b + odds), max(c, d + odds)
        return (high + math.log(math.exp(c - high) + math.exp(d + odds - high))
                - low - math.log(math.exp(a - low) + math.exp(b + odds - low)))

    parent, kind = forest.parent.tolist(), forest.kind.tolist()
    to_parent, to_child = edges.tolist(), edges.transpose(0, 2, 1).tolist()
    up, message = own.tolist(), [0.0] * len(parent)
    for i in range(len(parent) - 1, -1, -1):             # children come behind their parents
        if parent[i] >= 0:
            message[i] = passed(up[i], to_parent[kind[i]])
            up[parent[i]] += message[i]
    for i, p in enumerate(parent):                       # from here on, ``up`` of a node done is its belief
        if p >= 0:
            up[i] += passed(up[p] - message[i], to_child[kind[i]])
    return 1 / (1 + np.exp(np.clip(-np.array(up), -500, 500)))


class Model:
    def __init__(self):
        self.weights = np.zeros(FEATURES)
        self.edges = np.zeros((N_KINDS, 2, 2))

    def fit(self, forest: Forest, steps: int = STEPS, decay: float = 1e-3, rate: float = 0.1):
        """Adam on the log-likelihood of the labels, a mean over nodes."""
        n = len(forest.parent)
        child = np.flatnonzero(forest.parent >= 0)
        seen_edges = np.zeros_like(self.edges)
        np.add.at(seen_edges, (forest.kind[child], forest.gold[forest.parent[child]], forest.gold[child]), 1)
        state = [[np.zeros_like(v), np.zeros_like(v)] for v in (self.weights, self.edges)]
        for t in range(1, steps + 1):
            content, pairs = marginals(forest, self.weights, self.edges, joint=True)
            error = forest.gold - content
            dw = np.bincount(forest.features, weights=error[forest.row], minlength=FEATURES) / n - decay * self.weights
            de = seen_edges.copy()
            np.subtract.at(de, forest.kind[child], pairs[child])
            de = de / n - decay * self.edges
            for value, g, (m, v) in zip((self.weights, self.edges), (dw, de), state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value += rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        return self


def page_text(tree: Tree, content: np.ndarray) -> str:
    """Text of the nodes that are content: white space inside a block is one space, blocks are joined by one."""
    blocks, now = [], None
    for node, block, text in tree.texts:
        if content[node] < 0.5:
            continue
        if block != now:
            blocks.append([])
            now = block
        blocks[-1].append(text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def extract_pages(pages: list[str], model: Model):
    """The text of each page."""
    held: list[tuple[Tree, int]] = []
    forest = Forest()

    def finish():
        content = marginals(forest.close(), model.weights, model.edges)
        return [page_text(t, content[base:base + len(t.nodes)]) for t, base in held]

    for page in pages:
        tree = parse(page)
        held.append((tree, forest.add(tree, node_features(tree))))
        if len(forest.parent) >= TOGETHER:
            yield from finish()
            held, forest = [], Forest()
    if held:
        yield from finish()


# -- training --------------------------------------------------------------------------------------------------------

#: Layouts labelled by hand: text in capitals is content.  They teach parts that a table may not show.
LAYOUTS = [
    '<header><a href="/">home</a><h2>site name</h2></header><main><h1>TITLE</h1><p>LONG TEXT OF THE PAGE, WITH COMMAS.</p>'
    '<p>MORE TEXT OF IT.</p></main><aside class="sidebar"><h3>more</h3><ul><li><a href="/a">link one</a></li></ul></aside>'
    '<footer><p>all rights reserved</p></footer>',
    '<div id="header"><a href="/">home</a></div><div id="menu"><ul><li><a href="/x">one</a></li><li><a href="/y">two</a></li>'
    '</ul></div><div id="content"><h1>TITLE OF IT</h1><p>FIRST PARAGRAPH, QUITE LONG, OF THE TEXT.</p><ul><li>AN ITEM'
    '</li><li>ANOTHER ITEM</li></ul></div><div id="comments"><h3>comments</h3><div class="comment"><p>nice page, i liked'
    ' it a lot</p></div></div><div id="footer">contact and terms</div>',
    '<nav class="navbar"><a href="/">start</a> <a href="/n">news</a></nav><div class="cookie-notice"><p>we use cookies to '
    'make this site work.</p><button>accept</button></div><article class="post"><h1>A TITLE</h1><p>THE TEXT, LONG AND FULL.'
    '</p><blockquote><p>A QUOTE IN IT.</p></blockquote><div class="ad"><p>buy this now, it is cheap</p></div><p>THE END OF '
    'THE TEXT.</p></article><section class="comments"><h2>3 replies</h2><p>i do not agree with this text at all.</p>'
    '</section>',
    '<div class="wrapper"><div class="main-content"><div class="article-body"><h1>HEADING</h1><p>PARAGRAPH ONE, OF SOME '
    'LENGTH.</p><table><tr><td>CELL ONE</td><td>CELL TWO</td></tr></table><p>PARAGRAPH TWO.</p></div><form><p>your mail '
    'address</p><input><button>subscribe</button></form></div><div class="sidebar"><div class="widget"><h3>popular</h3>'
    '<a href="/p">a page</a></div></div></div><div class="footer"><p>imprint</p></div>',
    '<div class="banner notice"><p>the site will be closed on monday.</p></div><article><header><h1>THE TITLE</h1></header>'
    '<p>BODY OF THE ARTICLE, LONG ENOUGH TO READ.</p><pre>SOME CODE</pre></article><div class="related"><h3>related</h3><ul>'
    '<li><a href="/r">other article</a></li></ul></div><div class="share"><a href="/s">share this</a></div><form class='
    '"newsletter"><label>get our letter</label></form><ul class="breadcrumb"><li><a href="/">home</a></li></ul>',
]


def _layout_labels(tree: Tree) -> list[int]:
    """Content are nodes whose own or nested text is in capitals."""
    upper, lower = [0] * len(tree.nodes), [0] * len(tree.nodes)
    for node, _, text in tree.texts:
        upper[node] += sum(c.isupper() for c in text)
        lower[node] += sum(c.islower() for c in text)
    for i in range(len(tree.nodes) - 1, 0, -1):
        upper[tree.nodes[i].parent] += upper[i]
        lower[tree.nodes[i].parent] += lower[i]
    return [int(u > 2 * low) for u, low in zip(upper, lower)]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the pages that mark their main part, and on the layouts above."""
    marked = F.lower(F.col(html_col)).rlike(r"<(article|main)[\s>]|role=.?(main|article)|articlebody")
    rows = (pages.filter(marked & (F.octet_length(F.col(html_col)) <= LONGEST))
            .select(F.col(id_col).alias("id"), F.col(html_col).alias("html"),
                    F.xxhash64(F.col(id_col)).alias("place"), F.xxhash64(html_col).alias("version")))
    # The few pages are chosen by their hashes; only theirs come to the driver.
    chosen = rows.select("place", "version").distinct().orderBy("place", "version").limit(sample)
    picked = (rows.join(F.broadcast(chosen), ["place", "version"]).groupBy("place", "version")
              .agg(F.first("id").alias("id"), F.first("html").alias("html")))
    forest = Forest()
    for r in sorted(picked.collect(), key=lambda r: (r.id is None, r.id or 0, r.html)):  # at most SAMPLE x LONGEST bytes
        tree = parse(r.html)
        gold = labels(tree)
        if gold is not None and max(n.depth for n in tree.nodes) <= DEEPEST:
            forest.add(tree, node_features(tree), gold)
    for layout in LAYOUTS * 5:
        tree = parse(layout)
        forest.add(tree, node_features(tree), _layout_labels(tree))
    return Model().fit(forest.close())


def extract(pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of every page and its number of code points (``n_chars``)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    text_col, count_col = free_name(pages, text_col), free_name(pages, "n_chars")
    schema = T.StructType(pages.schema.fields + [T.StructField(text_col, T.StringType()),
                                                 T.StructField(count_col, T.LongType())])
    column = pages.columns.index(html_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = list(extract_pages([h or "" for h in part.column(column).to_pylist()], shared.value))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, type=pa.string()),
                     pa.array([len(t) for t in texts], type=pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)
