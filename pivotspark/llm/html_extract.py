"""HTML main-text extraction by wrapper induction.

Pages of a host share a template.  Each page's DOM is first folded: sibling
elements of the same tag and class become one node that holds the text blocks
of all of them, so a page's tree has the size of its layout, not of its text.
The host's seed tree (that of the page with the smallest hash) is aligned with
every page of the host by simple tree matching, the matched nodes' blocks are
counted over the host's different pages, and blocks that nearly all of them
show at the same seed node become the host's template.  What varies is
content.  A host of few pages has less to show, so there a template block must
be on all of them, outside article and main, and on no other host, and all of
them together must be half of the longest page's text at most (else the pages
are copies of one another).

A page's text is then the blocks of its content slots: the article or main
element if it has one with a tenth of the text at least, else the body, without
elements whose tag, role, class or id says menu, header, footer, sidebar,
notice, advert, form or comments, and without template blocks.  A class or id
drops no element that wraps the article (or most of a page without one).
Blocks are joined by two line feeds.

Trees are known by their hash; each is stored once and aligned once with a
seed.  Markup is read in slices of ``SLICE`` bytes (one page at least).
Nothing of a host meets in one task: seeds are a minimum, blocks are counted
with partial sums, and pages join their host's seed and template as plain
tables, where a hot host's rows can be split.

Defined results: null or empty html gives "" ; broken markup is repaired as
HTML's implied end tags ask for; pages without a host, and hosts with a single
different page, have no template; repeated pages count
once; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import text_slices
from .common import stored
from .url_filter import host_of

#: Different pages of a host from which a template can be told, and those
#: from which their number alone says enough.
FEW_PAGES = 2
MIN_PAGES = 8
#: Markup that a task turns into trees at a time, rows of packed blocks that
#: it opens at a time, and shapes whose trees a task remembers to have sent.
SLICE = 1 << 20
ROWS = 512
SHAPES = 1 << 18
#: Share of a host's different pages that show a template block, in percent.
TEMPLATE_PCT = 90

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template nav aside form button select textarea iframe object svg "
                    "canvas dialog head menu title audio video map".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 "
                  "h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th "
                  "thead tr ul caption".split())
#: What an opening tag closes, up to the nearest of the given scopes.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "thead", "tbody"),
           "tfoot": ("tr", "td", "th", "tbody", "thead")}
_SCOPES = frozenset(("ul", "ol", "dl", "table", "select", "html", "body"))
_ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "legend"}
_P_SCOPES = _SCOPES | {"li", "td", "th", "div", "article", "section", "blockquote", "main"}
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"))
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_TAG_END = re.compile(r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"']\S*+)))?+""")
_CUES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|"
    r"footer|masthead|topbar|cookies?|consent|gdpr|notice|disclaimer|popup|modal|overlay|newsletter|subscribe|signup|"
    r"login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|reader-comments|widget)(?:$|[\s_-])")


#: Readers' words are none of the article's, however many they are.
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|reader-comments)(?:$|[\s_-])")
#: Classes and ids of a page's header, as against that of an article.
_HEADER = re.compile(r"(?:^|\s)(?:(?:site|page|main|global|top)[_-]?)?header(?:$|\s)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


#: What an element's class and id say of it.
NO_CUE, CUE, COMMENT_CUE = 0, 1, 2


class _Node:
    __slots__ = ("tag", "cls", "parent", "children", "dropped", "main", "cue", "block")

    def __init__(self, tag: str, cls: str, parent, dropped: bool, main: bool, cue: int = NO_CUE):
        self.tag, self.cls, self.parent, self.dropped, self.main, self.cue = tag, cls, parent, dropped, main, cue
        self.children: list = []
        # The element that a text in this one is a block of.
        self.block = self if parent is None or tag in BLOCK else parent.block


class Dom:
    """Tree of elements and, in page order, the text blocks that no dropped
    element holds.  The markup is read once from left to right; what it leaves
    open at its end is cut off.

    Tags and roles drop at once.  A cue in a class or id drops an element when
    the page is known: not if it holds most of the text of all article and main
    elements, nor, on a page without any, most of the text (but for comments).
    """

    def __init__(self, markup: str):
        self.root = self.at = _Node("#root", "", None, False, False)
        self.nodes = [self.root]
        self.open: Counter = Counter()
        self.blocks: list[tuple[_Node, str]] = []
        self.text: list[str] = []
        self.owner: _Node | None = None
        self.read(markup)
        self.flush()
        if any(node.cue for node in self.nodes):
            self.judge_cues()

    def judge_cues(self) -> None:
        number = {id(node): i for i, node in enumerate(self.nodes)}
        up = [number.get(id(node.parent), -1) for node in self.nodes]
        chars, own = [0] * len(up), [0] * len(up)
        for node, block in self.blocks:
            chars[number[id(node)]] += len(block)
            own[number[id(node)]] += len(block) if node.main else 0
        for i in range(len(up) - 1, 0, -1):  # an element comes behind its parent
            chars[up[i]] += chars[i]
            own[up[i]] += own[i]
        gone = [False] * len(up)
        for i, node in enumerate(self.nodes):
            most = 2 * own[i] > own[0] if own[0] else node.cue == CUE and 2 * chars[i] > chars[0]
            inside = node.parent is not None and node.parent.main  # an article's own part, not a wrapper of it
            gone[i] = i > 0 and gone[up[i]] or bool(node.cue) and (inside or not most)
        self.blocks = [(node, block) for node, block in self.blocks if not gone[number[id(node)]]]

    def release(self) -> None:
        """Cut the references in circles, so that the tree goes when it is no
        longer needed and not when the collector comes by."""
        for node in self.nodes:
            node.parent = node.block = None
            node.children = []
        self.nodes, self.blocks = [], []

    def read(self, markup: str) -> None:
        at, strict = 0, True
        while at < len(markup):
            start = markup.find("<", at)
            if start < 0:
                self.data(markup[at:])
                return
            if start > at:
                self.data(markup[at:start])
            after = markup[start + 1:start + 2]
            if markup.startswith("<!--", start):
                end = markup.find("-->", start + 2)
                at = end + 3
                if end < 0:
                    return
            elif after in ("!", "?") or after == "/" and not markup[start + 2:start + 3].isalpha():
                end = markup.find(">", start)
                at = end + 1
                if end < 0:
                    return
            elif m := _NAME.match(markup, start):
                closing, tag = m.group(1), m.group(2).lower()
                end = _TAG_END.match(markup, m.end()) if strict else None
                if end is None:
                    # A quote is never closed: from here on, tags end at ">".
                    strict = False
                    stop = markup.find(">", m.end())
                    if stop < 0:
                        return
                    at = stop + 1
                else:
                    at = end.end()
                if closing:
                    self.end(tag)
                    continue
                self.start(tag, markup[m.end():at - 1])
                if tag in RAW:
                    end = _raw_end(tag).search(markup, at)
                    if end is None:
                        return
                    at = end.start()
            else:
                self.data("<")
                at = start + 1

    def flush(self) -> None:
        if self.text:
            block = " ".join("".join(self.text).split())
            if block:
                self.blocks.append((self.owner, block))
            self.text = []
        self.owner = None

    def close_to(self, node: _Node) -> None:
        """Close ``node`` and all in it."""
        while True:
            self.open[self.at.tag] -= 1
            done = self.at is node
            self.at = self.at.parent
            if done:
                return

    def close_open(self, tags, scopes=_SCOPES) -> None:
        """Close the outermost open element of ``tags`` within the scope."""
        if not any(self.open[t] for t in tags):
            return
        node, hit = self.at, None
        while node.parent is not None and node.tag not in scopes:
            if node.tag in tags:
                hit = node
            node = node.parent
        if hit is not None:
            self.close_to(hit)

    def start(self, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag in _ENDS_P:
            self.close_open(("p",), _P_SCOPES)
        if tag in _CLOSES:
            self.close_open(_CLOSES[tag])
        if tag == "br":
            self.data(" ")
        if tag in VOID:
            return
        a = {m[0].lower(): m[1] or m[2] or m[3] for m in reversed(_ATTRIBUTE.findall(rest))} if rest.strip() else {}
        cls = " ".join(sorted(a.get("class", "").lower().split()))
        up, role = self.at, a.get("role", "").lower()
        marks = f"{cls} {a.get('id', '').lower()}"
        main = up.main or tag in ("article", "main") or role in ("main", "article")
        keeps = tag in ("html", "body", "article", "main")
        dropped = (up.dropped or tag in DROPPED or role in _ROLES or "hidden" in a or a.get("aria-hidden") == "true"
                   or bool(_HIDDEN.search(a.get("style", ""))) or tag == "footer" or tag == "header" and not up.main)
        cue = NO_CUE
        if not keeps and marks != " " and not dropped:
            if _COMMENTS.search(marks):
                cue = COMMENT_CUE
            elif _CUES.search(marks) or not up.main and _HEADER.search(marks):
                cue = CUE
        node = _Node(tag, cls, up, dropped, main, cue)
        self.nodes.append(node)
        up.children.append(node)
        self.open[tag] += 1
        self.at = node

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.data(" ")
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self.close_to(node)

    def data(self, text: str) -> None:
        if self.at.dropped:
            return
        owner = self.at.block
        if self.owner is not owner:
            self.flush()
            self.owner = owner
        self.text.append(unescape(text) if "&" in text else text)


def parse(html: str | None) -> Dom:
    return Dom(html or "")


def fold(dom: Dom) -> tuple[list[tuple[str, int]], list[int]]:
    """The folded tree as (label, parent number) in preorder, and the folded
    node of each text block.  Siblings of one label share a node."""
    nodes: list[tuple[str, int]] = [("#root", -1)]
    number: dict[int, int] = {id(dom.root): 0}
    known: dict[tuple[int, str], int] = {}
    stack = list(reversed(dom.root.children))
    while stack:
        node = stack.pop()
        up = number[id(node.parent)]
        label = f"{node.tag}.{node.cls}"
        at = known.get((up, label))
        if at is None:
            at = known[up, label] = len(nodes)
            nodes.append((label, up))
        number[id(node)] = at
        stack += reversed(node.children)
    return nodes, [number[id(owner)] for owner, _ in dom.blocks]


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)


def _children(nodes: list[tuple[str, int]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in nodes]
    for i, (_, up) in enumerate(nodes):
        if up >= 0:
            out[up].append(i)
    return out


def _chain(pairs: list[tuple[int, int, int]]) -> tuple[int, list[int]]:
    """Heaviest chain of (place, other place, weight), both places rising;
    first places rise already and no place occurs twice.  Returns its weight
    and its members.  A Fenwick tree holds the best chain up to each place."""
    rank = {q: k for k, q in enumerate(sorted(q for _, q, _ in pairs))}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(pairs) + 1)
    back = []
    top = (0, -1)
    for k, (_, q, weight) in enumerate(pairs):
        best, i = (0, -1), rank[q]
        while i > 0:
            best = max(best, tree[i])
            i &= i - 1
        back.append(best[1])
        best, i = (best[0] + weight, k), rank[q] + 1
        top = max(top, best)
        while i <= len(pairs):
            tree[i] = max(tree[i], best)
            i += i & -i
    members, k = [], top[1]
    while k >= 0:
        members.append(k)
        k = back[k]
    return top[0], members


def align(page: list[tuple[str, int]], seed: list[tuple[str, int]]) -> list[int]:
    """Simple tree matching of two folded trees: the seed node of each page
    node, -1 if unmatched.  The largest order-preserving matching of nodes with
    equal labels whose parents match; folding leaves one child per label, so a
    node has one candidate at most."""
    a, b = _children(page), _children(seed)
    result: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    stack = [(0, 0, False)]
    while stack:
        i, j, ready = stack.pop()
        place = {seed[y][0]: q for q, y in enumerate(b[j])}
        same = [(p, place[page[x][0]]) for p, x in enumerate(a[i]) if page[x][0] in place]
        if not ready:
            stack.append((i, j, True))
            stack += [(a[i][p], b[j][q], False) for p, q in same]
            continue
        weight, members = _chain([(p, q, result[a[i][p], b[j][q]][0]) for p, q in same])
        result[i, j] = 1 + weight, [(a[i][same[k][0]], b[j][same[k][1]]) for k in members]
    out = [-1] * len(page)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        todo += result[i, j][1]
    return out


def pack_tree(nodes: list[tuple[str, int]]) -> str:
    return "\n".join(f"{up} {label}" for label, up in nodes)


def unpack_tree(text: str) -> list[tuple[str, int]]:
    pairs = (line.split(" ", 1) for line in text.split("\n"))
    return [(label, int(up)) for up, label in pairs]


def content(dom: Dom, owners: list[int], place: list[int], template: set[tuple[int, str]]) -> list[str]:
    """The blocks of the content slots in page order: those of article and main
    elements, if these hold a tenth of the text at least."""
    rows = [(node, block) for owner, (node, block) in zip(owners, dom.blocks) if (place[owner], block) not in template]
    inner = [block for node, block in rows if node.main]
    whole = sum(len(block) for _, block in rows)
    return inner if inner and 10 * sum(map(len, inner)) >= whole else [block for _, block in rows]


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))


_BLOCK = np.dtype([("node", "<i4"), ("hash", "<i8"), ("size", "<i4")])


def trees(pages: DataFrame) -> DataFrame:
    """One row for each page with a host: host, page (a hash of the markup),
    shape (a hash of the folded tree), tree (only where a task meets the shape
    first), blocks (folded node, hash and size of each text block, packed; size
    0: inside article or main), characters of all blocks."""
    rows = _hosted(pages).where((F.col("host") != "") & F.col("html").isNotNull()).select("host", "html")

    def run(batches):
        from xxhash import xxh64_intdigest

        seen: set[int] = set()
        for batch in batches:
            for part, htmls in text_slices(batch, "html", SLICE):
                out = []
                for host, html in zip(part.column(0).to_pylist(), htmls.to_pylist()):
                    dom = parse(html)
                    nodes, owners = fold(dom)
                    blocks: dict[tuple[int, int], int] = {}
                    for o, (node, b) in zip(owners, dom.blocks):
                        key = o, xxh64_intdigest(b) >> 1
                        blocks[key] = min(blocks.get(key, len(b)), 0 if node.main else len(b))
                    packed = np.array([(o, h, size) for (o, h), size in sorted(blocks.items())], dtype=_BLOCK).tobytes()
                    chars = sum(len(b) for _, b in dom.blocks)
                    dom.release()
                    tree = pack_tree(nodes)
                    shape = xxh64_intdigest(tree) >> 1
                    out.append((host, xxh64_intdigest(html) >> 1, shape, None if shape in seen else tree, packed, chars))
                    if len(seen) < SHAPES:
                        seen.add(shape)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names, kinds = ["host", "page", "shape", "tree", "blocks", "chars"], [
        pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
    return rows.mapInArrow(run, "host string, page bigint, shape bigint, tree string, blocks binary, chars bigint")


def induce(pages: DataFrame) -> DataFrame:
    """Wrapper of each host with enough different pages: host, seed tree, and
    its template as seed nodes and block hashes (arrays of one length)."""
    own = stored(trees(pages), "page-trees")
    shapes = stored(own.where("tree is not null").groupBy("shape").agg(F.min("tree").alias("tree")), "tree-shapes")
    # Different pages of a host; the seed is the one with the smallest hash.
    distinct = stored(own.groupBy("host", "page").agg(F.first("shape").alias("shape"), F.first("blocks").alias("blocks"),
                                                      F.first("chars").alias("chars")), "page-blocks")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("pages"), F.min(F.struct("page", "shape"))["shape"].alias("seed"),
                                         F.max("chars").alias("longest"))
    hosts = stored(hosts.where(F.col("pages") >= FEW_PAGES), "seeds")
    tree_of = lambda name: shapes.select(F.col("shape").alias(name), F.col("tree").alias(f"{name}_tree"))
    pairs = distinct.join(hosts, "host").select("shape", "seed").distinct().join(tree_of("shape"), "shape").join(tree_of("seed"), "seed")

    def match(batches):
        for batch in batches:
            for part, own in text_slices(batch, "shape_tree", SLICE):
                seeds = part.column(part.schema.get_field_index("seed_tree")).to_pylist()
                places = [align(unpack_tree(a), unpack_tree(b)) for a, b in zip(own.to_pylist(), seeds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in ("shape", "seed")] + [pa.array(places, pa.list_(pa.int32()))],
                    names=["shape", "seed", "place"])

    places = stored(pairs.mapInArrow(match, "shape bigint, seed bigint, place array<int>"), "tree-places")
    joined = distinct.join(hosts, "host").select("host", "shape", "seed", "blocks").join(places, ["shape", "seed"]).select(
        "host", "blocks", "place")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                hosts, found = [], []
                for host, blocks, place in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    own = np.frombuffer(blocks, dtype=_BLOCK).copy()
                    own["node"] = np.asarray(place.values)[own["node"]]
                    found.append(own[own["node"] >= 0])
                    hosts.append((host, len(found[-1])))
                rows = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, n in hosts for _ in range(n)], pa.string()),
                     *(pa.array(np.ascontiguousarray(rows[c])) for c in ("node", "hash", "size"))], names=["host", "node", "hash", "size"])

    seen = stored(joined.mapInArrow(run, "host string, node int, hash bigint, size int").groupBy("host", "node", "hash").agg(
        F.count("*").alias("count"), F.min("size").alias("size")), "host-blocks")
    fixed = seen.join(hosts.select("host", "pages", "longest"), "host").where(
        100 * F.col("count") >= TEMPLATE_PCT * F.col("pages"))
    fixed = stored(fixed, "fixed-blocks")
    many = F.col("pages") >= MIN_PAGES
    blocks = seen.groupBy("hash").agg(F.min("host").alias("a"), F.max("host").alias("b"))
    few = fixed.where(~many & (F.col("size") > 0)).join(blocks.where(F.col("a") != F.col("b")), "hash", "left_anti")
    fixed = fixed.where(many).unionByName(few)
    # Bounded: every block here is on nearly every page of its host.
    fixed = fixed.groupBy("host").agg(F.collect_list(F.struct("node", "hash")).alias("fixed"), F.sum("size").alias("size"),
                                      F.first("pages").alias("pages"), F.first("longest").alias("longest"))
    fixed = fixed.where(many | (2 * F.col("size") <= F.col("longest"))).select("host", "fixed")
    return hosts.join(fixed, "host").join(tree_of("seed"), "seed").select(
        "host", F.col("seed_tree").alias("seed"), F.col("fixed.node").alias("nodes"), F.col("fixed.hash").alias("hashes"))


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, url, text, n_chars, and the
    numbers of text blocks kept and of template blocks left out."""
    wrappers = stored(induce(pages), "wrappers")
    rows = _hosted(pages).join(wrappers, "host", "left").select("page_id", "url", "html", "seed", "nodes", "hashes")

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part, htmls in text_slices(batch, "html", SLICE):
                texts, kept, fixed = [], [], []
                for html, seed, nodes, hashes in zip(htmls.to_pylist(), *(c.to_pylist() for c in part.columns[3:])):
                    dom = parse(html)
                    template: set = set()
                    tree, owners = fold(dom)
                    place = [-1] * len(tree)
                    if seed is not None:
                        place = align(tree, unpack_tree(seed))
                        entries = set(zip(nodes, hashes))
                        template = {(place[o], b) for o, (_, b) in zip(owners, dom.blocks)
                                    if (place[o], xxh64_intdigest(b) >> 1) in entries}
                    blocks = content(dom, owners, place, template)
                    dom.release()
                    texts.append("\n\n".join(blocks))
                    kept.append(len(blocks))
                    fixed.append(len(template))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(kept, pa.int64()), pa.array(fixed, pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_template_blocks"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars bigint, n_blocks bigint, n_template_blocks bigint")
