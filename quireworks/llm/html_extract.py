"""Main text of HTML pages by wrapper induction.

1. Every page is parsed. Its containers (elements that hold blocks: div, section, article and so on) are its skeleton; each text lies in a container, at a label path below it.
2. A host's pivot is the skeleton that most of its distinct pages have. Every page's skeleton is aligned with it by simple tree matching: a matched container has the pivot's number as
   its address, any other the address of its parent and its own label. An address with a label path below it is a slot.
3. Slots are counted over all distinct pages of a host. A text is the host's template where it is constant: on most of the pages that have its slot at all, so that layouts of
   a host do not hide each other's template, and on pages of several articles, so that one article under many addresses is no template of itself. (Pages are of one article if their longest text is the same, of the texts
   that less than half of the host's pages have.) What varies is content. The host's containers are the addresses whose element holds most of the varying text, summed
   over the pages that have them. The wrapper is pivot, containers and template.
4. Each page is parsed whole. Subtrees that HTML itself marks as no article (navigation, forms, scripts and so on, by tag or role) go. Where the host has a wrapper, it
   decides: the core of the article is the deepest container that the aligned page has (of several the one with most text). Template texts inside it go, whatever the elements are called, but for
   subheadings that stand over content. To it come, up to an `article` element or the body, what stands beside the core in the elements around it without a container of its own (titles, leads), and siblings that are
   labelled like the core or the element that holds it (sections); blocks that are all links, and what words in class and id mark, stay out there. Only where
   there is no wrapper subtrees also go by words in class and id, and the article is the largest `article` or `main` element, or else the body.
   The rest is split into blocks: white space inside a block becomes one space, and blocks are joined by a line feed.

Scale: pages are parsed twice; in between a narrow table of numbers stands for them. Counts are group-bys on host and slot or text, with partial sums in each task, so a hot host is spread
like any other. A host's wrapper grows with its layouts: a text or container of `PAGES` pages counts, however large the host. Wrappers are a stored table, which Spark broadcasts
where it is below its threshold and joins by shuffle beyond it; such a join splits hot hosts by adaptive execution. Equal subtrees are matched at once, so an alignment's cost
grows with what differs; long lists of children that differ are aligned in linear space, by halves of one list and the best cut of the other.

Edge cases: a null or empty html gives an empty text; a null or malformed url is a host of its own kind; unclosed and stray tags, truncated pages and unknown references are
read as browsers do, as far as text goes; pages of any size and depth are parsed whole and counted.
Repeated rows are separate pages; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Distinct pages that a text or a container must be on at least; for a text, of as many articles.
PAGES = 3
#: Pairs of children that are aligned in one table, beyond which lists are divided.
PAIRS = 1 << 22
#: Share of the pages with a path on which a template text repeats; share of the varying text that the article's container holds.
TEMPLATE, CONTAINER = 0.8, 0.6
#: Containers are sought among blocks, except those that hold content of one kind.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol table tbody thead tfoot tr caption blockquote pre dl dt dd figure figcaption details summary address hgroup hr legend".split())

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset("td th br img option".split())
DROPPED = frozenset("head script style noscript template nav aside footer form button select option input textarea iframe object embed svg math canvas audio video dialog menu title noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
# Words in class and id that mark what is no article.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "legend", "dd", "dt", "li"}
# A start tag of the first closes an open element of the second, up to one of the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_MARKING = re.compile("class|id|role|style", re.I)  # "hidden" has "id" in it
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    __slots__ = ("children", "depth", "label", "names", "parent", "role", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.label, self.names, self.role = tag, frozenset(), ""
        if attributes and _MARKING.search(attributes):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            css = html.unescape(found.get("class", ""))
            if css or "id" in found:
                self.names = frozenset(x.lower() for x in _NAME.findall(f"{css} {html.unescape(found.get('id', ''))}"))
            self.role = found.get("role", "").lower()
            if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
                self.role = "hidden"
            if css.split():
                self.label = f"{tag}.{css.split()[0].lower()}"

    def elements(self) -> list[Node]:
        return [x for x in self.children if isinstance(x, Node)]


def parse(page: str) -> Node:
    """The element tree; children are elements and decoded texts."""
    root = top = Node("#root", None)
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            top.children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            found = top
            while found.parent and found.tag != tag and (tag in BLOCKS or found.tag not in BLOCKS):
                found = found.parent
            if found.parent and found.tag == tag:
                top = found.parent
            continue
        attributes = m[3] or m[6] or ""
        if tag in CLOSES_P:
            found = top
            while found.parent and found.tag not in BLOCKS and found.tag not in ("td", "th", "button"):
                found = found.parent
            if found.tag == "p":
                top = found.parent
        if tag in IMPLIED:
            closed, until = IMPLIED[tag]
            found, last = top, None
            while found.parent and found.tag not in until:
                if found.tag in closed:
                    last = found
                found = found.parent
            top = last.parent if last else top
        node = Node(tag, top, attributes)
        top.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(page[at : close.start()]))
            at = close.end()
        elif tag not in VOID and not attributes.endswith("/"):
            top = node
    return root


def walk(root: Node):
    """root and all nodes below it in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.children) if isinstance(x, Node)]


def is_dropped(node: Node, holders: set[int], words: bool) -> bool:
    """Whether a subtree is no article. holders: nodes that hold an article or main element, or are one. words: whether class and id count."""
    if node.tag in DROPPED or node.role == "hidden":
        return True
    if id(node) in holders or node.tag in ("html", "body"):
        return False
    if node.tag == "header":
        up = node.parent
        while up and up.tag not in ("article", "main"):
            up = up.parent
        return not (up and any(x.tag in ("h1", "h2", "h3") for x in walk(node)))
    return node.role in DROPPED_ROLES or words and not DROPPED_NAMES.isdisjoint(node.names)


def pruned(root: Node, words: bool = True) -> None:
    holders: set[int] = set()
    for node in walk(root):
        if node.tag in ("article", "main") and not is_dropped(node, {id(node)}, words):
            up = node
            while up and id(up) not in holders:
                holders.add(id(up))
                up = up.parent
    for node in walk(root):
        for x in node.elements():
            if is_dropped(x, holders, words):
                x.children = []  # an empty element: a block still ends the text before it


def runs(root: Node) -> list[tuple[Node, str]]:
    """The texts of root's blocks in page order, each with the block that it lies in."""
    out: list[tuple[Node, str]] = []
    buffer: list[str] = []
    holder = root

    def flush():
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append((holder, text))

    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            buffer.append(x)
        elif isinstance(x, tuple):  # the end of a block: back to the one around it
            flush()
            holder = x[0]
        else:
            inside = list(reversed(x.children))
            if x.tag in BLOCKS:
                flush()
                stack.append((holder,))
                holder = x
            elif x.tag in CELLS:
                buffer.append(" ")
                stack.append(" ")
            stack += inside
    flush()
    return out


def blocks(root: Node) -> list[str]:
    """The texts of root's blocks in page order."""
    return [text for _, text in runs(root)]


# --- simple tree matching ---------------------------------------------------------------------------------------


class Shape:
    """A tree of labels, nodes numbered in page order: label, parent and children of each, and the end of its subtree."""

    def __init__(self, labels: list[str], parents: list[int]):
        self.labels, self.parents = labels, parents
        self.children: list[list[int]] = [[] for _ in labels]
        self.ends = list(range(1, len(labels) + 1))
        for i in range(len(labels) - 1, 0, -1):
            up = parents[i]
            self.children[up].append(i)
            self.ends[up] = max(self.ends[up], self.ends[i])
        for x in self.children:
            x.reverse()

    def kinds(self, known: dict) -> list[int]:
        """A number for each node: equal subtrees have equal ones."""
        out = [0] * len(self.labels)
        for i in range(len(self.labels) - 1, -1, -1):
            out[i] = known.setdefault((self.labels[i], *(out[c] for c in self.children[i])), len(known))
        return out


def align(a: Shape, b: Shape) -> list[int]:
    """Simple tree matching of two shapes: for each node of a, the node of b that it is matched with, or -1. Matched nodes have equal labels and matched parents,
    keep their order, and are as many as can be."""
    known: dict = {}
    of_a, of_b = a.kinds(known), b.kinds(known)
    inside = [key[1:] for key in known]
    labels = [key[0] for key in known]
    sizes: list[int] = []
    for x in inside:
        sizes.append(1 + sum(sizes[c] for c in x))
    weights: dict[tuple[int, int], int] = {}

    def weight(x: int, y: int) -> int:
        return sizes[x] if x == y else weights[x, y] if labels[x] == labels[y] else 0

    def weigh(x: int, y: int) -> None:
        stack = [(x, y)]
        while stack:
            x, y = stack[-1]
            if x == y or (x, y) in weights or labels[x] != labels[y]:
                stack.pop()
                continue
            head, tail = _ends(inside[x], inside[y])
            xs, ys = inside[x][head : len(inside[x]) - tail], inside[y][head : len(inside[y]) - tail]
            missing = [(p, q) for p in set(xs) for q in set(ys) if p != q and labels[p] == labels[q] and (p, q) not in weights]
            if missing:
                stack += missing
                continue
            same = sum(sizes[c] for c in (*inside[x][:head], *inside[x][len(inside[x]) - tail :]))
            weights[x, y] = 1 + same + sum(weight(xs[i], ys[j]) for i, j in _chosen(xs, ys, weight))
            stack.pop()

    out = [-1] * len(of_a)
    stack = [(0, 0)] if a.labels[0] == b.labels[0] else []
    while stack:
        i, j = stack.pop()
        if of_a[i] == of_b[j]:  # equal subtrees
            out[i : a.ends[i]] = range(j, b.ends[j])
            continue
        out[i] = j
        xs, ys = [of_a[c] for c in a.children[i]], [of_b[c] for c in b.children[j]]
        head, tail = _ends(xs, ys)
        for k in range(head):
            stack.append((a.children[i][k], b.children[j][k]))
        for k in range(1, tail + 1):
            stack.append((a.children[i][-k], b.children[j][-k]))
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        for p in set(xs):
            for q in set(ys):
                weigh(p, q)
        stack += [(a.children[i][head + k], b.children[j][head + m]) for k, m in _chosen(xs, ys, weight)]
    return out


def _ends(xs, ys) -> tuple[int, int]:
    """How many elements two lists share at their beginning, and at their end beyond that: some best matching has these in pairs."""
    most, head, tail = min(len(xs), len(ys)), 0, 0
    while head < most and xs[head] == ys[head]:
        head += 1
    while tail < most - head and xs[-1 - tail] == ys[-1 - tail]:
        tail += 1
    return head, tail


def _chosen(xs, ys, weight) -> list[tuple[int, int]]:
    """The places of the pairs of the matching of two lists in order that weighs most."""
    if not xs or not ys:
        return []
    kinds, at = np.unique(np.array(ys), return_inverse=True)
    rows: dict[int, np.ndarray] = {}

    def row_of(x) -> np.ndarray:
        if x not in rows:
            rows[x] = np.array([weight(x, y) for y in kinds.tolist()], np.int32)[at]
        return rows[x]

    if len(xs) > 1 and len(xs) * len(ys) > PAIRS:

        def last(some, turned: bool) -> np.ndarray:
            """The weight of the best matching of some of xs with each beginning (turned: end) of ys."""
            best = np.zeros(len(ys) + 1, np.int32)
            for x in some:
                row = row_of(x)[::-1] if turned else row_of(x)
                best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row))
            return best[::-1] if turned else best

        i = len(xs) // 2
        j = int(np.argmax(last(xs[:i], False) + last(reversed(xs[i:]), True)))
        return _chosen(xs[:i], ys[:j], weight) + [(i + p, j + q) for p, q in _chosen(xs[i:], ys[j:], weight)]
    best = np.zeros((len(xs) + 1, len(ys) + 1), np.int32)
    for i, x in enumerate(xs, 1):
        best[i, 1:] = np.maximum.accumulate(np.maximum(best[i - 1, 1:], best[i - 1, :-1] + row_of(x)))
    out, i, j = [], len(xs), len(ys)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The pairs of elements of two trees by simple tree matching."""
    sides = []
    for root in (a, b):
        nodes = list(walk(root))
        number = {x: i for i, x in enumerate(nodes)}
        sides.append((nodes, Shape([x.label for x in nodes], [number.get(x.parent, 0) for x in nodes])))
    (of_a, x), (of_b, y) = sides
    return [(of_a[i], of_b[j]) for i, j in enumerate(align(x, y)) if j >= 0]


# --- wrapper induction ------------------------------------------------------------------------------------------


def key_of(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts))) >> 1


class Page:
    """A parsed page: its containers in page order (the root first), their shape, and its texts, each with its container's number and the hash of the label path below it."""

    def __init__(self, page: str, words: bool = False):
        self.tree = parse(page)
        pruned(self.tree, words)
        self.containers, parents = [self.tree], [0]
        at: dict[Node, int] = {self.tree: 0}
        below: dict[Node, int] = {self.tree: 0}
        for node in walk(self.tree):
            if node is self.tree:
                continue
            up = at[node.parent]
            if node.tag in BLOCKS and node.tag not in CONTENT:
                at[node], below[node] = len(self.containers), 0
                self.containers.append(node)
                parents.append(up)
            else:
                at[node], below[node] = up, key_of(below[node.parent], node.label)
        self.shape = Shape([x.label for x in self.containers], parents)
        self.runs = [(node, at[node], below[node], text) for node, text in runs(self.tree)]

    def skeleton(self) -> str:
        return "\n".join(f"{up} {label}" for up, label in zip(self.shape.parents, self.shape.labels, strict=True))


def shape_of(skeleton: str) -> Shape:
    rows = [x.split(" ", 1) for x in skeleton.split("\n")]
    return Shape([label for _, label in rows], [int(up) for up, _ in rows])


def addresses(shape: Shape, pivot: Shape) -> list[int]:
    """For each container the number of the pivot's that it is matched with, or a hash of its parent's address and its label."""
    out: list[int] = []
    for i, found in enumerate(align(shape, pivot)):
        out.append(found if found >= 0 else key_of(out[shape.parents[i]], shape.labels[i]))
    return out


def keys_of(page: Page, address: list[int]) -> list[tuple[int, int]]:
    """For each text of a page the hash of its slot, and of slot and text."""
    slots = [key_of(address[at], below) for _, at, below, _ in page.runs]
    return [(slot, key_of(slot, key_of(text))) for slot, (*_, text) in zip(slots, page.runs, strict=True)]


def varying(shape: Shape, address: list[int], at: list[int], sizes: list[int], constant: list[bool]) -> dict[int, tuple[int, int]]:
    """For each address of a page but the root's: the varying text in its fullest element, and the page's varying text. Articles hold no containers of their own."""
    under = [0] * len(address)
    for i, n, fixed in zip(at, sizes, constant, strict=True):
        under[i] += 0 if fixed else n
    for i in range(len(address) - 1, 0, -1):
        under[shape.parents[i]] += under[i]
    out: dict[int, tuple[int, int]] = {}
    sought = [True] * len(address)
    for i in range(1, len(address)):
        up = shape.parents[i]
        sought[i] = sought[up] and shape.labels[up].split(".")[0] != "article"
        if sought[i]:
            out[address[i]] = (max(out.get(address[i], (0, 0))[0], under[i]), under[0])
    return out


def article_of(texts: list[int], sizes: list[int], common: set[int]) -> int:
    """What tells a page's article from others: its longest text that is not common on the host, or the first of several; 0 without one."""
    found = max(((n, -i, text) for i, (text, n) in enumerate(zip(texts, sizes, strict=True)) if text not in common), default=(0, 0, 0))
    return found[2]


def is_template(n: int, on_slot: int, low: int, high: int) -> bool:
    """low, high: two bitmaps of the articles' hashes, so that several articles leave several bits in one of them."""
    return n >= PAGES and n >= TEMPLATE * on_slot and max(low.bit_count(), high.bit_count()) >= PAGES


def is_container(under: int, total: int, n: int) -> bool:
    return n >= PAGES and under >= CONTAINER * total > 0


class Wrapper:
    def __init__(self, pivot: str, containers: list[int], template: list[int]):
        self.pivot, self.containers, self.template = shape_of(pivot), frozenset(containers), frozenset(template)


def content_of(page: Page) -> int:
    return key_of(*(text for *_, text in page.runs))


def induce(pages: list[str]) -> Wrapper | None:
    """The wrapper of all pages of a host held in memory, by the rules that main_texts applies by group-bys. None if fewer than PAGES differ."""
    distinct = {content_of(x): x for x in reversed([Page(page) for page in pages])}
    if len(distinct) < PAGES:
        return None
    common = Counter(x.skeleton() for x in distinct.values())
    pivot = min(common, key=lambda x: (-common[x], x.encode()))
    held = Counter()
    for page in distinct.values():
        held.update({key_of(text) for *_, text in page.runs})
    common = {text for text, n in held.items() if n >= PAGES and 2 * n > len(distinct)}
    slots, texts, low, high, sums = Counter(), Counter(), defaultdict(int), defaultdict(int), defaultdict(lambda: [0, 0, 0])
    found = []
    for page in distinct.values():
        address = addresses(page.shape, shape_of(pivot))
        keys = keys_of(page, address)
        slots.update({slot for slot, _ in keys})
        texts.update(set(keys))
        article = article_of([key_of(x[3]) for x in page.runs], [len(x[3]) for x in page.runs], common)
        for key in set(keys):
            low[key] |= 1 << article % 64
            high[key] |= 1 << article // 64 % 64
        found.append((page, address, keys))
    template = [key[1] for key, n in texts.items() if is_template(n, slots[key[0]], low[key], high[key])]
    for page, address, keys in found:
        fixed = [key in template for _, key in keys]
        for where, (under, total) in varying(page.shape, address, [x[1] for x in page.runs], [len(x[3]) for x in page.runs], fixed).items():
            sums[where] = [x + y for x, y in zip(sums[where], (under, total, 1), strict=True)]
    return Wrapper(pivot, [where for where, (under, total, n) in sums.items() if is_container(under, total, n)], template)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def all_links(node: Node) -> bool:
    """Whether all text below an element is that of links."""
    stack, some = [node], False
    while stack:
        for x in stack.pop().children:
            if isinstance(x, Node):
                if x.tag != "a":
                    stack.append(x)
                else:
                    some = True
            elif x.strip():
                return False
    return some


def _marked(node: Node, top: Node) -> bool:
    """Whether a word in class or id of the element, or of one around it below top, marks what is no article."""
    while node is not top:
        if not DROPPED_NAMES.isdisjoint(node.names):
            return True
        node = node.parent
    return False


def article_runs(page: Page, core: int, is_fixed: list[bool]) -> list[str]:
    """The texts of the article whose core is a container of the page."""
    shape, last = page.shape, page.shape.ends[core]
    inside = [i for i, (_, at, _, _) in enumerate(page.runs) if core <= at < last]
    taken = {i for i in inside if not is_fixed[i]}
    heads = False  # whether what follows is content that the heading stands over
    for i in reversed(inside):
        node = page.runs[i][0]
        if node.tag not in HEADINGS:
            heads = not is_fixed[i] and not all_links(node)
        elif is_fixed[i] and heads:
            taken.add(i)
    child = core
    while child and not any(page.containers[child].tag == tag for tag in ("article", "main", "body")):
        up = shape.parents[child]
        top = page.containers[up]
        like = {i for i in shape.children[up] if i != child and shape.labels[i] in (shape.labels[child], shape.labels[core])}
        for i, (node, at, _, _) in enumerate(page.runs):
            if is_fixed[i] or not up <= at < shape.ends[up] or child <= at < shape.ends[child]:
                continue
            if at == up:
                # Beside a body's elements stand notes of all kinds: only what leads to the core is its title or lead.
                own = node.tag != "body" and node.tag != "#root" if top.tag not in ("body", "html", "#root") else node.tag in HEADINGS | {"p"} and i < min(taken, default=0)
            else:
                own = any(x <= at < shape.ends[x] for x in like)
            if own and not all_links(node) and not _marked(node, top):
                taken.add(i)
        child = up
    return [page.runs[i][3] for i in sorted(taken)]


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of one page: by the host's wrapper where there is one, by marked elements and listed words otherwise."""
    if not page:
        return ""
    if wrapper:
        parsed = Page(page)
        address = addresses(parsed.shape, wrapper.pivot)
        found = [i for i, x in enumerate(address) if i and x in wrapper.containers]
        if found:
            deepest = max(parsed.containers[i].depth for i in found)
            is_fixed = [key in wrapper.template for _, key in keys_of(parsed, address)]
            size = {i: sum(len(text) for (_, at, _, text), fixed in zip(parsed.runs, is_fixed, strict=True) if not fixed and i <= at < parsed.shape.ends[i]) for i in found if parsed.containers[i].depth == deepest}
            return "\n".join(article_runs(parsed, max(size, key=size.get), is_fixed))
    tree = parse(page)
    pruned(tree)
    marked = [x for x in walk(tree) if x.tag in ("article", "main") and not any(y.tag == "article" for y in _above(x))]
    marked = [x for x in marked if x.tag == "article"] or marked
    if marked:
        best = max((blocks(x) for x in marked), key=lambda found: sum(map(len, found)))
        if best:
            return "\n".join(best)
    return "\n".join(blocks(tree))


def _above(node: Node):
    while node := node.parent:
        yield node


# --- Spark ------------------------------------------------------------------------------------------------------


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pivot, containers (addresses), template (hashes) for each host of which PAGES pages differ at least; all pages count, equal ones once."""

    def read(batches):
        for batch in batches:
            found = [Page(x.as_py()) for x in batch.column(1)]
            runs_ = lambda f, kind: pa.array([[f(*x) for x in p.runs] for p in found], kind)
            yield _batch(
                host=batch.column(0), content=pa.array([content_of(x) for x in found], pa.int64()), skeleton=pa.array([x.skeleton() for x in found], pa.string()),
                at=runs_(lambda _, at, below, text: at, _INTS), below=runs_(lambda _, at, below, text: below, _LONGS), texts=runs_(lambda _, at, below, text: key_of(text), _LONGS), sizes=runs_(lambda _, at, below, text: len(text), _INTS),
            )

    rows = _hosted(pages).where("html IS NOT NULL").select("host", "html").mapInArrow(read, "host string, content long, skeleton string, at array<int>, below array<bigint>, texts array<bigint>, sizes array<int>")
    each = rows.groupBy("host", "content").agg(F.first(F.struct("skeleton", "at", "below", "texts", "sizes")).alias("x"))
    each = stored(each.select("host", "x.*"), "page-runs")
    sizes = each.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= PAGES)
    common = each.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("n"))
    pivots = common.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("less"), "skeleton")).alias("x")).join(sizes, "host").select("host", "pages", F.col("x.skeleton").alias("pivot"))
    # Texts of more than half of a host's pages: no more than two pages' worth.
    held = each.select("host", F.explode(F.array_distinct("texts")).alias("text")).groupBy("host", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES)
    held = held.join(sizes, "host").where(2 * F.col("n") > F.col("pages")).groupBy("host").agg(F.collect_list("text").alias("common"))
    pivots = stored(pivots.join(held, "host", "left").select("host", "pages", "pivot", F.coalesce("common", F.array().cast("array<bigint>")).alias("common")), "page-pivots")

    def slots(batches):
        known: dict[str, Shape] = {}
        common: dict[str, set[int]] = {}
        for batch in batches:
            out, articles = [], []
            for host, pivot, skeleton, at, below, texts, n, many in zip(*(batch.column(i).to_pylist() for i in range(7)), batch.column(7), strict=True):
                if host not in common:
                    if len(common) > 10_000:
                        common.clear()
                    common[host] = set(many.as_py())
                articles.append(article_of(texts, n, common[host]))
                if pivot not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[pivot] = shape_of(pivot)
                address = addresses(shape_of(skeleton), known[pivot])
                of = [key_of(address[i], x) for i, x in zip(at, below, strict=True)]
                out.append((address, of, [key_of(x, y) for x, y in zip(of, texts, strict=True)]))
            column = lambda i: pa.array([x[i] for x in out], _LONGS)
            yield _batch(host=batch.column(0), skeleton=batch.column(2), at=batch.column(3), sizes=batch.column(6), address=column(0), slots=column(1), texts=column(2), article=pa.array(articles, pa.int64()))

    aligned = each.join(pivots, "host").select("host", "pivot", "skeleton", "at", "below", "texts", "sizes", "common")
    aligned = stored(aligned.mapInArrow(slots, "host string, skeleton string, at array<int>, sizes array<int>, address array<bigint>, slots array<bigint>, texts array<bigint>, article bigint"), "page-slots")
    on = aligned.select("host", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("host", "slot").agg(F.count(F.lit(1)).alias("on_slot"))
    texts = aligned.select("host", "article", F.explode(F.array_distinct(F.arrays_zip("slots", "texts"))).alias("x")).groupBy("host", F.col("x.slots").alias("slot"), F.col("x.texts").alias("text"))
    bit = lambda at: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")))
    texts = texts.agg(F.count(F.lit(1)).alias("n"), bit(F.col("article")).alias("low"), bit(F.shiftright("article", 6)).alias("high"))
    texts = texts.where((F.col("n") >= PAGES) & (F.greatest(F.bit_count("low"), F.bit_count("high")) >= PAGES))
    kept = texts.join(on, ["host", "slot"]).where(F.col("n") >= F.col("on_slot") * TEMPLATE)
    template = pivots.join(kept.groupBy("host").agg(F.collect_set("text").alias("template")), "host", "left")
    template = stored(template.select("host", "pages", "pivot", F.coalesce("template", F.array().cast("array<bigint>")).alias("template")), "page-template")

    def weigh(batches):
        known: dict[str, frozenset[int]] = {}
        for batch in batches:
            hosts, out = batch.column(0).to_pylist(), {}
            for host, template_, skeleton, at, n, address, found in zip(hosts, batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6)), strict=True):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = frozenset(template_.as_py())
                for where, (under, total) in varying(shape_of(skeleton), address, at, n, [x in known[host] for x in found]).items():
                    x = out.setdefault((host, where), [0, 0, 0])
                    x[0], x[1], x[2] = x[0] + under, x[1] + total, x[2] + 1
            count = lambda i: pa.array([x[i] for x in out.values()], pa.int64())
            yield _batch(host=pa.array([h for h, _ in out], pa.string()), address=pa.array([w for _, w in out], pa.int64()), under=count(0), total=count(1), n=count(2))

    voted = aligned.join(template.select("host", "template"), "host").select("host", "template", "skeleton", "at", "sizes", "address", "texts")
    voted = voted.mapInArrow(weigh, "host string, address long, under long, total long, n long")
    voted = voted.groupBy("host", "address").agg(*(F.sum(c).alias(c) for c in ("under", "total", "n")))
    held = voted.where((F.col("n") >= PAGES) & (F.col("total") > 0) & (F.col("under") >= F.col("total") * CONTAINER)).groupBy("host").agg(F.collect_set("address").alias("containers"))
    found = template.join(held, "host", "left").select("host", "pivot", F.coalesce("containers", F.array().cast("array<bigint>")).alias("containers"), "template")
    return stored(found, "page-wrappers")


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    wrapped = wrappers(pages).withColumnRenamed("host", "of")
    rows = _hosted(pages).join(wrapped, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "host", "pivot", "containers", "template")
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        known: dict[str, Wrapper | None] = {}
        for batch in batches:
            texts = []
            for page, host, pivot, containers, template in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5), batch.column(6), strict=True):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = Wrapper(pivot.as_py(), containers.as_py(), template.as_py()) if pivot.is_valid else None
                texts.append(extract(page.as_py(), known[host]))
            sizes = np.array([len(t) for t in texts], np.int64)
            yield _batch(page_id=batch.column(0), url=batch.column(1), text=pa.array(texts, pa.string()), n_chars=pa.array(sizes))

    return rows.mapInArrow(run, schema)
