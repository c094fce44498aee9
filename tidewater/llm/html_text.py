"""Main text of web pages from flat text blocks.

A page is read in one pass, with no step back, and cut at block elements into a flat list of text
blocks. A block is told by its number of words and its link density, by those of the blocks before
and after it, and by soft signs: what kind of element and what class names stand around it, whether
the page has an article and the block is in it, and whether it comes before the page's headline. A
decision tree, trained here on a small table of labelled pages, keeps or drops it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches

#: Elements whose content is raw text up to their end tag; elements that show no text of their own.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SILENT = frozenset("noscript template object svg math canvas select head audio video".split())
#: Elements that end a block, and those that have no end tag.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in a head, so does not end an open one.
IN_HEAD = frozenset("script style noscript template title base basefont bgsound link meta head html".split())
#: Which open elements a start tag ends, as their end tags may be left out; every other block ends a paragraph.
ENDS = {"li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p"), "option": ("option",)}
#: Elements that seldom hold main text; a form or header only where it wraps none.
ASIDE = frozenset("nav aside footer menu dialog button".split())
WRAPS = frozenset("form fieldset header".split())
#: Last or first words of class names, ids and roles of boilerplate; words that may follow a first one; words that turn a name into a layout's.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner bio breadcrumb breadcrumbs comment comments commentlist consent contentinfo complementary cookie cookies copyright discussion disqus feedback footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices opinions pagination popup promo promotion reactions recommended related replies reply respond responses reviews search share sharebar sharing sidebar signup social sponsor sponsored subscribe subscription teaser teasers testimonials thoughts toolbar widget widgets".split()
)
TAILS = frozenset(
    "area articles bar block body bottom box button buttons container content form group holder icons inner item items left link links list main menu message news outer panel post posts primary right row secondary section slot stories text thread title top unit wrap wrapper".split()
)
LAYOUT = frozenset("with has no non without free and content page layout".split())

#: Elements that an entry of a thread may be.
ENTRY = frozenset("div li article section blockquote dd".split())
#: Most words of what an entry of a thread begins with, a name or a time.
LABEL_WORDS = 6

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r""">|=\s*(["'])""")
_EITHER = re.compile(r"[<>]")
_RESUME = re.compile(r"</head|<(?:body|main|article)[\s/>]", re.I)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[\s\x00]+")


def _hint_name(name: str) -> bool:
    """Whether one class, id or role names boilerplate: "comments", "cookie-notice", "sidebar-inner", but not "with-sidebar"."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    if not parts:
        return False
    if parts[-1] in HINTS:
        return not LAYOUT.intersection(parts[:-1]) or parts[:-1] == ["page"]
    return parts[0] in HINTS and all(x in TAILS or x in HINTS for x in parts[1:])


def _hinted(attributes: str) -> bool:
    return "=" in attributes and any(_hint_name(x) for m in _NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split())


class _Reader:
    """Tags and texts of a page in one pass; what is looked for in vain once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.at, self.missing, self.broken = page, 0, set(), False

    def find(self, what: str, start: int) -> int:
        if what in self.missing:
            return -1
        i = self.page.find(what, start)
        if i < 0:
            self.missing.add(what)
        return i

    def search(self, what: re.Pattern, start: int):
        if what in self.missing:
            return None
        m = what.search(self.page, start)
        if m is None:
            self.missing.add(what)
        return m

    def past(self, what: str, start: int) -> int:
        i = self.find(what, start)
        return len(self.page) if i < 0 else i + len(what)

    def tag_end(self, start: int) -> tuple[int, int]:
        """(end of the attributes, where the page goes on) of a tag; without an end it ends at the next "<"."""
        at = start
        while not self.broken and self.find(">", at) >= 0:
            m = _STOP.search(self.page, at)
            if m is None:
                self.broken = True  # quotes hide all ends; from here on they are plain characters
            elif m[1] is None:
                return m.start(), m.end()
            else:
                close = self.find(m[1], m.end())
                at = m.end() if close < 0 else close + 1
        m = self.search(_EITHER, start)
        if m is None:
            return len(self.page), len(self.page)
        return m.start(), m.end() if m[0] == ">" else m.start()

    def events(self):
        """(kind, name or text, attributes); kinds: text, open, close."""
        page = self.page
        while self.at < len(page):
            lt = self.find("<", self.at)
            if lt != self.at:
                yield "text", page[self.at : lt if lt >= 0 else len(page)], ""
                if lt < 0:
                    return
            c = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                self.at = self.past("-->", lt + 2)
            elif c in ("!", "?"):
                self.at = self.past(">", lt + 2)
            elif c == "/":
                m = _NAME.match(page, lt + 2)
                if m:
                    self.at = self.tag_end(m.end())[1]
                    yield "close", m[0].lower(), ""
                else:
                    self.at = self.past(">", lt + 2)
            elif m := _NAME.match(page, lt + 1):
                name = m[0].lower()
                to, self.at = self.tag_end(m.end())
                attributes = page[m.end() : to]
                if name in RAW and not attributes.endswith("/"):
                    self.skip_raw(name)
                else:
                    yield "open", name, attributes
            else:
                self.at = lt + 1
                yield "text", "<", ""

    def skip_raw(self, name: str) -> None:
        """Go behind the end tag. A script or style without one ends where a body begins, other elements at once."""
        m = self.search(_end_of(name), self.at)
        if m:
            self.at = self.tag_end(m.end())[1]
        elif name in ("script", "style"):
            m = self.search(_RESUME, self.at)
            self.at = m.start() if m else len(self.page)


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


@dataclass
class Block:
    """A text block: its words, those in links, its element and whether it is a heading."""

    text: str
    words: int
    links: int
    element: int
    heading: str


@dataclass
class Elements:
    """The block elements of a page in the order of their start tags; element 0 is the page itself."""

    name: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    hinted: list[bool] = field(default_factory=lambda: [False])
    is_main: list[bool] = field(default_factory=lambda: [False])
    headline: list[bool] = field(default_factory=lambda: [False])  # an h1 stands in it

    def add(self, name: str, parent: int, attributes: str) -> int:
        self.name.append(name)
        self.parent.append(parent)
        self.hinted.append(name not in ("body", "html") and _hinted(attributes))
        self.is_main.append(name == "main" or "role=" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes) is not None)
        self.headline.append(False)
        at = len(self.name) - 1
        if name == "h1":
            while not self.headline[at]:  # no element is marked twice
                self.headline[at] = True
                at = self.parent[at]
        return len(self.name) - 1


def parse(page: str) -> tuple[list[Block], Elements]:
    """The text blocks of a page in order, and its elements."""
    elements, out, parts = Elements(), [], []
    stack: list[tuple[str, int]] = []  # open elements: name, number
    count: Counter = Counter()
    links, link_depth, silent = 0, -1, 0
    reader = _Reader(page)

    def end_block() -> None:
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        parts.clear()
        if text:
            name, element = stack[-1] if stack else ("", 0)
            out.append(Block(text, text.count(" ") + 1, links, element, name if name in HEADINGS else ""))
        links = 0

    def pop() -> str:
        nonlocal silent, link_depth
        name, _ = stack.pop()
        count[name] -= 1
        silent -= name in SILENT
        if link_depth > len(stack):
            link_depth = -1
        return name

    for kind, name, attributes in reader.events():
        if kind == "text":
            if not silent:
                parts.append(name)
                if link_depth >= 0:
                    links += len(name.split())
        elif kind == "open":
            if count["head"] and name not in IN_HEAD and (stack[-1][0] == "head" or name == "body"):
                while pop() != "head":
                    pass
            if name == "a":
                link_depth = len(stack)
            elif name == "br":
                parts.append(" ")
            elif name in BLOCK or name in SILENT:
                if name in BLOCK:
                    end_block()
                    ends = ENDS.get(name, ("p",))
                    while stack and stack[-1][0] in ends:
                        pop()
                if name not in VOID and not (name in SILENT and attributes.endswith("/")):
                    stack.append((name, elements.add(name, stack[-1][1] if stack else 0, attributes)))
                    count[name] += 1
                    silent += name in SILENT
        elif name == "a":
            link_depth = -1
        elif name in BLOCK or name in SILENT:
            if name in BLOCK:
                end_block()
            if count[name]:
                while pop() != name:
                    pass
    end_block()
    return out, elements


def _threads(found: list[Block], e: Elements, unlinked: list[int], off: list[bool]) -> list[bool]:
    """Elements that have the form of comments, whatever their names: most children with text are entries, at least two.

    An entry begins with a short text, a name or a time, and goes on with a longer one; no headings stand in it. Before
    a thread stand more words than in it, so a page whose text is a list of such entries keeps it.
    """
    size, n = len(e.name), len(found)
    first, count, heads = [n] * size, [0] * size, [False] * size
    before = [0] * (n + 1)  # plain words before a block
    for at, b in enumerate(found):
        first[b.element] = min(first[b.element], at)
        count[b.element] += 1
        heads[b.element] |= b.heading != ""
        before[at + 1] = before[at] + (0 if off[b.element] else b.words - min(b.words, b.links))
    for i in range(size - 1, 0, -1):
        up = e.parent[i]
        first[up], count[up], heads[up] = min(first[up], first[i]), count[up] + count[i], heads[up] or heads[i]
    entries, others = [0] * size, [0] * size
    for i in range(1, size):
        if count[i]:
            label = found[first[i]]
            entry = e.name[i] in ENTRY and count[i] > 1 and not heads[i] and label.words <= LABEL_WORDS and found[first[i] + 1].words > label.words
            entries[e.parent[i]] += entry
            others[e.parent[i]] += not entry and e.name[i] not in HEADINGS and e.name[i] != "form"
    return [0 < i and entries[i] > max(1, others[i]) and not e.headline[i] and before[first[i]] > unlinked[i] for i in range(size)]


def _wrapped(found: list[Block], e: Elements, cards: set[int]) -> set[int]:
    """Cards and the elements around them that have no other text but headings."""
    other, holds = [0] * len(e.name), [i in cards for i in range(len(e.name))]
    for b in found:
        other[b.element] += not b.heading
    for i in range(len(e.name) - 1, 0, -1):
        other[e.parent[i]] += 0 if i in cards else other[i]
        holds[e.parent[i]] |= holds[i]
    return cards | {i for i in range(1, len(e.name)) if holds[i] and not other[i] and not e.headline[i]}


def _scope(found: list[Block], e: Elements, unlinked: list[int], off: list[bool]) -> tuple[set[int], set[int]]:
    """Elements that hold the page's article (outermost articles clear of boilerplate, else those with a headline, else main elements), and
    articles that are cards of other articles.

    Articles are cards if more plain words than in the largest of them stand together outside of all, in the blocks around one element,
    and either there are several, none with the page's headline, or the headline stands with those words. Otherwise articles
    and main elements count with a tenth of the words outside boilerplate.
    """
    inside = [False] * len(e.name)  # in an article
    within = [False] * len(e.name)  # is one or in one
    for i in range(1, len(e.name)):
        inside[i] = inside[e.parent[i]] or e.name[e.parent[i]] == "article"
        within[i] = inside[i] or e.name[i] == "article"
    articles = [i for i, n in enumerate(e.name) if n == "article" and not inside[i] and not e.hinted[i]]
    plain = sum(b.words - min(b.words, b.links) for b in found if not off[b.element])
    region: Counter = Counter()
    for b in found:
        if not off[b.element] and not within[b.element]:
            region[e.parent[b.element]] += b.words - min(b.words, b.links)
    cards: set[int] = set()
    if articles and region:
        at, words = max(region.items(), key=lambda x: (x[1], -x[0]))
        headed = [i for i in articles if e.headline[i]]
        if words > max(unlinked[i] for i in articles) and not headed and (len(articles) > 1 or e.headline[at] and at):
            cards = _wrapped(found, e, set(articles))
    clear = [i for i in articles if not off[i] and i not in cards]
    for some in (clear, [i for i in articles if e.headline[i]], [i for i, m in enumerate(e.is_main) if m]):
        if some and 10 * sum(unlinked[i] for i in some) >= plain and sum(unlinked[i] for i in some):
            return set(some), cards
    return set(), cards


def features(found: list[Block], e: Elements) -> np.ndarray:
    """A row for each block: words and link density of the block, its two predecessors and its two successors; in an
    aside or a card; named or formed as boilerplate; in the page's article (1), outside it (-1) or no article found (0); before
    the headline; heading."""
    n, size = len(found), len(e.name)
    unlinked = [0] * size
    for b in found:
        unlinked[b.element] += b.words - min(b.words, b.links)
    for i in range(size - 1, 0, -1):
        unlinked[e.parent[i]] += unlinked[i]
    holds = [False] * size  # an article or main stands in it
    for i in range(size - 1, 0, -1):
        holds[e.parent[i]] |= holds[i] or e.is_main[i] or e.name[i] == "article"

    def hint(i: int) -> bool:
        return e.hinted[i] and not e.is_main[i] and not e.headline[i]

    def aside(i: int, inside: bool) -> bool:
        if e.name[i] in WRAPS:
            return not (holds[i] or (e.name[i] == "header" and inside) or (e.name[i] != "header" and (e.headline[i] or 2 * unlinked[i] > unlinked[0])))
        return e.name[i] in ASIDE

    off = [False] * size
    for i in range(1, size):
        off[i] = off[e.parent[i]] or hint(i) or aside(i, True)
    thread = _threads(found, e, unlinked, off)
    for i in range(1, size):
        off[i] = off[i] or off[e.parent[i]] or thread[i]
    scope, cards = _scope(found, e, unlinked, off)
    flags = [(False, False, False)] * size
    for i in range(1, size):
        a, h, s = flags[e.parent[i]]
        flags[i] = (False, False, True) if i in scope else (a or i in cards or aside(i, s), h or thread[i] or hint(i), s)
    own = np.array([[b.words, min(1.0, b.links / b.words)] for b in found], float).reshape(n, 2)
    around = np.zeros((n + 4, 2))
    around[2:-2] = own
    signs = np.array([flags[b.element] for b in found], float).reshape(n, 3)
    first = next((i for i, b in enumerate(found) if b.heading == "h1" and not signs[i, 0]), 0)
    if scope:
        signs[:, 2] = 2 * signs[:, 2] - 1
    rest = np.array([[i < first, b.heading != ""] for i, b in enumerate(found)], float).reshape(n, 2)
    return np.concatenate([own, around[1:-3], around[3:-1], around[:-4], around[4:], signs, rest], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 5):
    """A decision tree with at least ``least`` rows a leaf by Gini impurity: a share of positives, or (feature, threshold, tree at or below, tree above)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            a, b = y[low], y[~low]
            if min(len(a), len(b)) >= least:
                impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(t), low)
    if best is None:
        return share
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, x: np.ndarray) -> np.ndarray:
    """Shares of positives for the rows of ``x``."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    out, below = np.empty(len(x)), x[:, f] <= t
    out[below], out[~below] = decide(low, x[below]), decide(high, x[~below])
    return out


#: The labelled pages. {n} stands for n words; a block that begins with + is main text.
LABELLED = (
    # articles with navigation, adverts and footers around
    "<nav><ul><li><a>{1}</a></li><li><a>{1}</a></li><li><a>{2}</a></li></ul></nav><div class='ad'>{9}</div><article><h1>+{7}</h1><p>+{40}</p><p>+{3}</p><p>+{60} <a>{2}</a></p></article><footer>{12}</footer>",
    "<nav><a>{1}</a><a>{1}</a></nav><article><h1>+{2}</h1><p>+{2}</p></article><footer>{10}</footer>",
    "<nav><a>{3}</a></nav><div class='ad'>{14}</div><article><h1>+{1}</h1></article><footer>{4}</footer>",
    "<nav><ul><li><a>{8}</a></li><li><a>{12}</a></li></ul></nav><article><h1>+{9}</h1><p>+{1}</p></article><footer><a>{9}</a> {2}</footer>",
    "<nav><a>{25}</a></nav><article><p>+{33}</p><p>+<a>{7}</a></p><p>+{5}</p><p>+<a>{3}</a> {1}</p></article><nav><a>{30}</a></nav>",
    "<article><header><h1>+{4}</h1></header><p>+{20}</p><blockquote>+{15}</blockquote><table><tr><td>+{3}</td><td>+{2}</td></tr></table><section class='comments'><p>{40}</p></section><form>{6}</form><footer>{5}</footer></article>",
    "<article><p>+{1}</p><p>+<a>{2}</a></p><p>+{4}</p></article><aside><p>{60}</p></aside><footer><p>{45}</p></footer>",
    "<nav><a>{2}</a></nav><article><p>+{9}</p></article>",
    "<nav><a>{1}</a><a>{1}</a></nav><div class='ad'>{8}</div><article><h1>+{4}</h1><p>+{4}</p><p>+{3}</p><p>+{7}</p><p>+{5}</p></article><footer>{9}</footer>",
    "<article><h1>+{3}</h1><p>+{2}</p><p>+{1}</p><p>+{5}</p><p>+{6}</p></article>",
    "<main><h1>+{5}</h1><p>+{3}</p><ul><li>+{4}</li><li>+{5}</li><li>+{3}</li></ul><p>+{6}</p></main><div>{6}</div>",
    "<nav><a>{1}</a></nav><article><p>+{50}</p></article><div class='user-feedback'><p>{40}</p><p>{12}</p></div>",
    "<div><a>{2}</a> <a>{1}</a></div><article><h1>+{8}</h1><p>+{70}</p><p>+{110}</p></article><div><h3>{2}</h3><p>{25}</p><p>{31}</p><p>{9}</p></div><div>{7}</div>",
    "<div><a>{1}</a></div><article><p>+{30}</p><p>+{24}</p></article><div><p>{27}</p></div><div><p>{60}</p><p>{13}</p></div><p>{5}</p>",
    "<p>{11}</p><article><h1>+{6}</h1><div>+{4}</div><p>+{90}</p><h2>+{3}</h2><p>+{64}</p></article><p>{28}</p>",
    "<article><h1>+{5}</h1><p>+{35}</p><div class='share-buttons'><a>{1}</a><a>{1}</a> {1}</div><p>+{41}</p><div class='newsletter-signup'><h3>{4}</h3><p>{15}</p></div><p>+{52}</p><div class='related-posts'><h3>{2}</h3><a>{6}</a><a>{8}</a></div></article>",
    "<main><h1>+{6}</h1><p>+{47}</p><div class='related-links'><a>{5}</a></div><p>+{28}</p><p>+<a>{4}</a></p><div class='promo'><a>{6}</a></div><div class='ad'><a>{3}</a></div><nav><a>{2}</a></nav></main>",
    "<article><h1>+{7}</h1><nav><ul><li><a>{2}</a></li><li><a>{3}</a></li><li><a>{2}</a></li></ul></nav><p>+{66}</p><p>+<a>{3}</a></p><aside><a>{5}</a></aside><p>+{23}</p><footer><a>{2}</a></footer></article>",
    "<article><h1>+{4}</h1><p>+<a>{2}</a></p><p>+{58}</p><h2>+{2}</h2><p>+<a>{5}</a></p><h2>+{3}</h2><ul><li>+<a>{4}</a></li><li>+<a>{3}</a></li></ul></article>",
    "<article><h1>+{2}</h1><p>+<a>{3}</a></p><p>+{82}</p><p>+{1}</p><ul><li>+<a>{2}</a></li></ul><h2>+{2}</h2><ul><li>+<a>{3}</a></li><li>+<a>{7}</a></li></ul><h3>+{1}</h3><p>+<a>{2}</a></p></article>",
    "<main><h1>+{9}</h1><p>+<a>{2}</a></p><p>+{49}</p><h3>+{1}</h3><p>+<a>{6}</a></p></main>",
    "<article><p>+{55}</p><div class='share-bar'><a>{1}</a> <a>{1}</a></div><p>+<a>{8}</a></p><p>+{19}</p><div class='newsletter-box'><a>{4}</a></div></article>",
    "<header>{15}</header><nav>{8}</nav><div class='newsletter'>{25}</div><form>{30}</form><main><p>+{18}</p><p>+{1}</p><h2>+{3}</h2><p>+{90}</p></main>",
    # main elements, wrappers with names of boilerplate, forms around pages
    "<header><a>{1}</a> {3}</header><main><h1>+{5}</h1><p>+{25}</p><ul><li>+{8}</li><li>+{6}</li></ul><aside>{30}</aside><p>+{50}</p></main><div id='sidebar'><h3>{2}</h3><a>{4}</a></div><footer><a>{2}</a> {5}</footer>",
    "<nav><a>{3}</a></nav><main><p>+<a>{6}</a></p><p>+{3}</p></main>",
    "<header><a>{10}</a></header><main><p>+{7}</p><p>+{200}</p><ul><li>+<a>{6}</a></li><li>+<a>{9}</a></li></ul><p>+{2}</p></main><aside><a>{11}</a></aside>",
    "<div class='layout with-sidebar'><article><h1>+{4}</h1><p>+{45}</p></article><div class='sidebar'><p>{30}</p><a>{3}</a></div></div>",
    "<form id='aspnetForm'><div><a>{1}</a><a>{2}</a></div><div><h1>+{5}</h1><p>+{60}</p><p>+{37}</p></div><div><a>{2}</a> <a>{3}</a> {2}</div></form>",
    "<div class='page-with-comments'><div><h1>+{6}</h1><p>+{48}</p><p>+{17}</p></div><div id='comments'><h3>{2}</h3><p>{26}</p><p>{44}</p></div></div>",
    # pages without article and main
    "<div><p>+{60}</p></div><div><a>{1}</a> <a>{1}</a></div>",
    "<h1>+{6}</h1><p>+{27}</p><p>+{73}</p><ul><li><a>{3}</a></li><li><a>{2}</a></li></ul>",
    "<p>+{18}</p><p>+{24}</p><div><a>{3}</a></div>",
    "<h2>+{4}</h2><p>+{115}</p><a>{2}</a>",
    "<h1>+{7}</h1><p>+{50}</p><div><a>{2}</a></div><p>+{39}</p><div><a>{4}</a></div>",
    "<div class='cookie-notice'>{20}</div><div><a>{1}</a> <a>{2}</a> <a>{1}</a></div><div><h1>+{6}</h1><p>+{35}</p><p>+{80} <a>{3}</a></p><p>+{45}</p></div><div class='comments'><p>{30}</p><p>{22}</p></div><div><a>{2}</a> <a>{2}</a></div>",
    "<div><a>{2}</a></div><div><a>{3}</a> {1}</div><p>+{55}</p><p>+{12}</p><p>+{70}</p><div><a>{4}</a> <a>{2}</a></div><div>{3} <a>{2}</a></div>",
    "<div>{3}</div><ul><li><a>{1}</a></li><li><a>{1}</a></li><li><a>{2}</a></li></ul><h1>+{7}</h1><div>+{42}</div><div>+{61} <a>{4}</a></div><div>+{9}</div><div>+{33}</div><ul><li><a>{5}</a></li><li><a>{7}</a></li><li><a>{4}</a></li></ul><div>{4} <a>{3}</a></div>",
    "<div>{5}</div><div>{9}</div><h1>+{6}</h1><p>+{39}</p><p>+{54}</p><h3>{2}</h3><ul><li><a>{6}</a></li><li><a>{5}</a></li></ul>",
    "<p>{4}</p><h1>+{4}</h1><p>+{88}</p><p>+{6}</p><h3>{3}</h3><ul><li><a>{4}</a></li><li><a>{9}</a></li><li><a>{7}</a></li></ul>",
    "<div>{2}</div><p>{12}</p><h1>+{9}</h1><p>+{31}</p><p>+{27}</p><h3>{2}</h3><div><a>{6}</a> <a>{5}</a></div>",
    "<div>{7}</div><h1>+{3}</h1><p>+{63}</p><h2>+{3}</h2><p>+{40}</p><h3>{1}</h3><div><a>{3}</a></div><h3>{1}</h3><div><a>{5}</a></div>",
    "<table><tr><td><a>{2}</a></td><td><a>{1}</a></td></tr></table><table><tr><td><h1>+{5}</h1><p>+{58}</p><p>+{24}</p></td></tr></table><table><tr><td>{3} <a>{2}</a></td></tr></table>",
    "<div class='banner'>{6}</div><h1>+{3}</h1><p>+{22}</p><h2>+{2}</h2><p>+{30}</p><ul><li>+{6}</li><li>+{9}</li><li>+{7}</li></ul><h2>+{4}</h2><p>+{26}</p><div id='footer'><p>{14}</p></div>",
    "<div><a>{1}</a> {1} <a>{1}</a></div><h1>+{8}</h1><p>+{120}</p><p>+{4}</p><p>+{95}</p><div class='discussion'><p>{33}</p><p>{19}</p></div><div><a>{3}</a></div>",
    "<div><a>{4}</a></div><h2>+{6}</h2><p>+{47}</p><blockquote>+{21}</blockquote><p>+{66}</p><h3>{2}</h3><ul><li><a>{6}</a></li><li><a>{5}</a></li></ul>",
    "<p>+{30}</p><p>+{6}</p>",
    "<h1>+{5}</h1><p>+{28}</p>",
    "<p>+{2}</p>",
    "<div>+{14}</div>",
    "<p>+{80}</p><p>+{1}</p><p>+{44}</p><p>+{2}</p>",
    "<div class='notice'><p>{18}</p></div><p>+{26}</p><p>+{3}</p><div class='sponsored'><p>{35}</p></div><p>+{31}</p>",
    "<form><p>{8}</p></form><p>+{36}</p><p>+{15}</p><aside><p>{50}</p></aside><p>+{29}</p><footer><p>{20}</p></footer>",
    # cards of other articles beside the text, threads without telling names, neighbours that tell a short block's side
    "<main><div><h1>+{6}</h1><p>+{50}</p><p>+{54}</p></div><div><article><h3>{5}</h3><p>{20}</p></article><article><h3>{4}</h3><p>{18}</p></article></div></main>",
    "<nav><a>{2}</a></nav><div><h1>+{7}</h1><p>+{61}</p><p>+{3}</p><p>+{39}</p></div><article><h2>{4}</h2><p>{15}</p></article><article><h2>{6}</h2><p>{17}</p></article><article><h2>{3}</h2><p>{22}</p></article>",
    "<main><h1>+{5}</h1><p>+{71}</p><p>+{48}</p><section><h2>{3}</h2><article><h3><a>{6}</a></h3><p>{21}</p></article></section></main>",
    "<article><h1>+{5}</h1><p>+{66}</p><p>+{51}</p><section id='x'><div><b>{2}</b><p>{24}</p></div><div><b>{1}</b><p>{9}</p></div></section></article>",
    "<div><h1>+{8}</h1><p>+{57}</p><p>+{72}</p></div><ul><li><div>{3}</div><p>{18}</p></li><li><div>{3}</div><p>{25}</p></li><li><div>{2}</div><p>{7}</p></li></ul>",
    "<div><h1>+{6}</h1><p>+{12}</p><div><div>+{2}</div><p>+{40}</p></div><div><div>+{2}</div><p>+{33}</p></div></div><div><a>{2}</a></div>",
    "<header><h1>{3}</h1><p>{5}</p></header><nav><a>{1}</a></nav><h2>+{5}</h2><p>+{71}</p><p>+{38}</p><footer>{9}</footer>",
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED."""
    xs, ys = [], []
    for page in LABELLED:
        found, elements = parse(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))
        xs.append(features(found, elements))
        ys += [b.text.startswith("+") for b in found]
    return np.concatenate(xs), np.array(ys, float)


@cache
def trained_tree():
    return grow(*labelled_blocks())


def main_text(page: str, tree) -> str:
    found, elements = parse(page)
    if not found:
        return ""
    keep = decide(tree, features(found, elements)) >= 0.5
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The id columns and text (empty if there is none) of every page; a null html is an empty page.

    Rows are independent: null and repeated ids are kept, and an empty table gives no rows. Broken mark-up
    never fails, and a page takes time in proportion to its length. Other columns are not looked at.
    """
    tree = trained_tree()
    n = len(id_cols)

    def scan(batches):
        for batch in batches:
            texts = [main_text(x.decode(), tree) for x in as_bytes(batch.column(n))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*batch.schema.names[:n], "text"])

    bounded_batches(pages.sparkSession)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols)
    return pages.select(*id_cols, html_col).mapInArrow(scan, f"{kinds}, text string")


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page; null and empty pages and pages without an article give the empty text."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
