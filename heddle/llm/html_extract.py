"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

1. A page is read as a stream of tags and texts.  Implied end tags are added and inline markup is transparent.  What stands
   between a tag and its end is put in canonical form: neighbours of the same form become a repeated group (``p p p`` is
   ``(p)+``, ``h2 p h2 p`` is ``(h2 p)+``).
2. The streams of one host are aligned one after another, what stands between two tags with what stands between theirs.
   Where they agree, the wrapper stays; a mismatch turns into an optional part, or into a repeated one if it repeats its
   neighbour; texts become slots, which remember whether all pages that have them had the same text there, the texts of
   a repeated group taken together.
3. A page's main text stands in its outermost zones: all of ``main`` with the articles in it, else articles.  Without these it
   is what stands before and in the parts that are named content, else the whole page; a part named content beside a main or
   article that has less text is main text as well.  Parts that are menus, headers, footers, sidebars, notices, adverts,
   forms, scripts, styles or reader comments by their element, role, class or id are left out.
4. Where names say nothing, the wrapper decides, in all zones alike: each page is aligned with its host's wrapper again, and a slot that
   has one and the same text on most of the host's pages, where other slots differ, may be part of the form (a menu, a notice, a
   share bar).  Equal text alone doesn't decide: it goes only with the largest part around it in which no text differs, if that is
   a ``div`` or ``section`` (for links: or a list) and stands before the first or after the last text that differs, or is mostly
   links.  Headings, paragraphs and other running text beside text that differs stay, and so does all that is undecided, as on the only
   page of a host.  Outside named zones a list item that is nothing but a link, or a row of links, is a menu if it is
   fixed or if no other text stands before it.

A wrapper has a bound.  Below ``DEPTH`` levels, or inside a part that is not the article, elements are no longer told apart
(their texts are, so nothing is lost); a level of over ``WIDTH`` parts becomes ``(a? b? c?)+`` over its elements' names, but
for forms that most pages have; and a wrapper
of over ``PARTS`` parts is cut at the depth where it has fewer, with one slot for what is below.

Wrappers are folded inside each task first, then by (host, salt), then by host, so a host with a third of all pages
costs one task no more than a few partial wrappers.  Wrappers are broadcast if their total size is at most
``broadcast_bytes``; otherwise pages and wrappers meet by (host, salt).

Defined results: null or empty html gives an empty text; a null url counts as the host ``""``; repeated rows are extracted
each; a null id is an id; only the three named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import cut, settle

DEPTH, WIDTH, PARTS = 100, 64, 1000
#: HTML's inline, void and raw-text elements, and the open elements that a start tag ends.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_ENDING = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select"), "thead": ("tr td th thead", "table"), "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th tbody", "table")}
#: Elements, roles and words of class or id that mark what is not the article.
OUT_TAGS = frozenset("aside button dialog footer form head header iframe input menu nav noscript script select style svg template textarea title".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUT_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header masthead menu nav navbar navigation notice notices notification notifications pagenav pager pagination popup promo promoted sidebar sponsor sponsored toolbar topbar".split()
)
#: Headings, and elements of running text.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = HEADINGS | frozenset("blockquote dd dt figure li p pre".split())
BOXES, LISTS = frozenset("center div section".split()), frozenset("dl menu ol table ul".split())
IN_WORDS = frozenset("article content entry main post story".split())
#: Words after a name that only say where or how its part is laid out.
LAYOUT = frozenset("area bar block bottom box container inner item items left links list middle outer right text top widget wrap wrapper".split())
#: Zones by rank: article, main, content; the rest is last.
REST, NAMED = 3, 2

_ATTRS = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>script|style|title|textarea|noscript|iframe|xmp)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{_ATTRS})>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[^\W\d_]+")
_GAPS = re.compile(r"[\s|/\\,;:.>»«·•–—-]+")
TEXT = "#"


class Node:
    """An element, or a text leaf (label ``#``); ``rank`` is its zone, ``out`` says that it isn't part of the article."""

    __slots__ = ("anchors", "depth", "kids", "label", "links", "out", "parts", "rank", "tag", "titles", "up", "within")

    def __init__(self, tag: str, label: str, up: Node | None = None):
        self.tag, self.label, self.kids, self.parts, self.links, self.anchors, self.up = tag, label, [], [], 0, 0, up
        self.depth, self.rank, self.out, self.within, self.titles = (up.depth + 1, up.rank, up.out, up.within, up.titles) if up else (0, REST, False, False, False)

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@lru_cache(maxsize=20_000)
def _label(tag: str, attrs: str) -> str:
    if "=" not in attrs:
        return tag
    marks: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        marks.setdefault(m[1].lower(), " ".join(sorted((m[2] or m[3] or m[4] or "").lower().split())))
    # digits in ids and long numbers in classes number things; they aren't part of the form, but ``box1`` and ``box2`` may be
    parts = [f"{k}={re.sub(r'[0-9]{2,}' if k == 'class' else r'[0-9]+', '9', marks[k])}" for k in ("class", "id", "role") if marks.get(k)]
    return f"{tag} {'|'.join(parts)}" if parts else tag


def _ends(token: str) -> set[str]:
    """A class or id with its first and its last part: ``site-footer`` and ``footer-text`` are footers, ``my-footer-text`` isn't."""
    parts = _PART.findall(token)
    return {token, parts[0], parts[-1]} if parts else {token}


def _named_out(token: str, key: str) -> bool:
    """Whether a class or id names, inside an article or main part, something else: by itself, by its last word (classes
    only: ids are often made of an article's words), or by a first word that only words of layout follow."""
    parts = _PART.findall(token)
    if token in OUT_WORDS or len(parts) > 1 and parts[0] in OUT_WORDS and LAYOUT.issuperset(parts[1:]):
        return True
    return key == "class" and bool(parts) and parts[-1] in OUT_WORDS


@lru_cache(maxsize=20_000)
def outside(label: str, within: bool = False) -> bool:
    """Whether a part of this form is something else than the article.

    Ids of headings, and of sections and inline elements ``within`` an article or main part, are made of their words and say
    nothing.  Running text within these goes only by a whole class: ``section-header`` is a place in the article.
    """
    tag, _, marks = label.partition(" ")
    if tag in OUT_TAGS:
        return True
    if tag in ("body", "html", "article", "main"):
        return bool(tag == "article" and any(OUT_WORDS & {*v.split()} for v in re.findall(r"class=([^|]*)", marks)))
    for mark in marks.split("|") if marks else ():
        key, _, value = mark.partition("=")
        if key == "role":
            if value in OUT_ROLES:
                return True
        elif key == "id" and (tag in HEADINGS or within and (tag == "section" or tag in INLINE)):
            continue
        elif within and (tag in RUNNING or tag in INLINE):
            if (OUT_WORDS & {*value.split()}) - {"header"}:
                return True
        elif any(_named_out(token, key) if within else OUT_WORDS & _ends(token) for token in value.split()):
            return True
    return False


@lru_cache(maxsize=20_000)
def titled(label: str) -> bool:
    """Whether a part within an article is a header, whose headings are the article's."""
    tag, _, marks = label.partition(" ")
    tokens = [t for v in re.findall(r"class=([^|]*)", marks) for t in v.split()]
    named = [t for t in tokens if _named_out(t, "class")]
    return tag == "header" or tag not in OUT_TAGS and bool(named) and all(_PART.findall(t)[-1] == "header" for t in named)


@lru_cache(maxsize=20_000)
def zone(label: str) -> int:
    """Rank of the zone that an element of this form opens."""
    tag, _, marks = label.partition(" ")
    if tag == "article":
        return 0
    if tag == "main" or "role=main" in marks:
        return 1
    return 2 if marks and tag not in ("body", "html") and IN_WORDS & {*_PART.findall(re.sub(r"\w+=", "", marks))} else REST


def _child(up: Node, tag: str, label: str) -> Node:
    """The node of an element below ``up``: ``up`` itself where elements are no longer told apart."""
    if up.out and not (up.titles and tag in HEADINGS):
        return up
    rank, out = min(up.rank, zone(label)), outside(label, up.within)
    if up.titles:  # a header of an article: its headings are the article's
        rank, out = up.rank, tag not in HEADINGS
    if up.depth >= DEPTH and rank == up.rank and out == up.out:
        return up
    node = Node(tag, label, up)
    node.titles = not up.titles and out and up.within and titled(label)
    node.rank, node.out, node.within = rank, out, up.within or rank < 2
    return node


def parse(html: str) -> Node:
    """The page as a tree of blocks; texts are leaves, character references decoded."""
    root = Node("", "")
    tags, nodes, places, link = [""], [root], defaultdict(list), 0

    def add_text(raw: str, glue: bool = False) -> None:
        kids = nodes[-1].kids
        if not kids or kids[-1].label != TEXT:
            if glue or raw.isspace():
                return
            kids.append(Node(TEXT, TEXT, nodes[-1]))
        kids[-1].parts.append(raw)
        if link:
            kids[-1].links += len(_GAPS.sub("", raw))

    def end(k: int) -> None:
        """Ends all elements from the k-th on."""
        while len(tags) > k:
            places[tags.pop()].pop()
            nodes.pop()
        add_text(" ", True)

    def last(names: str) -> int:
        return max((places[n][-1] for n in names.split() if places[n]), default=0)

    for m in _TOKEN.finditer(html):
        text = m["text"]
        if text is not None:
            add_text(entities.unescape(text) if "&" in text else text)
            continue
        if not m["tag"]:
            continue
        tag, attrs = m["tag"].lower(), m["attrs"]
        if tag == "br":
            add_text(" ", True)
            continue
        if m["end"]:
            if tag == "a":
                link = 0
            if places[tag] and (tag not in INLINE or all(t in INLINE for t in tags[places[tag][-1] :])):
                end(places[tag][-1])
            continue
        up = nodes[-1]
        if tag == "a":
            link = 1
            if up.kids and up.kids[-1].label == TEXT:
                up.kids[-1].anchors += 1
        label = _label(tag, attrs)
        if tag in INLINE and not (outside(label) and outside(label, up.within)):
            continue
        if tag in ENDS_P and places["p"] and all(t in INLINE for t in tags[places["p"][-1] + 1 :]):
            end(places["p"][-1])
        if tag in SELF_ENDING:
            ended, around = SELF_ENDING[tag]
            k = last(ended)
            if k > last(around):
                end(min(places[n][-1] for n in ended.split() if places[n] and places[n][-1] > last(around)))
        up = nodes[-1]
        node = _child(up, tag, label)
        if node is up:
            add_text(" ", True)
        else:
            up.kids.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            places[tag].append(len(tags))
            tags.append(tag)
            nodes.append(node)
    return root


def collapse(kids: list[Node]) -> list[tuple[str, list[Node]]]:
    """Children as (label, nodes) items; equal neighbours, then equal runs of two to four items, become one."""
    items: list[tuple[str, list[Node]]] = []
    for node in kids:
        if items and items[-1][0] == node.label:
            items[-1][1].append(node)
        else:
            items.append((node.label, [node]))
    for size in (2, 3, 4):
        out: list[tuple[str, list[Node]]] = []
        for item in items:
            out.append(item)
            if len(out) >= 2 * size and all(out[-j][0] == out[-j - size][0] for j in range(1, size + 1)):
                for j in range(size):
                    out[-2 * size + j][1].extend(out[-size + j][1])
                del out[-size:]
        items = out
    return items


# A wrapper part is a list: [label, optional, repeated, level, parts, pages, hash of the only text or 0].
# The level says how its parts are told apart: in order and by label, as (a? b? c?)+ by element, or not at all.
LABEL, OPTIONAL, REPEATED, LEVEL, KIDS, PAGES, SAME = range(7)
ORDERED, LOOSE, OPEN = range(3)


def _key(label: str) -> str:
    return label.partition(" ")[0]


def _both(a: int, b: int, page: bool) -> int:
    """Of two slots' texts: side by side, both in their order; of different pages, the common one."""
    return (xxhash.xxh3_64_intdigest(b"%d %d" % (a, b)) | 1 if a and b else 0) if page else a if a == b else 0


def form(label: str, nodes: list[Node]) -> list:
    """The wrapper part that one page's equal neighbours give."""
    part = None
    for node in nodes:
        own = [label, 0, 0, ORDERED, [], 1, 0]
        if label == TEXT:
            own[SAME] = xxhash.xxh3_64_intdigest(node.text) | 1
        else:
            own[KIDS] = [form(*item) for item in collapse(node.kids)]
            if len(own[KIDS]) > WIDTH:
                _loosen(own, True)
        part = own if part is None else merge(part, own, True)
    part[REPEATED] |= len(nodes) > 1
    return part


def _loosen(part: list, page: bool) -> None:
    """Tells the parts of a level apart by their elements alone."""
    if part[LEVEL] != ORDERED:
        return
    found: dict[str, list] = {}
    for kid in part[KIDS]:
        # a label that most pages have stays, unless this is one page
        _put(found, kid, kid[LABEL] if not page and 2 * kid[PAGES] > part[PAGES] else _key(kid[LABEL]), True)
    part[LEVEL], part[KIDS] = LOOSE, list(found.values())


def _put(found: dict[str, list], kid: list, key: str, page: bool) -> None:
    if key not in found and len(found) >= WIDTH:
        key = "*"
    kid = [key, 1, 1, *kid[LEVEL:]]
    found[key] = merge(found[key], kid, page) if key in found else kid


def _open(part: list) -> None:
    """One slot for all texts below."""
    if part[LEVEL] != OPEN:
        part[LEVEL], part[KIDS] = OPEN, [[TEXT, 1, 1, ORDERED, [], part[PAGES], 0]]


def steps(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """The common subsequence of two levels as index pairs, -1 where one side has nothing; what more pages have counts for more."""
    n, m = len(a), len(b)
    x, y = [p[LABEL] for p in a], [p[LABEL] for p in b]
    if x == y:
        return [(i, i) for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, worth = best[i], best[i + 1], a[i][PAGES]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + worth * b[j][PAGES] if x[i] == y[j] else 0)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j] and best[i][j] == best[i + 1][j + 1] + a[i][PAGES] * b[j][PAGES]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, -1))
            i += 1
        else:
            out.append((-1, j))
            j += 1
    return out


def merge(a: list, b: list, page: bool = False) -> list:
    """Two parts of one label as one, side by side on a page or of different pages; what only one of them has becomes optional."""
    whole = [a[LABEL], a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED], ORDERED, [], max(a[PAGES], b[PAGES]) if page else a[PAGES] + b[PAGES], _both(a[SAME], b[SAME], page)]
    level = max(a[LEVEL], b[LEVEL])
    if level == OPEN:
        whole[LEVEL] = ORDERED
        _open(whole)
        return whole
    if level == LOOSE:
        _loosen(a, page)
        _loosen(b, page)
        found = {kid[LABEL]: kid for kid in a[KIDS]}
        for kid in b[KIDS]:
            _put(found, kid, kid[LABEL] if kid[LABEL] in found else _key(kid[LABEL]), page)
        whole[LEVEL], whole[KIDS] = LOOSE, list(found.values())
        return whole
    kids = whole[KIDS]
    for i, j in steps(a[KIDS], b[KIDS]):
        if i >= 0 and j >= 0:
            kids.append(merge(a[KIDS][i], b[KIDS][j], page))
        else:
            only = list(a[KIDS][i] if i >= 0 else b[KIDS][j])
            if kids and kids[-1][LABEL] == only[LABEL]:
                kids[-1] = merge(kids[-1], only, page)
                kids[-1][REPEATED] = 1  # it repeats its neighbour
            else:
                only[OPTIONAL] = 1
                kids.append(only)
    if len(kids) > WIDTH:
        _loosen(whole, page)
    return whole


def bounded(wrapper: list, limit: int = PARTS) -> list:
    """The wrapper, cut at the depth where it has at most ``limit`` parts."""
    level, total = [wrapper], 1
    while level:
        below = [kid for part in level for kid in part[KIDS]]
        total += len(below)
        if total > limit:
            for part in level:
                if len(part[KIDS]) > 1 or part[KIDS] and part[KIDS][0][KIDS]:
                    _open(part)
            return wrapper
        level = below
    return wrapper


class Wrapper:
    """A host's wrapper, ready for its pages."""

    def __init__(self, spec: str | list):
        self.root = json.loads(spec) if isinstance(spec, str) else spec
        self.known: dict[tuple, list[int]] = {}
        self.ids: dict[int, int] = {}
        pages, todo, slots = max(1, self.root[PAGES]), [self.root], []
        while todo:
            part = todo.pop()
            slots += [part] if part[LABEL] == TEXT else []
            todo += part[KIDS]
        same = [part for part in slots if part[SAME] and part[PAGES] > 1 and 2 * part[PAGES] > pages]
        # where no text differs, the pages are copies of one page, and nothing shows what its form is
        self.fixed = {id(part) for part in same} if any(not part[SAME] for part in slots) else set()

    def _align(self, part: list, labels: tuple[str, ...]) -> list[int]:
        """The place in the wrapper of each item of a page's level, or -1."""
        key = (id(part), labels)
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            own = [p[LABEL] for p in part[KIDS]]
            if part[LEVEL] == LOOSE or len(labels) > WIDTH:
                names = {n: i for i, n in reversed(list(enumerate(own)))}
                at = [names.get(n, names.get(_key(n), names.get("*", -1))) for n in labels]
            else:
                at = [-1] * len(labels)
                for i, j in steps(part[KIDS], [[label, 0, 0, 0, [], 1, 0] for label in labels]):
                    if j >= 0:
                        # a repeat that the wrapper has folded into its neighbour stands at its first place
                        at[j] = i if i >= 0 else next((k for k, n in enumerate(own) if n == labels[j]), -1)
            self.known[key] = at
        return self.known[key]

    def leaves(self, root: Node) -> Iterator[tuple[Node, list | None, Node]]:
        """All texts with their slots and the elements around them; in page order of each level's groups."""

        def walk(part: list | None, nodes: list[Node]) -> Iterator[tuple[Node, list | None, Node]]:
            for node in nodes:
                if part is not None and part[LEVEL] == OPEN:
                    part_of = [part] * len(node.kids)
                    groups = [(kid.label, [kid]) for kid in node.kids]
                else:
                    groups = collapse(node.kids)
                    at = self._align(part, tuple(g[0] for g in groups)) if part is not None else [-1] * len(groups)
                    part_of = [part[KIDS][k] if k >= 0 else None for k in at]
                for (label, own), inner in zip(groups, part_of, strict=True):
                    if label == TEXT:
                        slot = inner[KIDS][0] if inner is not None and inner[LEVEL] == OPEN else inner
                        yield from ((leaf, slot, node) for leaf in own)
                    else:
                        yield from walk(inner, own)

        return walk(self.root, [root])

    def text(self, html: str) -> str:
        root = parse(html)
        slots = {id(leaf): slot for leaf, slot, _ in self.leaves(root)}
        page, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.label == TEXT and not node.out and (text := node.text):
                page.append((node, text, id(slots.get(id(node))) in self.fixed))
            todo += reversed(node.kids)
        chosen = _zones(page)
        form = _form(chosen) if any(fixed for _, _, fixed in chosen) else set()
        out: list[str] = []
        for leaf, text, fixed in chosen:
            if id(leaf) in form or leaf.rank == REST and _links(leaf, text) and (fixed or not out):
                continue
            out.append(text)
        return " ".join(out)


def _zones(page: list[tuple[Node, str, bool]]) -> list[tuple[Node, str, bool]]:
    """The texts of a page's outermost zones, in page order."""
    strong = [row for row in page if row[0].rank < NAMED]
    named = [row for row in page if row[0].rank == NAMED]
    if strong:
        around = {id(_top(row[0])) for row in strong}
        beside = [row for row in named if id(_top(row[0])) not in around]
        size = lambda rows: sum(len(text) for _, text, _ in rows)
        more = {id(row[0]) for row in beside} if size(beside) > size(strong) else set()
        return [row for row in page if row[0].rank < NAMED or id(row[0]) in more]
    if named:
        first = next(k for k, row in enumerate(page) if row[0].rank == NAMED)
        return page[:first] + named
    return page


def _top(leaf: Node) -> Node | None:
    """The outermost part named content around a text."""
    found, node = None, leaf
    while node is not None:
        found = node if node.rank == NAMED else found
        node = node.up
    return found


def _form(rows: list[tuple[Node, str, bool]]) -> set[int]:
    """The fixed texts that are part of the form by their place: ids of their leaves."""
    differ = [k for k, (_, _, fixed) in enumerate(rows) if not fixed]
    if not differ:
        return set()
    alive: set[int] = set()  # parts with a text that differs
    for k in differ:
        node = rows[k][0].up
        while node is not None and id(node) not in alive:
            alive.add(id(node))
            node = node.up
    parts: dict[int, list] = {}
    for k, (leaf, text, fixed) in enumerate(rows):
        node = leaf
        while fixed and node.up is not None and id(node.up) not in alive and node.up.tag not in ("", "html", "body", "article", "main"):
            node = node.up
        if fixed and node is not leaf:
            parts.setdefault(id(node), [node.tag, []])[1].append((k, leaf, len(_GAPS.sub("", text))))
    out = set()
    for tag, texts in parts.values():
        linked = 2 * sum(min(leaf.links, size) for _, leaf, size in texts) >= sum(size for _, _, size in texts) > 0
        edge = texts[-1][0] < differ[0] or texts[0][0] > differ[-1]
        if tag in BOXES and (edge or linked) or tag in LISTS and linked:
            out |= {id(leaf) for _, leaf, _ in texts if leaf.up.tag not in HEADINGS or linked}
    return out


def _links(leaf: Node, text: str) -> bool:
    """Whether a text is a list item that is one link, or a row of links."""
    if not leaf.links or leaf.links < len(_GAPS.sub("", text)):
        return False
    return leaf.up.tag in ("li", "dt", "dd") or leaf.up.tag not in RUNNING and leaf.anchors > 0


@lru_cache(maxsize=512)
def _wrapper(spec: str) -> Wrapper:
    return Wrapper(spec)


def _folded(batches: Iterator[pa.RecordBatch], read, key_names: list[str], limit: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Folds wrappers by the key columns inside a task; emits them at its end, or when it holds many hosts."""
    found: dict[tuple, list] = {}

    def flush():
        keys = list(zip(*found, strict=True)) or [[] for _ in key_names]
        batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string() if n == "host" else pa.int32()) for c, n in zip(keys, key_names, strict=True)), pa.array([json.dumps(w, ensure_ascii=False, separators=(",", ":")) for w in found.values()], pa.string())], names=[*key_names, "wrapper"])
        found.clear()
        return batch

    for batch in batches:
        values = [c.to_pylist() for c in batch.columns]
        for *key, payload in zip(*values, strict=True):
            own = read(payload)
            key = tuple(key)
            found[key] = bounded(merge(found[key], own)) if key in found else own
        if len(found) > limit:
            yield flush()
    if found:
        yield flush()


def page_form(html: str | None) -> list:
    page = bounded(form("", [parse(html or "")]))
    page[PAGES] = int(bool(page[KIDS]))  # a page without anything says nothing about the form
    return page


def infer(pages: DataFrame, salts: int = 32) -> DataFrame:
    """(host, wrapper) from rows (host, html)."""
    first = pages.select("host", "html").mapInArrow(lambda it: _folded(it, page_form, ["host"]), "host string, wrapper string")
    salted = first.select("host", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).cast("int").alias("salt"), "wrapper").repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
    second = salted.mapInArrow(lambda it: _folded(it, json.loads, ["host", "salt"]), "host string, salt int, wrapper string")
    last = second.select("host", "wrapper").repartition("host").sortWithinPartitions("host", "wrapper")
    return last.mapInArrow(lambda it: _folded(it, json.loads, ["host"], 1 << 60), "host string, wrapper string")


def extract(pages: DataFrame, broadcast_bytes: int = 32 << 20, salts: int = 32, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    settle(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    wrappers = cut(infer(rows))
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= broadcast_bytes:
        met = rows.join(F.broadcast(wrappers), "host")
    else:
        spread = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_wrapper(w).text(h) if h else "" for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = rows.schema["id"].dataType.simpleString()
    return met.select("id", "url", "html", "wrapper").mapInArrow(run, f"`{id_col}` {kinds}, `{url_col}` string, text string, n_chars long")
