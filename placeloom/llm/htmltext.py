"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive and tags negative, by log-odds counted
on labelled pages (those that mark their content as ``<article>``; a bounded sample of them is
enough), and one linear scan finds the contiguous region of the highest sum. Its bounds decide what
is content: they are only moved out to whole blocks, and to the ends of elements inside the body of
whose words the region holds four fifths or more. An ``<article>`` tag by itself decides nothing.

Elements that are no article by their kind or role (menus, page headers, footers, sidebars, forms)
score nothing and are left out of the region. So are those whose classes and ids weigh against
content: each class or id has a weight, counted on the labelled pages; names of notices, adverts,
sidebars and the like begin at -2 and can only fall. An element that holds most of the text around it
stays, but for readers' comments.

Blocks are trimmed, white space inside them becomes one space, and they are joined by line feeds;
character references are decoded. Null and empty pages, and pages without words, have an empty
text. Without labelled pages fixed weights serve. Repeated rows are treated alike; extra columns
are ignored; an empty table gives an empty result. A page costs time in proportion to its length,
however broken it is: tags are found without going back, and open elements are looked up by name. On
a page with more than ``BROKEN`` tags whose quotes swallow every later end of a tag, quotes no longer
count after these.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: Labelled pages that weights are counted on, about.
LABELLED = 500
#: Classes and ids get a weight of their own if this share of the labelled pages has them (three pages at least).
LEAST_SHARE = 0.02
#: Labelled pages that a weight's beginning counts for.
PRIOR_PAGES = 5
#: A region is moved out to the ends of the elements of whose words it holds this share.
MOST = 0.8

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_EVENT = re.compile(r">|=\s*+([\"'])")
_TAG_END = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
#: Skipped up to their closing tag; without one, the first to the end of the page, the others not at all.
RAW = frozenset("script style textarea title".split())
SKIPPED = RAW | frozenset("noscript template iframe object select".split())
_CLOSED = re.compile(rf"</({'|'.join(sorted(SKIPPED))})\s*>", re.I)
#: Other tags that end an svg or math element left open, beside blocks.
BREAKS_OUT = frozenset("b big br code em embed hr i img meta nobr ruby s small span strong strike sub sup tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
KNOWN = BLOCK | VOID | SKIPPED | INLINE | frozenset("article main section svg math button audio video canvas map applet datalist".split())
#: What an opening tag closes, up to the given holders.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "datalist")}
CLOSES = {k: (a.split(), b.split()) for k, (a, b) in CLOSES.items()}
LEFT_OUT = frozenset("svg nav footer aside head dialog button menu fieldset audio video canvas map applet datalist".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promotion banner banners sidebar sidebars rail menu menus nav navbar navigation topnav breadcrumb breadcrumbs cookie cookies consent gdpr "
    "notice notices alert alerts popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus "
    "footer masthead widget widgets toolbar pagination pager login search skip paywall copyright disclaimer".split()
)
#: Parts that only say where or what kind of box a name such as ``left-sidebar`` means.
PLACES = frozenset("site page main top bottom left right primary secondary global box bar list wrapper wrap container section block area inner outer button buttons link links item items panel".split())
#: Names of comments; those in the second set are of whole threads.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
THREADS = frozenset("comments commentlist replies disqus".split())
#: Elements that a thread has and a text seldom.
TALK = frozenset("form textarea time button input".split())
#: Names of adverts, which counts don't raise: they may stand in any article.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promotion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

Weights = dict[str, float]
#: In use where labelled pages tell nothing: of words (""), of tags by name, of classes and ids by "." and name.
DEFAULT: Weights = {"": 0.5, "a": -2.0, "div": -1.0, "section": -0.5, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "ul": -0.1, "ol": -0.1, "hr": -0.1}
DEFAULT |= dict.fromkeys("p h1 h2 h3 h4 h5 h6 li br b i em strong span blockquote pre td th tr code sub sup small img figure figcaption svg math".split(), -0.05)
UNKNOWN = -1.0
#: The weight that names of what is no content begin with, and that at which an element is left out.
NAMED, LEFT_OUT_AT = -2.0, -1.0


class Node:
    """An element: where it begins and ends among the pieces, and the element around it."""

    __slots__ = ("block", "depth", "end", "inside", "kind", "name", "order", "out", "parent", "soft", "start", "strict", "text_blocks", "thread", "words")

    def __init__(self, name: str, parent: Node | None, start: int, order: int) -> None:
        self.name, self.parent, self.start, self.end, self.order = name, parent, start, -1, order
        self.depth = parent.depth + 1 if parent else 0
        #: the article (or main) that it is or stands in
        self.inside: Node | None = self if name in ("article", "main") else parent.inside if parent else None
        #: the block that it is or stands in
        self.block: Node | None = self if name in BLOCK else parent.block if parent else None
        #: left out whatever it holds; left out unless it holds most of the text around it, and (strict) headings or paragraphs
        self.out, self.soft, self.strict = bool(parent and parent.out), False, False
        self.words = self.text_blocks = 0
        #: its name with its classes; whether they name a comment (1) or a thread of them (2)
        self.kind, self.thread = name, 0


def named_out(token: str) -> bool:
    """Whether a whole class or id names something left out; of parts, all must (``cookie-notice``, not ``notice-period``)."""
    parts = [x for x in re.split(r"[-_:]+", token) if x and not x[0].isdigit()]
    if token in LEFT_OUT_NAMES or not LEFT_OUT_NAMES.isdisjoint(parts) and all(x in LEFT_OUT_NAMES or x in PLACES for x in parts):
        return True
    return bool(parts) and parts[-1] == "header" and all(x in PLACES for x in parts[:-1])


def _tokens(attrs: dict[str, str]) -> set[str]:
    return {t for key in ("class", "id") for t in attrs.get(key, "").lower().split()}


def _attributes(raw: str) -> dict[str, str]:
    """Of repeated attributes the first."""
    out: dict[str, str] = {}
    for key, value in _ATTR.findall(raw):
        out.setdefault(key.lower(), value.strip("\"'"))
    return out


def _judge(node: Node, attrs: dict[str, str], by: Weights) -> None:
    """Whether an element is no content by what it says of itself."""
    name, tokens = node.name, _tokens(attrs)
    if name in LEFT_OUT or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in LEFT_OUT_ROLES:
        node.out = True
    elif re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        node.out = True
    elif name in ("html", "body", "article", "main"):
        pass
    elif name == "header" and node.inside is None:
        node.out = True
    elif name == "form":
        node.soft = node.strict = True
    elif tokens and not (name in HEADINGS or name == "p" and node.inside):
        node.soft = sum(by.get("." + t, NAMED if named_out(t) else 0.0) for t in tokens) <= LEFT_OUT_AT
        node.strict = node.inside is None
        for t in tokens:
            parts = set() if node.out or not named_out(t) else set(re.split("[-_:]+", t))
            node.thread = max(node.thread, 2 if parts & THREADS else 1 if parts & COMMENTS else 0)
        node.kind = f"{name} {attrs.get('class', '')}"


class _TagEnds:
    """Where tags end, once one was found that doesn't: each quote is followed once, so that many broken tags cost no more than the page.

    A tag ends at the first > that stands in no quoted value; a quote without its like after it is an ordinary character.
    """

    def __init__(self, page: str) -> None:
        self.page, self.known = page, {}
        self.events = [(m.start(), m[1], m.end()) for m in _EVENT.finditer(page)]
        self.starts = [e[0] for e in self.events]
        self.last = {q: page.rfind(q) for q in "\"'"}

    def after(self, at: int) -> int:
        """The end of the tag whose name ends here; -1 if there is none."""
        chain, end = [], -1
        while True:
            k = bisect_left(self.starts, at)
            if k == len(self.events):
                break
            if k in self.known:
                end = self.known[k]
                break
            _, quote, upto = self.events[k]
            if not quote:
                end = upto
                break
            chain.append(k)
            at = self.page.find(quote, upto) + 1 if upto <= self.last[quote] else upto
        self.known.update(dict.fromkeys(chain, end))
        return end


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """``("text", it, "")``, ``("open", name, attributes)`` and ``("close", name, "")``, in page order."""
    last_end, last_comment, last_cdata = page.rfind(">"), page.rfind("-->"), page.rfind("]]>")
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSED.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.span())
    ends_of: _TagEnds | None = None
    done = at = 0  # what is before `done` is told, what is before `at` is text
    while (lt := page.find("<", at)) >= 0:
        at = lt + 1
        follows = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            yield "text", page[done:lt], ""
            done = at = page.find("-->", lt + 2) + 3 if lt + 2 <= last_comment else len(page)
        elif page.startswith("<![CDATA[", lt) and lt < last_cdata:
            end = page.find("]]>", lt)
            yield "text", page[done:lt], ""
            yield "text", page[lt + 9 : end], ""
            done = at = end + 3
        elif lt > last_end:
            continue
        elif follows in ("!", "?") or follows == "/":
            end = page.find(">", lt) + 1
            yield "text", page[done:lt], ""
            if follows == "/" and (m := _NAME.match(page, lt + 2)):
                yield "close", m[0].lower(), ""
            done = at = end
        elif m := _NAME.match(page, lt + 1):
            name = m[0].lower()
            if ends_of is None:
                got = _TAG_END.match(page, m.end())
                if not got:
                    ends_of = _TagEnds(page)
            if ends_of is not None:
                end = ends_of.after(m.end())
                end = end if end > 0 else page.find(">", lt) + 1
            else:
                end = got.end()
            attrs = page[m.end() : end - 1]
            yield "text", page[done:lt], ""
            done = at = end
            if name in SKIPPED and attrs[:1] in ("", "/", *" \t\n\r\f"):
                after = ends.get(name, [])
                k = bisect_left(after, (end, end))
                if k < len(after) or name in RAW:
                    skipped = yield "open", name, attrs
                    if not skipped:
                        done = at = after[k][1] if k < len(after) else len(page)
                    continue
            yield "open", name, attrs
    yield "text", page[done:], ""


class _Tree:
    """Open elements, by place and by name: each is opened and closed once, and none is looked for."""

    def __init__(self) -> None:
        self.root = Node("", None, 0, 0)
        self.nodes, self.stack = [self.root], [self.root]
        self.opened: dict[str, list[int]] = {}
        self.links = 0

    def open(self, name: str, start: int) -> Node:
        node = Node(name, self.stack[-1], start, len(self.nodes))
        self.opened.setdefault(name, []).append(len(self.stack))
        self.nodes.append(node)
        self.stack.append(node)
        self.links += name == "a"
        return node

    def last(self, names: list[str] | tuple[str, ...]) -> int:
        """The depth of the innermost open element of these names; 0 if there is none."""
        return max([at[-1] for n in names if (at := self.opened.get(n))], default=0)

    def close(self, depth: int, end: int) -> None:
        """Close all from this depth on."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            node.end = end
            self.opened[node.name].pop()
            self.links -= node.name == "a"


Piece = tuple[str, str, Node, bool]


def pieces(page: str, by: Weights) -> tuple[list[Piece], list[Node]]:
    """``(tag name or "", text, element, is a link)`` in page order, and all elements; a tag's element is the one it stands in."""
    out: list[Piece] = []
    tree, foreign = _Tree(), 0  # foreign: the depth of the svg or math element that it is in
    tags = _tags(page)
    said = next(tags)
    while said:
        kind, name, raw = said
        reply = None
        here = tree.stack[-1]
        if kind == "text":
            if name and not name.isspace():
                here.words += len(name.split())
                out.append(("", htmllib.unescape(name), here, tree.links > 0))
            elif name:
                out.append(("", " ", here, tree.links > 0))
        elif kind == "close":
            if at := tree.last((name,)):
                tree.close(at, len(out))
                foreign = foreign if foreign < len(tree.stack) else 0
            if not foreign:
                out.append((name, "", tree.stack[-1], False))
        else:
            closed = raw.rstrip().endswith("/")
            if name in SKIPPED and raw[:1] in ("", "/", *" \t\n\r\f"):
                reply = bool(foreign and closed)
            if name not in SKIPPED or reply or reply is None:
                if foreign and (name in BLOCK or name in BREAKS_OUT) and tree.last(("foreignobject",)) <= foreign:
                    tree.close(foreign, len(out))
                    foreign = 0
                if name in CLOSES:
                    names, stop = CLOSES[name]
                    if (at := tree.last(names)) > tree.last(stop):
                        tree.close(at, len(out))
                elif name in BLOCK and (block := tree.stack[-1].block) is not None and block.name == "p":
                    tree.close(block.depth, len(out))
                if not foreign:  # the tags inside don't count
                    out.append((name, "", tree.stack[-1], False))
                if name not in VOID and not closed:
                    node = tree.open(name, len(out))
                    if not node.out:
                        _judge(node, _attributes(raw) if raw.strip() else {}, by)
                    node.text_blocks = 1 if name == "p" else 2 if name in HEADINGS else 3 if name in ("article", "main") else 0
                    if not foreign and name in ("svg", "math"):
                        foreign = len(tree.stack) - 1
        try:
            said = tags.send(reply)
        except StopIteration:
            break
    tree.close(1, len(out))
    tree.root.end = len(out)
    _leave_out(tree.nodes)
    return out, tree.nodes


def _leave_out(nodes: list[Node]) -> None:
    """Threads of comments go; elements that weigh against content go, unless they hold more than half of their article (or four fifths of the page)."""
    if any(n.thread for n in nodes):
        _leave_out_threads(nodes)
    if not any(n.soft for n in nodes):
        return
    for n in reversed(nodes):
        if n.parent is not None and not n.out:
            n.parent.words += n.words
            n.parent.text_blocks += n.text_blocks
    for n in nodes:  # parents come first
        if n.parent is not None and n.parent.out:
            n.out = True
        elif n.soft:
            most = 2 * n.words > n.inside.words if n.inside else 5 * n.words > 4 * nodes[0].words
            n.out = not (most and (n.text_blocks > 2 or not n.strict))


def _leave_out_threads(nodes: list[Node]) -> None:
    """Elements named as comments go if they are built like them: with others of their kind beside or in them, or with forms, times or other comments; threads also after any paragraph or heading."""
    first: dict[Node | None, int] = {}
    for n in nodes:
        if n.name == "p" or n.name in HEADINGS:
            first.setdefault(n.inside, n.order)
    talk, alike = set(), Counter()
    for n in reversed(nodes):
        if n.parent is not None:
            alike[n.parent, n.kind] += 1
            if n in talk or n.thread or n.name in TALK:
                talk.add(n.parent)
    many = {parent for (parent, kind), k in alike.items() if k > 1 and kind not in ("p", "p ")}
    for n in nodes:  # parents come first
        if n.parent is not None and n.parent.out:
            n.out = True
        elif n.thread:
            n.out = n in talk or n in many or n.thread == 2 and first.get(n.inside, n.order) < n.order or alike[n.parent, n.kind] > 1


def label_counts(page: str) -> Counter:
    """``(kind, inside)`` of a page that marks one article; empty otherwise. Kinds are those of ``Weights``; words and what holds them count by word.

    What is left out by its kind doesn't count, as it scores nothing.
    """
    if len(re.findall(r"<article\b", page, re.I)) != 1:
        return Counter()
    found: Counter = Counter()
    told, nodes = pieces(page, {})
    article = next((n for n in nodes if n.name == "article"), None)
    for name, text, node, _ in told:
        if not node.out and name not in ("article", "main", "html", "body", "head"):
            found[name, node.inside is not None and node.inside is article] += 1 if name else len(text.split())
    return found


def name_counts(page: str) -> Counter:
    """``("." and a class or id, inside)`` of a page that marks one article: the words that stand in elements with it, left out or not; of all words, "." alone."""
    if len(re.findall(r"<article\b", page, re.I)) != 1:
        return Counter()
    found: Counter = Counter()
    tree, own = _Tree(), {}
    for kind, name, raw in _tags(page):
        if kind == "open" and name not in VOID:
            node = tree.open(name, 0)
            own[node] = own.get(node.parent, frozenset()) | _tokens(_attributes(raw)) if "=" in raw else own.get(node.parent, frozenset())
        elif kind == "close" and (at := tree.last((name,))):
            tree.close(at, 0)
        elif kind == "text" and (words := len(name.split())):
            for t in ("", *own.get(tree.stack[-1], ())):
                found["." + t, tree.stack[-1].inside is not None] += words
    return found


def _odds(kind: str, counts: dict[tuple[str, bool], int], inside: int, outside: int) -> float:
    return math.log((counts.get((kind, True), 0) + 0.5) / (inside + 1)) - math.log((counts.get((kind, False), 0) + 0.5) / (outside + 1))


def weights(counts: dict[tuple[str, bool], int], names: dict[tuple[str, bool], int] | None = None, pages: dict[str, int] | None = None) -> Weights:
    """Log-odds of each kind inside against outside; words at least a little positive, tags a little negative.

    ``names`` counts classes and ids by word, ``pages`` says how many labelled pages have each.
    """
    out = dict(DEFAULT)
    inside, outside = (sum(n for (_, w), n in counts.items() if w is side) for side in (True, False))
    if inside and outside:
        for k in {k for k, _ in counts}:
            v = _odds(k, counts, inside, outside)
            out[k] = max(0.2, min(1.0, v)) if k == "" else max(-6.0 if k in LEFT_OUT else -3.0, min(-0.05, v))
    names = names or {}
    for k in {k for k, _ in names} - {"."}:
        n = (pages or {}).get(k, 0)
        v = max(-3.0, min(3.0, _odds(k, names, names.get((".", True), 0), names.get((".", False), 0))))
        prior = NAMED if named_out(k[1:]) else 0.0
        out[k] = (prior * PRIOR_PAGES + v * n) / (PRIOR_PAGES + n)
        if not ADVERTS.isdisjoint(re.split("[-_:]+", k[1:])):
            out[k] = min(prior, out[k])
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the highest sum, by one scan; the first such, empty if no score is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, at = total, (start, k + 1)
    return at


def _holder(told: list[Piece], first: int, last: int) -> Node | None:
    """The innermost block that holds the words of a region."""
    held = [node for name, text, node, _ in told[first:last] if not name and not node.out and not text.isspace()]
    if not held:
        return None
    a, b = min(held, key=lambda n: n.order), max(held, key=lambda n: n.order)
    while a is not b:  # the first and the last element have the ancestors that all of them share
        if a.depth >= b.depth:
            a = a.parent  # type: ignore[assignment]
        else:
            b = b.parent  # type: ignore[assignment]
    return a.block


def main_text(page: str | None, by: Weights) -> str:
    """The page's main text."""
    if not page:
        return ""
    told, _ = pieces(page, by)
    word = by.get("", DEFAULT[""])
    counts = [0 if name or node.out else len(text.split()) for name, text, node, _ in told]
    scores = [by.get(name, UNKNOWN) if name else word * n * (0.25 if link else 1.0) for (name, _, _, link), n in zip(told, counts)]
    first, last = best_region(scores)
    if first == last:
        return ""
    upto = [0, *accumulate(counts)]
    words, holder = upto[last] - upto[first], _holder(told, first, last)
    while holder is not None and holder.name not in ("html", "body") and words >= MOST * (upto[holder.end] - upto[holder.start]):
        first, last = min(first, holder.start), max(last, holder.end)
        holder = holder.parent.block if holder.parent else None
    while first and told[first - 1][0] not in BLOCK:  # whole blocks
        first -= 1
    while last < len(told) and told[last][0] not in BLOCK:
        last += 1
    lines: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if words := "".join(line).split():
            lines.append(" ".join(words))
        line.clear()

    for name, text, node, _ in told[first:last]:
        if name in BLOCK:
            flush()
        elif name == "br":
            line.append(" ")
        elif not name and not node.out:
            line.append(text)
    flush()
    return "\n".join(lines)


def learn(pages: DataFrame, labelled: int = LABELLED, id_col: str = "page_id", html: str = "html") -> Weights:
    """Weights counted on about ``labelled`` pages, chosen by hash: of known elements, and of the classes and ids that ``LEAST_SHARE`` of them have."""
    total = pages.select(id_col).count()
    below = min(2**63 - 1, int(-(2**63) + min(1.0, labelled / max(1, total)) * 2.0**64))
    sample = pages.where(F.xxhash64(F.col(id_col), F.lit("labelled")) <= F.lit(below)).select(F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        has: Counter = Counter()
        for batch in blocks(batches, "html"):
            for page in batch.column(0).to_pylist():
                own = label_counts(page or "")
                names = name_counts(page or "")
                found.update({k: n for k, n in own.items() if k[0] in KNOWN or not k[0]})
                found.update(names)
                has.update({k for k, _ in names})
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64()), pa.array([has.pop(k, 0) for k, _ in keys], pa.int64())], ["kind", "inside", "n", "pages"])

    counted = sample.mapInArrow(run, "kind string, inside boolean, n long, pages long").groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n"))).alias("in"), F.sum(F.when(~F.col("inside"), F.col("n"))).alias("off"), F.sum("pages").alias("pages"))
    rows = counted.where((~F.startswith("kind", F.lit("."))) | (F.col("pages") >= max(3, int(LEAST_SHARE * min(labelled, total))))).collect()
    counts = {(r["kind"], side): r[c] for r in rows for side, c in ((True, "in"), (False, "off")) if r[c]}
    tags, names = ({k: n for k, n in counts.items() if k[0].startswith(".") is is_name} for is_name in (False, True))
    return weights(tags, names, {r["kind"]: r["pages"] for r in rows})


def extract(pages: DataFrame, by: Weights, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: the id, the url and ``text``."""
    rows = pages.select(id_col, url, F.col(html).alias("__page__"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__page__", 1 << 20):
            texts = [main_text(page, by) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, url, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url}` {kinds[url]}, text string")
