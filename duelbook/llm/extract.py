"""Main text of web pages by text-to-tag ratios over streamed parser events.

The standard library's parser streams tags and texts. Each block (paragraph, heading, list item, table row, part between line
breaks) is a line with its text, its number of tags and the element it stands in. A line's ratio of characters to tags is
smoothed over its neighbours with Gaussian weights; lines whose smoothed ratio is above the threshold, the mean less half a
standard deviation or half the mean, whichever is lower, form the content cluster.

What is no article text is left out first. Left out for good is what stands in an element that says so by its tag or role (menus,
headers, footers, sidebars, scripts, styles, dialogs, hidden parts) and readers' comments, also as articles of their own; headings in the header of an
article stay. Forms and elements that only a class or id marks (sidebars, notices, adverts, related links) are left out as long as what is not
marked is enough: it holds an h1, or ``LEAST`` of the characters. On a page whose wrappers bear such names it is not; then the
outermost marked element with most text is plain after all, with all of the same mark, and so on inside it until it is enough.

The content region is what the cluster selects of the rest: all plain ``article`` elements with content, or the ``main`` if most of
its content is outside of them, with a main's h1, the lines behind it and content lines beside articles, and a headline before an article without one.
Without these, or where most content is outside of them, it is everything from the first to the last content line and what shares an element with one, but for lists of nothing but links.

Every step goes over the lines or elements once (open marked elements are kept in a heap), so a page takes time in proportion to its
length, however deep it is nested. Character references are decoded, white space in a line becomes one space, lines are joined by one line end. A null, empty or
textless page gives an empty text. Pages are read whole, malformed ones as far as the parser reads them.
"""

from __future__ import annotations

import heapq
import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duelbook.llm.batches import add_columns

#: Unmarked text of this share of a page's characters is enough.
LEAST = 0.2
WEIGHTS = [math.exp(-k * k / 2) for k in range(-2, 3)]

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody
tfoot thead title tr ul""".split())
CELLS = frozenset(("td", "th"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small strike strong sub sup time tt u var".split())
NEVER = frozenset("""applet audio button canvas datalist dialog embed head iframe input math menu meter nav noframes noscript object
output progress script select style svg template textarea title video""".split())
SITE = frozenset(("header", "footer", "aside", "form", "search"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split())
#: Words of a class or id that mark what is no article text.
MARKS = frozenset("""ad ads adbox adsense adslot advert advertisement advertisements advertising adverts alert alerts banner banners breadcrumb
breadcrumbs comment commentlist comments consent cookie cookies disqus dropdown footer footnav
gdpr hidden menu menus modal nav navbar navigation newsletter notice notices notification notifications outbrain
overlay pager paginate pagination paywall popover popup promo promos promotion recommended related replies respond search share
sharebar sharing sidebar sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar tracking widget widgets""".split())
#: Those of them that mark readers' comments.
TALK = frozenset("comment commentlist comments disqus replies respond".split())
#: Words that mark a site's header, but inside an article its own head.
HEADS = frozenset(("header", "masthead"))
#: Classes that tell what an element has or has not, not what it is.
STATE = re.compile(r"(?:has|have|with|without|no|not|is-not)[-_]", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Part:
    """An open element and what its ancestors say of it.

    ``hard`` tells that it is left out for good, ``talk`` that it is readers' comments, ``head`` that only headings of it
    count; ``mark`` is the nearest marked element, ``article``, ``main`` and ``list_`` the outermost plain article, the nearest main and the
    nearest list.
    """

    __slots__ = ("tag", "above", "hard", "talk", "head", "mark", "article", "main", "list_", "title", "heading", "silent", "links")

    def __init__(self, tag: str, above: Part | None):
        self.tag, self.above, self.links = tag, above, True
        for name in ("hard", "talk", "head", "mark", "article", "main", "list_", "title", "heading", "silent"):
            setattr(self, name, getattr(above, name) if above else None)


class Mark:
    """A marked element: the characters of the lines that it is the nearest marked element of, and of all lines in it."""

    __slots__ = ("name", "above", "inner", "direct", "lines", "size", "plain")

    def __init__(self, name: str, above: Mark | None):
        self.name, self.above, self.inner, self.direct, self.lines, self.size, self.plain = name, above, [], 0, [], 0, False


def mark_of(attributes: list[tuple[str, str | None]]) -> str | None:
    head = None
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "role"
        if not value:
            continue
        if name in ("class", "id"):
            words = {w.lower() for x in value.split() if not STATE.match(x) for w in WORDS.findall(x)}
            if words & TALK:
                return "talk"
            if words & MARKS:
                return "mark"
            if words & HEADS:
                head = "head"
        elif name == "role":
            if value.strip().lower() in ROLES:
                return "role"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "role"
    return head


def aside_article(attributes: list[tuple[str, str | None]]) -> bool:
    """A class or id that begins with one of these makes an article a comment, a pointer to another one, or an advert."""
    names = [x for n, v in attributes if v and n in ("class", "id") for x in v.split()]
    return any((w := WORDS.match(x)) and w[0].lower() in ("comment", "comments", "related", "recommended", "ad", "ads", "promo", "sponsored") for x in names)


class Lines(HTMLParser):
    """Collects lines: (text, tags, innermost element, inside a link only)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Part("", None)
        self.open: dict[str, int] = {}
        self.lines: list[tuple[str, int, Part, bool]] = []
        self.marks: list[Mark] = []
        self.held: list[str] = []
        self.filled = False
        self.tags, self.links, self.outside = 0, 0, False

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.lines.append((text, self.tags, self.at, not self.outside))
            self.tags = 0
        self.held, self.filled, self.outside = [], False, False

    def push(self, tag: str, kind: str | None, name: str = "") -> None:
        """Opens an element; ``kind`` says why it is left out."""
        part = Part(tag, self.top)
        self.top = part
        self.open[tag] = self.open.get(tag, 0) + 1
        own = part.article or part.main
        if tag in ("article", "main") and kind is None:
            # a header or menu that is still open here was not closed
            if part.hard == "open":
                part.hard = None
            part.head = None
            if tag == "main":
                part.main = part
            elif part.article is None:
                part.article = part
        if kind == "tag":
            part.hard = part.silent = True
        elif kind == "role" or kind == "site" and tag not in ("form", "header"):
            part.hard = part.hard or ("open" if tag == "nav" else True)
        elif kind == "talk":
            part.talk = True
        elif tag == "header":
            if own:
                part.head = True
            else:
                part.hard = part.hard or "open"
        elif kind == "mark" or tag == "form" or kind == "head" and not own:
            part.mark = Mark(name, part.mark)
            self.marks.append(part.mark)
        if kind and tag not in BREAKS:
            # inside a line there is no line of its own to leave out: its text is not taken
            part.silent = True
        if tag in HEADINGS:
            part.heading = True
            part.title = part.title or tag == "h1"
        if tag in ("ul", "ol"):
            part.list_ = part

    def pop(self) -> None:
        self.open[self.top.tag] -= 1
        self.top = self.top.above

    def close_to(self, tag: str) -> None:
        if self.open.get(tag):
            while self.top.tag != tag:
                self.pop()
            self.pop()

    def handle_starttag(self, tag, attributes):
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag in BREAKS:
            self.flush()
            if self.top.tag == "p" or tag == "li" and self.top.tag == "li":
                self.pop()
        elif tag in CELLS:
            self.held.append(" ")
        if tag in VOID:
            return
        if tag == "body" or tag == "html":
            while self.top.tag == "head":
                self.pop()
            return
        wrong = mark_of(attributes) if attributes and tag != "main" and tag not in INLINE else None
        name = " ".join(f"{n}={v}" for n, v in attributes if n in ("class", "id")) if wrong else tag
        if tag == "article":
            self.push(tag, "talk" if wrong == "talk" else "mark" if wrong and aside_article(attributes) else None, name)
        elif tag == "main":
            self.push(tag, None)
        elif tag in NEVER or tag == "nav":
            self.push(tag, "site" if tag == "nav" else "tag")
        elif tag in SITE:
            self.push(tag, "talk" if wrong == "talk" else "site", name)
        elif wrong or tag in HEADINGS or tag in BREAKS and tag not in ("br", "hr"):
            self.push(tag, wrong, name)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BREAKS:
            self.flush()
        elif tag in CELLS:
            self.held.append(" ")
        if tag not in INLINE and tag not in VOID:
            self.close_to(tag)

    def handle_data(self, data):
        if self.top.silent:
            return
        if not data.isspace():
            if not self.filled:
                self.at, self.filled = self.top, True
            if not self.links:
                self.outside = True
        self.held.append(data)


def content(lines: list[tuple[str, int, Part, bool]]) -> list[bool]:
    """The lines of the content cluster."""
    ratios = [len(text) / max(1, tags) for text, tags, _, _ in lines]
    smooth = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for k, w in enumerate(WEIGHTS, -2):
            if 0 <= i + k < len(ratios):
                total += w * ratios[i + k]
                weight += w
        smooth.append(total / weight)
    mean = sum(smooth) / len(smooth)
    limit = mean - max(math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth)), mean) / 2
    return [s >= limit for s in smooth]


def unmarked(parser: Lines) -> list[bool]:
    """The lines that are neither left out for good nor by a mark that holds."""
    lines = parser.lines
    open_ = [not (p.hard or p.head and not p.heading) for _, _, p, _ in lines]
    if any(ok and not line[2].talk for ok, line in zip(open_, lines)):
        open_ = [ok and not line[2].talk for ok, line in zip(open_, lines)]
    kept, size, titled, total = [False] * len(lines), 0, False, 0
    for i, (text, _, part, link) in enumerate(lines):
        if not open_[i]:
            continue
        weight = 0 if link else len(text)
        total += weight
        if part.mark is None:
            kept[i] = True
            size += weight
            titled = titled or bool(part.title)
        else:
            part.mark.direct += weight
            part.mark.lines.append(i)
    outer: dict[str, list[Mark]] = {}
    for mark in reversed(parser.marks):  # inner ones first
        mark.size += mark.direct
        if mark.above is not None:
            mark.above.size += mark.size
            mark.above.inner.append(mark)
    heap: list[tuple[int, int, Mark]] = []

    named: set[str] = set()
    for k, mark in enumerate(parser.marks):
        if mark.above is None and mark.size:
            heapq.heappush(heap, (-mark.size, k, mark))
            outer.setdefault(mark.name, []).append(mark)
    order = len(parser.marks)
    while heap and not titled and size < LEAST * total:
        largest = heapq.heappop(heap)[2]
        # all outermost elements of that mark are plain; what is marked inside them comes next
        plain = [largest] if largest.plain else outer.pop(largest.name, [])
        while plain:
            mark = plain.pop()
            if mark.plain:
                continue
            mark.plain = True
            named.add(mark.name)
            size += mark.direct
            for i in mark.lines:
                kept[i] = True
                titled = titled or bool(lines[i][2].title)
            for inner in mark.inner:
                if not inner.size and not inner.lines:
                    continue
                if inner.name in named:
                    plain.append(inner)
                else:
                    order += 1
                    heapq.heappush(heap, (-inner.size, order, inner))
                    outer.setdefault(inner.name, []).append(inner)
    return kept


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    plain = unmarked(parser)
    good = [g and p and not line[3] for g, p, line in zip(content(lines), plain, lines)]
    if not any(good):
        good = [p and not line[3] for p, line in zip(plain, lines)]
    size: dict[Part, int] = {}
    spread: dict[Part, int] = {}
    outside = inside = 0
    for (text, _, part, _), is_good in zip(lines, good):
        if is_good:
            if part.article is None and part.main is None:
                outside += len(text)
            else:
                inside += len(text)
                for element in (part.article, part.main):
                    if element is not None:
                        size[element] = size.get(element, 0) + len(text)
                if part.main is not None and part.article is not None:
                    spread[part.main] = spread.get(part.main, 0) + len(text)
    if inside and outside <= 2 * inside:
        mains = {element for element in size if element.tag == "main" and size[element] > 2 * spread.get(element, 0)}
        region = [ok and (line[2].article in size or line[2].main in mains) for ok, line in zip(plain, lines)]
        titled = any(r and line[2].title for r, line in zip(region, lines))
        kept, headed = [], None
        for (text, _, part, link), ok, own, is_good in zip(lines, plain, region, good):
            if own:
                headed = None
                kept.append(text)
            elif ok:
                # a headline before the region, the lines from it to the article, and content beside the articles of a main
                if part.title and not kept and not titled:
                    headed = part.main or part
                if part.title and headed is not None or part.main is not None and (part.title or is_good or headed is part.main and not link):
                    kept.append(text)
        return "\n".join(kept)
    places = [i for i, is_good in enumerate(good) if is_good]
    if not places:
        return ""
    beside = {lines[i][2].above for i in places}
    kept = [i for i, (_, _, part, link) in enumerate(lines) if plain[i] and (
        places[0] <= i <= places[-1] or part.title or not link and part.above in beside and part.above is not None)]
    for i in kept:
        if not lines[i][3]:
            element = lines[i][2].list_
            while element is not None and element.links:  # each list is told once that it holds more than links
                element.links = False
                element = element.above.list_ if element.above else None
    return "\n".join(lines[i][0] for i in kept if not (lines[i][2].list_ and lines[i][2].list_.links))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars``, its code points; input columns of these names are replaced."""
    def start():
        def work(texts):
            found = [main_text(t.decode("utf-8", "replace")) if t else "" for t in texts]
            return [found, [len(t) for t in found]]
        return work

    return add_columns(pages, html, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], start)
