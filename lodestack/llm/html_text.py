"""HTML extraction by composite text density.

For every element: characters, tags, link characters and link tags below it give its link-adjusted characters per tag;
an element's sum adds those of its children. The element with the greatest sum is the main text; the least density on
its path from body is the threshold for others, each of which adds its own subtree with the greatest sum. A class or id
that names boilerplate lowers an element's density, and leaves it out unless the main text is found in it all the same.
Siblings of the main text in an article's own element, and sections beside it that hold sentences, go with it.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of elements.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Never main text. What an element of FADED holds is, only if the main text itself is in it.
DROPPED = {"nav", "footer", "aside", "head", "button", "select", "svg", "menu", "object", "canvas"}
FADED = {"form", "dialog"}
CLOSED_BY = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": BLOCKS}
CLOSES = {name: [tag for tag, by in CLOSED_BY.items() if name in by] for name in BLOCKS | {"option"}}
FENCES = {"article", "section", "div", "table", "td", "ul", "ol", "dl", "body", "html", "main", "blockquote"}
#: Elements whose class and id are not asked: density decides.
PLAIN = {"article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "body"}
#: Words of boilerplate: those that name it wherever they stand between hyphens or underscores, and those that do at a name's end only.
ANYWHERE = r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|sidebars?|comments?|commentlist|comment\w*|respond|responses?|replies|discussion|disqus|newsletters?|popups?|modal|footer|topbar|navbar|nav|breadcrumbs?|related[_-](?:posts?|articles?|links?|stories|content|items?|news|products?|box)|(?:share|sharing)[_-](?:buttons?|bar|box|links?|icons?|tools?|this)|social|subscribe|pagination|banner|masthead|header[_-](?:top|bar|menu)|top[_-]header"
AT_END = r"related|share|sharing|notices?|alert|side|menu|navigation|header|signup|login|widget|toolbar"
BOILERPLATE = re.compile(rf"(?:^|[\s_-])(?:{AT_END}|{ANYWHERE})(?=$|\s)", re.I)
PARTLY = re.compile(rf"(?:^|[\s_-])(?:{ANYWHERE})(?=[\s_-]|$)", re.I)
#: Names of an article's own text; beside one of these, words inside other names say nothing.
CONTENT = re.compile(r"(?:^|\s)(?:(?:entry|post|article|story|main|page|site)[_-]?(?:content|body|text)|content|main|article|hentry)(?=$|\s)", re.I)
#: Class words that only speak of boilerplate elsewhere, and those of an article's own heading.
SPOKEN = re.compile(r"(?:^|(?<=\s))(?:\S*[_-])?(?:has|no|with|without|hide|show)[_-]\S+|(?:^|(?<=\s))(?:entry|post|article|story|content)[_-]+header(?=$|\s)", re.I)
SENTENCE = re.compile(r"\w[.!?\u2026\u3002][\"'\u201d\u00bb)]*(?:\s|$)")
LEAST_PROSE = 120  # characters without links that make an element named as boilerplate the main text, where a page has no other
PROSE = 0.7  # share of characters outside of links that a sibling of the main text has
FADE = 0.05  # what counts of the density of an element that is named as boilerplate
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("chars", "density", "faded", "kids", "link_chars", "link_tags", "sum", "tag", "tags", "up")

    def __init__(self, tag: str, up: Node | None, faded: str = ""):
        self.tag, self.up, self.kids, self.faded = tag, up, [], faded
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


class _Open:
    """The open elements, with their number by tag, in all and since the last fence: so an end tag without a start is passed over at once."""

    def __init__(self) -> None:
        self.top = self.at = Node("html", None)
        self.all: Counter = Counter(html=1)
        self.since: list[Counter] = [Counter()]

    def push(self, node: Node) -> None:
        self.at = node
        self.all[node.tag] += 1
        self.since[-1][node.tag] += 1
        if node.tag in FENCES:
            self.since.append(Counter())

    def pop_to(self, node: Node) -> None:
        while self.at is not node:
            x = self.at
            if x.tag in FENCES:
                self.since.pop()
            self.all[x.tag] -= 1
            self.since[-1][x.tag] -= 1
            self.at = x.up

    def end(self, name: str) -> None:
        """An end tag; one of no block does not reach beyond a fence."""
        block = name in BLOCKS or name in DROPPED or name in FADED
        if not (self.all if block else self.since[-1])[name]:
            return
        x = self.at
        while x.tag != name:
            x = x.up
        if x.up is not None:
            self.pop_to(x.up)

    def imply_ends(self, name: str) -> None:
        """Closes what a start tag of this name ends without an end tag."""
        ended = CLOSES.get(name, ())
        while any(self.since[-1][tag] for tag in ended) or (self.at.up is not None and self.at.tag in ended):
            x = self.at
            while x.tag not in ended:
                x = x.up
            self.pop_to(x.up)


class _Tags:
    """Markup of a page, one after the other, in time that grows with its length: where a tag ends is worked out from the page's end for all quotes at once."""

    def __init__(self, source: str) -> None:
        self.source = source
        marks = [(m.start(), m[0]) for m in re.finditer("[\"'>]", source)]
        self.places = [at for at, _ in marks]
        self.ends = [-1] * (len(marks) + 1)  # of a tag that goes on at this quote or bracket; -1: it never ends
        following = {'"': len(marks), "'": len(marks)}
        for k in range(len(marks) - 1, -1, -1):
            at, kind = marks[k]
            if kind == ">":
                self.ends[k] = at
            else:
                other = following[kind]
                self.ends[k] = self.ends[other + 1] if other < len(marks) else -1
                following[kind] = k
        self.cdata = source.rfind("]]>")
        self.bracket = source.rfind(">")

    def next(self, place: int) -> tuple[int, int, str, str]:
        """(start, end, name, attributes) of the first markup from place on; name is empty for comments and the like, with a slash for end tags; start is -1 where there is none."""
        source = self.source
        while (at := source.find("<", place)) >= 0:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(source), "", ""
            if source.startswith("<![CDATA[", at) and at + 9 <= self.cdata:
                return at, source.find("]]>", at + 9) + 3, "", ""
            if at > self.bracket:
                break
            if source[at + 1 : at + 2] in ("!", "?"):
                return at, source.find(">", at + 2) + 1, "", ""
            if m := _NAME.match(source, at + 1):
                end = self.ends[bisect_left(self.places, m.end())]
                if end >= 0:
                    return at, end + 1, m[0], source[m.end() : end]
                end = source.find(">", m.end())
                if end >= 0:
                    return at, end + 1, m[0], ""
            place = at + 1
        at = source.find("<!--", place)
        return (at, len(source), "", "") if at >= 0 else (-1, len(source), "", "")


def _named(marks: str) -> bool:
    """Whether an element's class, id and role name boilerplate."""
    marks = SPOKEN.sub("", marks)
    return bool(BOILERPLATE.search(marks)) or (bool(PARTLY.search(marks)) and not CONTENT.search(marks))


def parse(source: str) -> Node:
    """The tree of elements and texts below html; dropped elements are left out, with all they hold: their parents don't list them."""
    state, tags = _Open(), _Tags(source)
    top, place = state.top, 0
    while place < len(source):
        start, end, name, attributes = tags.next(place)
        text = source[place : start if start >= 0 else len(source)]
        if text:
            state.at.kids.append(html.unescape(text))
        if start < 0:
            break
        place, name = end, name.lower()
        if not name:
            continue
        if name[0] == "/":
            state.end(name[1:])
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, place)
            place = end.end() if end else len(source)
            continue
        if name in ("html", "body") or name in VOID:
            if name in ("br", "hr", "wbr", "img"):
                state.at.kids.append(" " if name != "hr" else Node("hr", state.at))
            elif name == "body" and (state.at is top or state.at.tag == "head"):
                state.pop_to(top)
                new = Node("body", top)
                top.kids.append(new)
                state.push(new)
            continue
        state.imply_ends(name)
        named = name in BLOCKS and name not in PLAIN and _named(" ".join(filter(None, (v for g in _MARK.findall(attributes) for v in g))))
        new = Node(name, state.at, "named" if named else "kind" if name in FADED else "")
        if not (name in DROPPED or (name == "header" and not state.all["article"])):
            state.at.kids.append(new)
        if not attributes.endswith("/"):
            state.push(new)
    return top


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.up


def _measure(top: Node) -> list[Node]:
    """Fills in counts, densities and sums; returns all elements in page order."""
    order, stack = [], [top]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [k for k in reversed(x.kids) if isinstance(k, Node)]
    for x in reversed(order):
        own = sum(len("".join(k.split())) for k in x.kids if isinstance(k, str))
        kids = [k for k in x.kids if isinstance(k, Node)]
        part = [FADE if k.faded else 1 for k in kids]
        x.chars = own + sum(k.chars * f for k, f in zip(kids, part, strict=True))
        x.tags = sum((1 + k.tags) * f for k, f in zip(kids, part, strict=True))
        x.link_chars = x.chars if x.tag == "a" else sum(k.link_chars * f for k, f in zip(kids, part, strict=True))
        x.link_tags = (x.tag == "a") + sum(k.link_tags * f for k, f in zip(kids, part, strict=True))
    body = next((x for x in order if x.tag == "body"), top)
    ratio = body.link_chars / max(1, body.chars)
    for x in reversed(order):
        c, lc, t, lt = x.chars, x.link_chars, max(1, x.tags), max(1, x.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            x.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1e-9) / max(1e-9, math.log(base + 1)) if lc else c / t
    held = {id(top): FADE if top.faded else 1.0}  # what counts of each element, for itself and the faded ones around it
    for x in order:
        for k in x.kids:
            if isinstance(k, Node):
                held[id(k)] = FADE if k.faded else held[id(x)]
        x.density *= held[id(x)]
    for x in order:
        x.sum = sum(k.density for k in x.kids if isinstance(k, Node) and not k.faded) + held[id(x)] * sum(len("".join(k.split())) for k in x.kids if isinstance(k, str))
    return order


def _blocks(node: Node, chosen: set[int], open_: set[int]) -> list[str]:
    """Texts of the chosen elements' blocks in page order; of faded ones only those of open_, which the main text is in."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    stack: list = [(node, id(node) in chosen)]
    while stack:
        x, inside = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if inside:
                line.append(x)
        elif not x.faded or id(x) in open_:
            inside = inside or id(x) in chosen
            if x.tag in BLOCKS:
                end()
                stack.append((None, False))
            stack += [(k, inside) for k in reversed(x.kids)]
    end()
    return out


def main_text(source: str | None) -> str:
    """The page's main text, a block a line; null, empty and textless pages give an empty string."""
    top = parse(source or "")
    order = _measure(top)
    if not top.chars:
        return ""
    bodies = [x for x in order if x.tag == "body"]
    best = max((x for x in order if x is not top or not bodies), key=lambda x: x.sum)  # of equals the outermost
    open_ = {id(x) for x in _path(best)}
    if any(x.faded == "named" for x in _path(best)) and max((_longest(x) for x in order if x is best or x.up is best), default=0) < LEAST_PROSE:
        return ""  # nothing on the page but what is named as boilerplate
    if any(x.faded == "kind" for x in _path(best)) and not any(SENTENCE.search(x) for x in _texts(best)):
        return ""  # labels of a form
    threshold = min(x.density for x in _path(best) if x.tag != "html" or x is best)
    chosen = {id(best)}
    greatest: dict[int, Node] = {}
    for x in reversed(order):
        below = [greatest[id(k)] for k in x.kids if isinstance(k, Node)]
        greatest[id(x)] = max([x, *below], key=lambda y: y.sum)
    for x in order:
        if x.density >= threshold and x.chars and x is not top:
            chosen.add(id(greatest[id(x)]))
    chosen |= {id(x) for x in (best.up.kids if best.up else ()) if isinstance(x, Node) and _goes_with(x, best)}
    return "\n".join(_blocks(top, chosen, open_))


def _texts(node: Node) -> Iterator[str]:
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        else:
            stack += x.kids


def _goes_with(x: Node, best: Node) -> bool:
    """Whether a sibling of the main text is part of the article: it is no boilerplate, its text is not in links, and it is in the article's own element or a section that holds sentences."""
    if x.faded or not x.chars or _longest(x) < PROSE * x.chars:
        return False
    return x.up.tag in ("main", "article") or (x.tag == best.tag == "section" and any(SENTENCE.search(t) for t in _texts(x)))


def _longest(node: Node) -> int:
    """Characters of the element without those in links."""
    return node.chars - node.link_chars


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, whole pages, nothing capped.

    Null html is an empty page; an empty page has an empty text. Markup that is never closed ends with its parent. Rows
    are independent of each other: repeated ones give equal results, and an empty table an empty one.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for i in range(0, len(x), 500):
                part = x.iloc[i : i + 500]
                yield pd.DataFrame({"id": part["id"].astype("Int64"), "url": part["url"], "text": [main_text(h) for h in part["html"]]})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    made = rows.mapInPandas(each, "id long, url string, text string")
    return made.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
