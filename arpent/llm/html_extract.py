"""Main text of web pages by tree scoring.

A page is read into elements and text runs; runs that no block element parts are one block. Elements
that are boilerplate by their tag, role or class (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, reader comments) are out with all they hold. Each block that is left earns a point,
one more for each comma and up to three for its length; its container gets them whole, the next
ancestors a half, a sixth, a ninth and so on. A container's points are discounted by its link density.
The best container wins, widened to the `article` it lies in; siblings that come near it, and
paragraphs and headings beside it, are kept with it. Inside, lists and boxes of links are left out.

A boilerplate class can also stand on an element around the article (`has-sidebar`); such an element
is kept if it holds an article, or a title or several paragraphs with over half of the page's text
outside of comments. In the header of an article the headings are kept.

One page is one row of an Arrow batch and nothing is shuffled; pages are read whole, whatever their
length. Defined results: null and empty html, and pages without main text, give ''; repeated rows
each have a result; text that ends in the middle of a tag or element is read as far as it goes; white
space is what `str.split` takes for it, no-break spaces included, and `br` is white space; all other
columns stay, and one named like a new column is replaced.
"""
from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NEVER = frozenset("head title script style noscript template iframe object svg canvas audio video button select textarea input nav footer aside dialog menu".split())
_INSIDE = frozenset("p li ul ol dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption center hr address details summary".split()) | _HEADINGS  # hold text, are no containers of an article
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_COMMENTS = frozenset("comment comments commentlist commentbox commentform disqus respond reply replies discussion talkback responses".split())
_UNLIKELY = re.compile(r"(?:ads?|ad(?:slot|box|unit|block|container|wrap|wrapper|banner|sense)s?|adsby\w*|adverts?|advertis\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|notification\w*|alerts?|popup|modal|overlay|sidebar\w*|rail|nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|pager|footer|foot|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|newsletter\w*|subscribe|subscription|signup|login|search|searchform|widgets?|skip|copyright|form)")
_CUT_TAG = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
_TOKEN = re.compile(r"[a-z]+|[A-Z]+[a-z]*")


class _Page(HTMLParser):
    """Elements in page order, by columns: parent, tag and kind; and text runs (element, block, text, linked)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.kind = [-1], ["html"], [""]
        self.runs: list[tuple[int, int, str, bool]] = []
        self.open, self.held, self.block, self.links = [0], Counter(), 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.runs.append((self.open[-1], self.block, " ", False))
        if tag in _VOID:
            self.block += tag not in _INLINE
            return
        if tag == "html" or tag == "body" and self.held["body"]:
            return
        if tag not in _INLINE:
            self.block += 1
            self._close("p", ("table", "td", "th", "button", "object", "caption"))
        for last in _CLOSED_BY.get(tag, ()):
            self._close(last, _FENCE[tag])
        if tag == "a":
            self._close("a", ("td", "th", "table", "article", "section", "div", "body"))
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.kind.append(_kind(tag, {k: v or "" for k, v in attrs}))
        self.open.append(len(self.tag) - 1)
        self.held[tag] += 1
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash at the end means nothing in HTML

    def handle_endtag(self, tag):
        if tag not in _VOID:
            self.block += tag not in _INLINE
            self._close(tag, ("td", "th", "table") if tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th") else ("table",) if tag != "table" else ())

    def _close(self, tag, fence):
        """Ends the innermost open `tag`, and what is open inside, but nothing beyond an element of `fence`."""
        for k in range(len(self.open) - 1, 0, -1) if self.held[tag] > 0 else ():
            name = self.tag[self.open[k]]
            if name == tag:
                self.links -= sum(self.tag[x] == "a" for x in self.open[k:])
                self.held.subtract(self.tag[x] for x in self.open[k:])
                del self.open[k:]
                return
            if name in fence:
                return

    def handle_data(self, data):
        self.runs.append((self.open[-1], self.block, data, self.links > 0))


def _kind(tag: str, attrs: dict[str, str]) -> str:
    """`never`, `comments`, `unlikely`, `header` or nothing."""
    if tag in _NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return "never"
    if tag in ("body", "main") or attrs.get("role") in ("main", "article"):
        return ""
    words = [w.lower() for w in _TOKEN.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")]
    if not _COMMENTS.isdisjoint(words):
        return "comments"
    if tag == "article":
        return ""
    if tag == "form" or attrs.get("role") in _ROLES or any(_UNLIKELY.fullmatch(w) for w in words):
        return "unlikely"
    return "header" if tag == "header" or "header" in words and tag not in _HEADINGS else ""


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def main_text(html: str | None) -> str:
    """The main text of one page, a block to a line."""
    if not html:
        return ""
    page = _Page()
    page.feed(_CUT_TAG.sub("", html))
    page.close()
    parent, tag, kind, size = page.parent, page.tag, page.kind, len(page.tag)

    def summed(own: list) -> list:
        for k in range(size - 1, 0, -1):  # children come after their parents
            own[parent[k]] += own[k]
        return own

    def below(marked, start=False) -> list[bool]:
        """Which elements are marked or lie in one that is."""
        found = [start] * size
        for k in range(size):
            found[k] = bool(marked(k) or (k and found[parent[k]]))
        return found

    talk = below(lambda k: kind[k] == "comments")
    sizes = [0] * size
    for at, _, text, linked in page.runs:
        if not linked and not talk[at]:
            sizes[at] += len(_squeezed(text))
    outside = below(lambda k: kind[k] == "never")
    sizes = summed([0 if outside[k] else n for k, n in enumerate(sizes)])
    articles = summed([int(tag[k] in ("article", "main") and not talk[k]) for k in range(size)])
    titles = summed([int(tag[k] == "h1") for k in range(size)])
    paragraphs = summed([int(tag[k] == "p") for k in range(size)])
    within = below(lambda k: tag[k] in ("article", "main"))

    def dropped(k: int) -> bool:
        if kind[k] == "comments":
            return not titles[k]
        if kind[k] in ("unlikely", "header") and (articles[k] or 2 * sizes[k] > sizes[0] and (titles[k] or paragraphs[k] > 2 or tag[k] == "form")):
            return False
        inner = k and kind[parent[k]] == "header" and within[parent[k]] and tag[k] not in _HEADINGS and not titles[k]
        return kind[k] in ("never", "unlikely") or kind[k] == "header" and not within[k] or bool(inner)

    gone = below(dropped)
    header = [kind[k] == "header" and within[k] and 2 * sizes[k] <= sizes[0] for k in range(size)]
    blocks: dict[int, list] = {}  # block: [element, texts, linked characters]; the element is that of the first text
    for at, block, text, linked in page.runs:
        if not gone[at] and not header[at]:
            b = blocks.setdefault(block, [-1, [], 0])
            if b[0] < 0 and not text.isspace():
                b[0] = at
            b[1].append(text)
            b[2] += len(text.strip()) if linked else 0
    whole = [(at, _squeezed("".join(parts)), linked) for at, parts, linked in blocks.values() if at >= 0]
    whole = [b for b in whole if b[1]]
    if not whole:
        return ""

    points, chars, linked_chars, n_links = [0.0] * size, [0] * size, [0] * size, [0] * size
    for k in range(size):
        n_links[k] = int(tag[k] == "a" and not gone[k])
    for at, text, linked in whole:
        chars[at] += len(text)
        linked_chars[at] += linked
        k, level = at, 0
        while k and (tag[k] in _INSIDE or tag[k] in _INLINE):
            k = parent[k]
        value = 1 + text.count(",") + min(len(text) / 100, 3)
        while k >= 0 and level < 6:
            points[k] += value / (1, 2, 6, 9, 12, 15)[level]
            k, level = parent[k], level + 1
    chars, linked_chars, n_links = summed(chars), summed(linked_chars), summed(n_links)
    density = [min(1.0, b / max(a, 1)) for a, b in zip(chars, linked_chars, strict=True)]
    score = [p * (1 - d) for p, d in zip(points, density, strict=True)]
    inside = below(lambda k: tag[k] in ("article", "main") and chars[k])
    candidates = [k for k in range(size) if inside[k] and chars[k]] or range(size)
    best = max(candidates, key=lambda k: (score[k], -k))
    k = best
    while k and tag[k] != "article":
        k = parent[k]
    best = k or best

    def beside(k: int) -> bool:
        if tag[best] == "article" or tag[k] == "article":
            return tag[k] == tag[best] and score[k] >= 0.2 * score[best]
        if tag[k] in _INSIDE:
            return density[k] < 0.5 and (chars[k] >= 25 or tag[k] in _HEADINGS)
        return score[k] >= 0.2 * score[best]

    around = [k for k in range(size) if best and k and parent[k] == parent[best] and chars[k]]
    chosen = {best} | {k for k in around if k != best and beside(k)}
    last = max(k for k in chosen if tag[k] not in _HEADINGS or k == best)
    chosen = {k for k in chosen if tag[k] not in _HEADINGS or k <= last}  # a heading at the end heads something else
    boxed = below(lambda k: k not in chosen and n_links[k] >= 3 and density[k] > 0.6 and tag[k] in ("ul", "ol", "dl", "div", "section", "table"))
    kept = below(lambda k: k in chosen)
    return "\n".join(text for at, text, _ in whole if kept[at] and not boxed[at])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` without the html, with `text` and `n_chars`."""
    others = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    names = [f"c{k}" for k in range(len(others))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(len(names)).to_pylist()]
        arrays = [batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    plain = [F.col(f"`{f.name.replace('`', '``')}`").alias(c) for f, c in zip(others, names, strict=True)]
    schema = ", ".join([f"{c} {f.dataType.simpleString()}" for f, c in zip(others, names, strict=True)] + ["text string", "n_chars long"])
    return map_columns(pages.select(*plain, F.col(html_col)), run, schema, rows=64).toDF(*(f.name for f in others), "text", "n_chars")
