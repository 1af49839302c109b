"""Operator 1: main text of web pages by tree scoring."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through_pandas

#: Comments (also the bogus ones of `<!`, `<?` and `</` without a name), and tags with name and attributes. As in browsers a
#: quote begins a value only behind an equals sign and is an ordinary character elsewhere; a tag that isn't closed ends where
#: the next one begins. Nothing is ever read twice, so any page takes linear time.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?]|/[^a-zA-Z>])[^>]*+(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|(?=<)|\Z)", re.S)
#: Words that name a part of the page in class, id or role attributes.
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = RAW | {"head", "nav", "header", "footer", "aside", "button", "select", "option", "input", "template", "svg", "math", "canvas", "object", "dialog", "menu", "label", "audio", "video"}
#: Of a page these may be any part, also the frame of all of it: their points decide, as those of unlikely names do.
FRAMES = {"form", "fieldset"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What an opening tag closes, up to the nearest of the tags behind it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
UNLIKELY = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "promoted", "sidebar", "side", "aside", "widget", "widgets",
    "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "outbrain", "taboola", "breadcrumb", "breadcrumbs",
    "menu", "nav", "navbar", "navigation", "pagination", "pager", "toolbar", "footer", "header", "masthead", "topbar", "search", "complementary", "contentinfo", "legal", "disclaimer", "skip", "tags",
}
#: Of these, words that also name parts of an article: they say nothing beside a word of LIKELY.
WEAK = {"header", "masthead", "banner", "side", "widget", "widgets", "notice", "notices", "alert", "legal", "disclaimer", "search", "tags"}
LIKELY = {"article", "content", "main", "post", "entry", "story", "body", "text"}
#: Words of reader comments, which may be longer than the article.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
#: Beside these, a word of COMMENTS tells a state of the page ("comments-open", "no-reply") and not what the element holds.
STATES = {"no", "not", "has", "with", "without", "open", "opened", "close", "closed", "on", "off", "enabled", "disabled", "allowed", "count", "link", "links"}
#: An element with a word of UNLIKELY is the article all the same if it has this share of the page's points.
ARTICLE_SHARE = 0.5
#: Characters of own text that make an element a paragraph.
SCORED_FROM = 3
SIBLING_SHARE = 0.2
#: Lists of links within the article: elements of these tags with so many links at least, which hold this share of their text.
LISTS, LEAST_LINKS, LINK_SHARE = {"ul", "ol", "dl", "div", "section", "table"}, 3, 0.9


def _names(attributes: str) -> list[set[str]]:
    """The words of each name in class, id and role."""
    return [set(re.split(r"[^a-z0-9]+", name)) for m in NAMES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").lower().split()]


def _unlikely(names: set[str]) -> bool:
    return bool(names & UNLIKELY - (WEAK if names & LIKELY else set()))


class Page:
    """The element tree of a page: tag, parent, whether it is dropped or unlikely, and the text runs in page order."""

    def __init__(self, source: str, comments: bool = True):
        """comments: whether an element that is named like reader comments is dropped, whatever its points."""
        self.comments, self.commented = comments, False
        self.tags, self.parent, self.out, self.unlikely = ["#root"], [0], [False], [False]
        self.runs: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        self._read(source)

    def _push(self, stack: list[int], tag: str, attributes: str) -> None:
        up = stack[-1]
        named = _names(attributes) if attributes and tag not in ("html", "body", "article", "main") else []
        names = set().union(*named)
        comments = any(words & COMMENTS and not words & STATES for words in named)
        self.commented |= comments
        self.tags.append(tag)
        self.parent.append(up)
        self.out.append(self.out[up] or tag in DROPPED or comments and self.comments or (bool(attributes) and tag not in ("html", "body", "article", "main") and bool(HIDDEN.search(attributes))))
        self.unlikely.append(_unlikely(names) or tag in FRAMES)
        stack.append(len(self.tags) - 1)

    def _read(self, source: str) -> None:
        stack, at, size, low = [0], 0, len(source), None
        tags, runs = self.tags, self.runs
        at_: defaultdict[str, list[int]] = defaultdict(list)  # places of each tag on the stack, and of all blocks
        blocks: list[int] = []

        def close(k: int) -> None:
            for i in stack[k:]:
                at_[tags[i]].pop()
            del stack[k:]
            while blocks and blocks[-1] >= k:
                blocks.pop()

        while at < size:
            m = TOKEN.search(source, at)
            if m is None or m.start() > at:
                end = size if m is None else m.start()
                text = source[at:end]
                if not self.out[stack[-1]]:
                    runs.append((stack[-1], entities.unescape(text) if "&" in text else text))
                if m is None:
                    break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if at_[tag]:
                    k = at_[tag][-1]
                    if tag in BLOCKS:
                        runs.append((self.parent[stack[k]], None))
                    elif blocks and blocks[-1] > k:
                        continue  # an inline end tag doesn't close blocks
                    close(k)
                continue
            if tag in BLOCKS:
                runs.append((stack[-1], None))
                if blocks and tags[stack[blocks[-1]]] == "p":
                    close(blocks[-1])
            if tag in CLOSES:
                closed, within = CLOSES[tag]
                edge = max((at_[t][-1] for t in within if at_[t]), default=0)
                above = [k for t in closed if at_[t] and (k := at_[t][-1]) > edge]
                if above and tag == "tr":
                    above = [at_[t][bisect_right(at_[t], edge)] for t in closed if at_[t] and at_[t][-1] > edge]
                    close(min(above))
                elif above:
                    close(max(above))
            if tag in VOID:
                if tag in ("br", "hr"):
                    runs.append((stack[-1], None))
                continue
            if tag == "body":  # whatever is open belongs to the head
                close(1)
            self._push(stack, tag, m[3])
            at_[tag].append(len(stack) - 1)
            if tag in BLOCKS:
                blocks.append(len(stack) - 1)
            if tag in RAW:
                if low is None:
                    low = source.lower()
                end = low.find(f"</{tag}", at)
                at = size if end < 0 else end
            elif m[3].endswith("/") and tag in ("svg", "math", "path"):
                close(len(stack) - 1)


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, joined by single spaces.

    Every element with text of its own is a paragraph. It passes points (one, one for each comma, and up to three for
    its length) to its parent, half of them to the grandparent, a third of that and so on to the three elements above.
    An element whose class, id or role names another part of the page goes, unless it has half of all points. A
    container's score is discounted by its link density. The best container is kept, grown to the article or main
    element that it stands in; so are its siblings that score a fifth of it, or are paragraphs with few links. What is
    named like reader comments goes whatever its points, unless nothing else is left; lists of links go from within.
    """
    if not source:
        return ""
    page = Page(source)
    text = _text_of(page)
    return _text_of(Page(source, comments=False)) if not text and page.commented else text


def _text_of(page: Page) -> str:
    tags, parent = page.tags, page.parent
    n = len(tags)
    commas = [0] * n
    links = [int(t == "a") for t in tags]  # here and below
    own, linked = [0] * n, [0] * n  # characters of text, and of those in links
    holder = [0] * n  # nearest block of each element
    in_link = [False] * n
    for i in range(1, n):
        holder[i] = i if tags[i] in BLOCKS else holder[parent[i]]
        in_link[i] = tags[i] == "a" or in_link[parent[i]]
    # An unlikely inline element is judged like a block, so its text counts for itself.
    for i in range(1, n):
        if page.unlikely[i] and tags[i] not in BLOCKS:
            holder[i] = i
        elif tags[i] not in BLOCKS:
            holder[i] = holder[parent[i]]
    for i, text in page.runs:
        if text and (k := len(" ".join(text.split()))):
            b = holder[i]
            own[b] += k
            commas[b] += text.count(",") + text.count("，")
            linked[b] += k * in_link[i]
    points = [0.0] * n
    for b in range(n):
        if own[b] >= SCORED_FROM and tags[b] not in ("body", "html", "#root") or own[b] >= 25:
            points[b] = (1 + commas[b] + min(own[b] / 100, 3)) * (1 - linked[b] / own[b])
    if any(page.unlikely):
        below = points[:]
        for i in range(n - 1, 0, -1):
            below[parent[i]] += below[i]
        gone = page.out[:]
        for i in range(1, n):
            gone[i] = gone[i] or gone[parent[i]] or (page.unlikely[i] and below[i] < ARTICLE_SHARE * below[0])
        page.runs = [(i, t) for i, t in page.runs if t is None or not gone[i]]
        page.out = gone
        for i in range(n):
            if gone[i]:
                own[i] = linked[i] = commas[i] = 0
                points[i] = 0.0
    score = [0.0] * n
    for b in range(n):
        if points[b]:
            up, part = (parent[b] if tags[b] in ("p", "pre", "li", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption", "caption") else b), 1.0
            up = holder[up]
            for level in range(1, 6):
                score[up] += points[b] * part
                if up == 0:
                    break
                up, part = holder[parent[up]], 0.5 if level == 1 else 1 / (3 * level)
    text_all, links_all = own[:], linked[:]
    for i in range(n - 1, 0, -1):
        text_all[parent[i]] += text_all[i]
        links_all[parent[i]] += links_all[i]
        links[parent[i]] += links[i]
    density = lambda i: links_all[i] / text_all[i] if text_all[i] else 0.0
    if not text_all[0]:
        return ""
    best = max(range(n), key=lambda i: (score[i] * (1 - density(i)), -i))
    if score[best] <= 0:
        best = next((i for i in range(n) if tags[i] in ("article", "main")), 0)
    up = best
    while up:
        if tags[up] in ("article", "main"):
            best = up
        up = parent[up]
    kept = {best}
    if best:
        least = max(1.0, SIBLING_SHARE * score[best] * (1 - density(best)))
        for i in range(1, n):
            if parent[i] == parent[best] and i != best and not page.out[i] and tags[best] not in ("main",):
                if score[i] * (1 - density(i)) >= least or tags[i] == "p" and text_all[i] > 80 and density(i) < 0.25:
                    kept.add(i)
    inside = [i in kept for i in range(n)]
    for i in range(1, n):
        listed = tags[i] in LISTS and links[i] >= LEAST_LINKS and density(i) >= LINK_SHARE
        inside[i] = (inside[i] or inside[parent[i]]) and not listed
    parts: list[str] = []
    for i, text in page.runs:
        if text is None:
            parts.append(" ")
        elif inside[i]:
            parts.append(text)
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every page, from its whole source.

    Returns the columns `keep`, text (empty if none) and n_chars (code points of text). A null or empty source gives an
    empty text; null keys and repeated rows are kept as they are; an empty table gives an empty result; other columns
    of pages are ignored, also such as are named text or n_chars.
    """
    columns = list(keep)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in columns}
    sent = {c: through_pandas(c, kinds[c]) for c in columns}
    schema = ", ".join(f"`{c}` {sent[c][1]}" for c in columns) + ", text string, n_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h) for h in pdf["_html"]]
            yield pd.DataFrame({c: pdf[c] for c in columns} | {"text": text, "n_chars": [len(t) for t in text]})

    found = pages.select(*[sent[c][0].alias(c) for c in columns], F.col(html).alias("_html")).mapInPandas(run, schema)
    return found.withColumns({c: F.col(c).cast(kinds[c]) for c in columns})
