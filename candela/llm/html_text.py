"""Main text of web pages by the maximum-scoring contiguous run of words and tags.

Words score positive and tags negative; the weights come from pages that mark their article themselves.  One
linear scan finds the best run, and what is inside it but belongs to a menu, form, advert or the like is left out.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: elements of HTML by their part in a page
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1",
    "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
ASIDE = {
    "head", "nav", "aside", "footer", "header", "form", "menu", "dialog", "button", "select", "option", "datalist", "fieldset", "svg", "math",
    "canvas", "audio", "video", "object", "map",
}
#: Elements by which a page marks its article, the first that it has.
ARTICLE = ("article", "main")
#: Whole class, id and role names that mark a part beside the article, without hyphens and capitals.
ASIDE_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav",
    "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "rail", "footer", "header", "masthead", "comment", "comments",
    "commentlist", "disqus", "respond", "replies", "reply", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "related",
    "recommended", "pagination", "pager", "widget", "copyright", "contentinfo", "complementary", "form", "skip", "hidden", "toolbar",
}
#: Names of two words or more: these parts before or after a name of ASIDE_NAMES leave its meaning.
ASIDE_ENDS = {"area", "bar", "block", "box", "container", "inner", "list", "wrap", "wrapper", "section", "links", "buttons", "menu", "posts", "articles"}
ASIDE_STARTS = {"site", "page", "global", "main", "top", "left", "right", "primary", "secondary", "mobile", "js", "wp", "block"}
#: Names with these parts tell how a layout is made, not what an element is.
LAYOUT = {"has", "with", "no", "without", "is", "layout"}
#: Elements that may wrap an article.
WRAPS = {"div", "section", "center", "table", "form"}
#: Elements whose start ends an open paragraph.
ENDS_P = (BLOCKS | ASIDE) - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "button", "select", "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>" + "|".join(sorted(RAW)) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-z][^>]*(?:>|$)|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)

DEFAULT_TAG, LEAST_TAG, MOST_TAG = 0.3, 0.02, 3.0
#: Cost of a tag that fences a part beside the article, where the page does not mark the article around it.
FENCE = 1.0


def _named_beside(name: str) -> bool:
    """Whether a class, id or role is one of ASIDE_NAMES, but for what merely tells its place or its kind of box."""
    parts = [part.lower() for part in _PARTS.findall(name) if not part.isdigit()]
    if not parts or LAYOUT & set(parts):
        return False
    while len(parts) > 1 and parts[-1] in ASIDE_ENDS:
        parts.pop()
    while len(parts) > 1 and parts[0] in ASIDE_STARTS:
        parts.pop(0)
    return all(part in ASIDE_NAMES for part in parts)


def _beside(attrs: str) -> bool:
    """Whether the attributes of a start tag mark a part beside the article."""
    if not attrs or attrs.isspace():
        return False
    for m in _NAMES.finditer(attrs):
        if any(map(_named_beside, (m[1] or m[2] or m[3] or "").split())):
            return True
    return _HIDDEN.search(attrs) is not None


def _around_article(page: str, mark: str) -> set[int]:
    """Where the contents of all elements begin that contain a start of the page's article, the elements of one name
    being matched among themselves."""
    if not mark:
        return set()
    open_at: dict[str, list[int]] = {}
    reach: list[tuple[int, int]] = []
    starts: list[int] = []
    for m in _TOKEN.finditer(page):
        name = (m["tag"] or "").lower()
        if not name:
            continue
        if name == mark and not m["end"]:
            starts.append(m.start())
        if name in WRAPS and not (m["attrs"] or "").endswith("/"):
            begun = open_at.setdefault(name, [])
            if not m["end"]:
                begun.append(m.end())
            elif begun:
                reach.append((begun.pop(), m.start()))
    reach += [(at, len(page)) for begun in open_at.values() for at in begun]
    return {at for at, end in reach if (k := bisect_left(starts, at)) < len(starts) and starts[k] < end}


def _mark(page: str) -> str:
    lower = page.lower()
    return next((name for name in ARTICLE if "<" + name in lower), "")


class _Open:
    """The elements that are open, with the places of those of each name, so that no search goes through the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool] | None] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def add(self, name: str, aside: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, aside))

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names, or -1."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=-1)

    def top(self) -> str | None:
        return self.stack[-1][0] if self.stack else None

    def remove(self, at: int) -> tuple[str, bool]:
        """Take out the innermost element of its name."""
        name, aside = self.stack[at]
        self.places[name].pop()
        if name not in INLINE:
            self.blocks.pop()
        self.stack[at] = None
        while self.stack and self.stack[-1] is None:
            self.stack.pop()
        return name, aside


def units(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, value, beside, article) in page order; kind is "tag", "fence" (a tag that opens or closes a part
    beside the article) or "text"; beside and article tell whether such an element is open around it.  The time grows
    in proportion to the page, whatever its nesting."""
    open_ = _Open()
    beside = article = 0
    mark, opened = _mark(page), False
    around: set[int] | None = None
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            yield "text", text, beside > 0, article > 0
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            at = open_.last(tag)
            if at < 0 or tag in INLINE and open_.blocks and open_.blocks[-1] > at:
                if at >= 0:  # an inline element closed outside the block in which it was opened
                    beside -= open_.remove(at)[1]
                yield "tag", tag, beside > 0, article > 0
                continue
            fence = False
            while len(open_.stack) > at:
                name, aside = open_.remove(len(open_.stack) - 1)
                beside -= aside
                article -= name == mark
                fence |= aside
            yield "fence" if fence else "tag", tag, beside > 0, article > 0
            continue
        if tag in ENDS_P or tag == "li" or tag == "option":
            ends = ("p",) if tag in ENDS_P and tag != "li" else ("p", tag)
            while (top := open_.top()) is not None and (top in ends or top in INLINE and open_.last(*ends) >= 0):
                # an open paragraph ends here, and with it what is open inside; a list item does not leave its list
                if open_.last("ul", "ol", "table") > open_.last(*ends):
                    break
                beside -= open_.remove(len(open_.stack) - 1)[1]
        aside = tag in ASIDE and not (tag == "header" and article) or _beside(m["attrs"]) and tag not in ("html", "body")
        if aside and not opened and not beside and not _HIDDEN.search(m["attrs"]):
            # the page's first article, and what wraps it, are never beside it
            if tag in WRAPS and around is None:
                around = _around_article(page, mark)
            aside = tag not in ARTICLE and not (tag in WRAPS and m.end() in around)
        if tag not in VOID and not (m["attrs"] or "").endswith("/"):
            open_.add(tag, aside)
            beside += aside
            article += tag == mark
            opened |= tag == mark and not beside
        yield "fence" if aside else "tag", tag, beside > 0, article > 0


def label_counts(page: str) -> dict[tuple[str, bool], int]:
    """For a page that marks one article: how often words ("") and each tag stand inside it and outside."""
    out: dict[tuple[str, bool], int] = {}
    marks, mark = 0, _mark(page)
    for kind, value, beside, article in units(page):
        if kind == "text":
            if not beside and (n := len(value.split())):
                out["", article] = out.get(("", article), 0) + n
        else:
            marks += value == mark
            if kind == "tag" and not beside:
                name = value if value in BLOCKS or value in INLINE else "other"
                out[name, article] = out.get((name, article), 0) + 1
    return out if 0 < marks <= 2 else {}


class Weights:
    """Score of a word, and cost of each tag: the log-odds that it stands outside the article rather than inside."""

    def __init__(self, counts: dict[tuple[str, bool], int] | None = None) -> None:
        counts = counts or {}
        inside, outside = (sum(n for (name, at), n in counts.items() if name and at is side) for side in (True, False))
        self.word = 1.0
        self.cost = {}
        for name in {name for name, _ in counts if name}:
            odds = math.log((counts.get((name, False), 0) + 1) / (outside + 1)) - math.log((counts.get((name, True), 0) + 1) / (inside + 1))
            self.cost[name] = min(MOST_TAG, max(LEAST_TAG, odds))

    def tag(self, name: str) -> float:
        return self.cost.get(name if name in BLOCKS or name in INLINE else "other", DEFAULT_TAG)


def main_text(page: str, weights: Weights) -> str:
    """Text of the best run; blocks are trimmed and joined by one space, and so is white space inside them."""
    seen = list(units(page))
    marked = any(kind == "text" and article and not beside and not value.isspace() for kind, value, beside, article in seen)
    best = total = 0.0
    start, run = 0, (0, 0)
    for k, (kind, value, beside, article) in enumerate(seen):
        if kind == "text":  # where the page marks its article, words outside it speak against a run
            total += 0.0 if beside else weights.word * len(value.split()) * (1 if article or not marked else -1)
        elif kind == "fence":
            total -= 0.0 if article else FENCE
        elif not beside:
            total -= weights.tag(value)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, run = total, (start, k + 1)
    blocks, block = [], []
    for kind, value, beside, _ in seen[slice(*run)]:
        if kind == "text":
            if not beside:
                block.append(value)
        elif value not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(word for b in blocks for word in html.unescape(b).split()) if best else ""


def fit_weights(pages: DataFrame) -> Weights:
    """Weights from all pages that mark exactly one article; only a count for each known tag reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, bool], int] = {}
        for batch in batches:
            for page in batch["html"]:
                for key, n in label_counts(page or "").items():
                    sums[key] = sums.get(key, 0) + n
        yield pd.DataFrame([(*key, n) for key, n in sums.items()], columns=["name", "inside", "n"])

    rows = pages.select("html").mapInPandas(count, "name string, inside boolean, n bigint").groupBy("name", "inside").agg(F.sum("n").alias("n"))
    return Weights({(r["name"], r["inside"]): r["n"] for r in rows.collect()})


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of every page.

    ``pages`` needs page_id, url and html; other columns are ignored.  A null or empty page, or one without words
    beside menus and the like, gives an empty text.  Repeated rows are taken each for itself.
    """
    weights = weights or fit_weights(pages)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page or "", weights))

    rows = pages.select("page_id", "url", text_of("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
