"""Page text from HTML: a stdlib parser over Arrow batches, then masks and lines as columns."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import DROPPED_TAGS, host_of, mask_volatile, normalize_lines

#: Parts of class, id, data-testid and aria-label that mark noise; widget
#: brands count except on their own site.
NOISE_PATTERNS = (
    "cookie", "consent", "gdpr", "banner", "announcement", "promo-bar", "topbar", "notification",
    "carousel", "testimonial", "marquee", "ticker", "newsletter", "social-proof", "breadcrumb",
    "skip-link", "cursor", "backdrop", "modal-overlay",
)
WIDGET_PATTERNS = ("chat-widget", "chat-bubble", "chat-launcher", "help-widget")
WIDGET_BRANDS = ("intercom", "drift", "crisp", "zendesk", "livechat", "tidio", "hubspot", "tawk", "freshchat", "olark")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when one of the listed tags opens inside the same parent.
_ENDED_BY = {
    "p": frozenset("p div section article ul ol table h1 h2 h3 h4 h5 h6 form main aside".split()),
    "li": frozenset(["li"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "tr": frozenset(["tr"]),
    "option": frozenset(["option"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
}


#: Elements that may stand in the head; any other start tag ends it, its end tag being optional.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())


class _PageText(HTMLParser):
    """Text nodes outside dropped, hidden and noisy elements."""

    def __init__(self, noise: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.noise, self.open, self.dropping, self.nodes = noise, [], 0, []

    def _pop(self) -> None:
        self.dropping -= self.open.pop()[1]

    def _end_head(self) -> None:
        while any(t == "head" for t, _ in self.open):
            self._pop()

    def handle_starttag(self, tag, attrs):
        while self.open and tag in _ENDED_BY.get(self.open[-1][0], ()):
            self._pop()
        if (tag not in _IN_HEAD and self.open and self.open[-1][0] == "head") or tag == "body":
            self._end_head()
        if tag in _VOID:
            return
        named = dict(attrs)
        label = " ".join(named.get(k) or "" for k in ("class", "id", "data-testid", "aria-label")).lower()
        hidden = tag in DROPPED_TAGS or named.get("aria-hidden") == "true" or any(n in label for n in self.noise)
        self.open.append((tag, int(hidden)))
        self.dropping += hidden

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._pop()

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._end_head()
        if not self.dropping:
            self.nodes.append(data)


def page_text(html: str | None, host: str | None) -> str | None:
    """Text nodes of a page on a line each."""
    if html is None:
        return None
    brands = tuple(b for b in WIDGET_BRANDS if b not in (host or "").lower())
    parser = _PageText(NOISE_PATTERNS + WIDGET_PATTERNS + brands)
    parser.feed(html)
    parser.close()
    return "\n".join(parser.nodes)


def _texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for htmls, hosts in batches:
        yield pd.Series([page_text(h, s) for h, s in zip(htmls, hosts, strict=True)], dtype=object)


def clean_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``pages`` with ``text``: what a reader sees, without what changes on each request.

    The parser runs once per page in Arrow batches; everything after it is columns. The
    metamorphic contract is that pages that differ only in noise have equal text.
    """
    raw = F.pandas_udf(_texts, "string")(F.col(html_col), host_of(F.col(url_col))).alias("_raw")
    return pages.select("*", raw).withColumn("text", normalize_lines(mask_volatile(F.col("_raw")))).drop("_raw")
