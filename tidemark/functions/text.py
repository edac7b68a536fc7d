"""Column functions over page text, names and amounts.

Regular expressions that should follow Unicode classes carry ``(?U)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags whose content is never page text.
DROPPED_TAGS = (
    "script", "style", "noscript", "svg", "iframe", "canvas", "video",
    "audio", "template", "head", "nav", "header", "footer",
)

#: Masks for what changes on every request, in their order.
VOLATILE_MASKS = (
    (r"\?v=[\w.-]+", ""),
    (r"\b[0-9a-f]{32,64}\b", "<HASH>"),
    (r"(?i)\bnonce-[\w+/=-]+", "<NONCE>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?\b", "<TS>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"(?i)\b\d[\d,]{3,}\+?\s+(customers|teams|companies|users|businesses|developers)\b", "<COUNT> $1"),
)

#: Words of which a price page has at least one, and what looks like a price.
PLAN_WORDS = ("plan", "pricing", "tier", "billed", "subscription")
PRICE_HINT = r"[$£€]\s?\d|\bper (month|user|seat|year)\b|\bfree\b|\bcontact sales\b"

#: Prices in raw markup.
MARKUP_PRICE = r"""(?i)[$£€]\s?\d{1,4}(?:[.,]\d{2})?|"(?:price|amount|cost|monthly)\w*"\s*:\s*"?\d+"""

#: Symbols by currency code, and words written in capitals.
CURRENCY_SYMBOLS = {"USD": "$", "GBP": "£", "EUR": "€", "CAD": "CA$", "AUD": "A$", "INR": "₹"}
ACRONYMS = {
    "crm": "CRM", "seo": "SEO", "api": "API", "hr": "HR", "erp": "ERP",
    "crm-tools": "CRM", "bi": "BI", "it": "IT", "saas": "SaaS", "ai": "AI",
}

#: Page check, extraction estimate.
MIN_PAGE_CHARS = 200
EXTRACT_CHARS, CHARS_PER_TOKEN, OUTPUT_TOKENS, IN_USD, OUT_USD = 24_000, 4, 900, 1.0, 5.0


def _literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def strip_space(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def mask_volatile(text: Column) -> Column:
    return reduce(lambda t, m: F.regexp_replace(t, f"(?U){m[0]}", m[1]), VOLATILE_MASKS, text)


def normalize_lines(text: Column) -> Column:
    """Runs of blanks to one space, lines stripped, empty lines gone, adjacent repeats once."""
    spaced = F.regexp_replace(text, "[ \t ​]+", " ")
    lines = F.filter(F.transform(F.split(spaced, "\n"), strip_space), lambda s: s != "")
    # The lines are bound once by a lambda; named inside the filter they would be made anew for each line.
    kept = F.transform(F.array(lines), lambda all_: F.filter(all_, lambda s, i: (i == 0) | (s != F.get(all_, i - 1))))
    return F.array_join(F.get(kept, F.lit(0)), "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def strip_tags(html: Column) -> Column:
    """Text of a page by patterns alone: dropped elements, comments and tags become blanks."""
    dropped = F.regexp_replace(html, rf"(?is)<({'|'.join(DROPPED_TAGS)})\b.*?</\1>", " ")
    bare = F.regexp_replace(F.regexp_replace(dropped, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def looks_like_pricing_page(text: Column) -> Column:
    low = F.lower(text)
    named = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in PLAN_WORDS))
    return (F.length(text) >= MIN_PAGE_CHARS) & low.rlike(PRICE_HINT) & named


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""href=["']([^"']+)["']"""), 1)


def markup_prices(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(MARKUP_PRICE), 0)


def host_of(url: Column) -> Column:
    """What lies between ``://`` and the path, port and user kept."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def plan_key(name: Column) -> Column:
    """Lower-cased, one each of four suffixes removed in this order, letters and digits kept."""
    low = strip_space(F.lower(name))
    for suffix in (" plan", " tier", " package", " edition"):
        low = F.regexp_replace(low, f"{suffix}$", "")
    return F.regexp_replace(low, r"[^\p{L}\p{N}]", "")


def title_case(slug: Column) -> Column:
    known = _literal_map(ACRONYMS)
    words = F.filter(F.split(F.replace(slug, F.lit("-"), F.lit(" ")), " +"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.coalesce(known[F.lower(w)], F.initcap(w))), " ")
    return F.coalesce(known[F.lower(slug)], joined)


def html_escape(text: Column) -> Column:
    """Null becomes empty; the ampersand goes first."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(text, F.lit("")))


def pretty_date(iso: Column) -> Column:
    """``05 Aug 2026``; null a dash; what is no date its first ten characters."""
    parsed = F.date_format(F.try_to_timestamp(iso), "dd MMM yyyy")
    return F.when(iso.isNull() | (iso == ""), "—").otherwise(F.coalesce(parsed, F.substring(iso, 1, 10)))


def money(currency: Column, value: Column) -> Column:
    """Grouped amount without trailing zeros, after its symbol or before its code; null a dash."""
    code = F.upper(F.coalesce(currency, F.lit("")))
    digits = F.regexp_replace(F.regexp_replace(F.format_number(value, 2), "0+$", ""), r"\.$", "")
    symbol = _literal_map(CURRENCY_SYMBOLS)[code]
    plain = F.when(code == "", digits).otherwise(F.concat(digits, F.lit(" "), F.substring(code, 1, 3)))
    return F.when(value.isNull(), "—").otherwise(F.coalesce(F.concat(symbol, digits), plain))


def pair_slug(a: Column, b: Column) -> Column:
    """Both in order; a null side is left out."""
    ordered = b.isNull() | (a <= b)
    return F.concat_ws("-vs-", F.when(ordered, a).otherwise(b), F.when(ordered, b).otherwise(a))


def diff_direction(old: Column, new: Column) -> Column:
    """up, down or flat for two numbers; none otherwise."""
    a, b = (F.expr("try_cast(NULL AS DOUBLE)") if c is None else c.try_cast("double") for c in (old, new))
    return F.when(a.isNull() | b.isNull(), "none").when(b > a, "up").when(b < a, "down").otherwise("flat")


def to_number(text: Column) -> Column:
    return F.round(text.try_cast("double"), 2)


def extraction_cost(text: Column) -> Column:
    """Estimated USD of one extraction."""
    tokens = F.least(F.length(text), F.lit(EXTRACT_CHARS)) / F.lit(float(CHARS_PER_TOKEN))
    return tokens / 1e6 * IN_USD + OUTPUT_TOKENS / 1e6 * OUT_USD


def tenths(value: Column) -> Column:
    """``value`` to one place, rounded as a number as SQL does: ``round(x, 1)`` rounds the digits that x prints with."""
    return F.round(value * 10) / 10


def percent_text(old: Column, new: Column) -> Column:
    """A signed change in per cent to one place, ``n/a`` from 0 or nothing."""
    exact = percent_change(old, new)
    percent = tenths(exact)
    # Rounding to nothing keeps the direction.
    return F.when(percent.isNull(), "n/a").when((percent == 0) & (exact < 0), "-0.0%").otherwise(F.format_string("%+.1f%%", percent))


def relative_prefix(path: Column) -> Column:
    """``../`` for each folder between a page and the root."""
    return F.repeat(F.lit("../"), F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old != 0, (new - old) / old * 100)
