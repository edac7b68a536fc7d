"""Operator 4: secret scans with multipart credential linking."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in the order in which spans at one start are listed, then those of linking.
KINDS = ("assign", "access", "hex", "secret", "endpoint")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
#: A run that is too short fails at each of its starts, so the bound can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak parts: 40-character keys (the usual length beside an access id) and service addresses.
_WEAK = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
_ENDPOINT = re.compile(r"https?://[^\s\"'<>@]+|[a-z0-9.-]+\.amazonaws\.com", re.ASCII)
#: Blank lines part scopes.
_SCOPE = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind number, start, end) of the strong candidates, by kind."""
    found = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return found + [(2, m.start(), m.end()) for m in _HEX.finditer(text)]


class Intervals:
    """Spans that may overlap, for lookups of whether any lies near another span."""

    def __init__(self, spans: list[Span]):
        spans = sorted(s[1:] for s in spans)
        self.starts = [a for a, _ in spans]
        #: The largest end so far: an earlier interval may reach beyond a later one.
        self.ends = list(accumulate((b for _, b in spans), max))

    def near(self, span: Span, reach: int) -> bool:
        """Whether an interval lies within ``reach`` characters of the span or overlaps it."""
        at = bisect_left(self.starts, span[2])
        return (at > 0 and span[1] - self.ends[at - 1] <= reach) or (at < len(self.starts) and self.starts[at] - span[2] <= reach)


def linked_spans(text: str, base: list[Span], reach: int) -> list[Span]:
    """Weak secrets and endpoints that complementary parts confirm.

    Within a scope (text between blank lines) a 40-character key counts when an access
    identifier lies within ``reach`` characters; an endpoint counts when both an access
    identifier and a secret (an assignment or such a key) do. Parts may overlap.
    """
    access = [s for s in base if s[0] == 1]
    if not access:
        return []
    weak = [(3, m.start(), m.end()) for m in _WEAK.finditer(text)]
    points = [(4, m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    cuts = [m.end() for m in _SCOPE.finditer(text)]

    def by_scope(spans: list[Span]) -> dict[int, list[Span]]:
        grouped: dict[int, list[Span]] = {}
        for s in spans:
            grouped.setdefault(bisect_left(cuts, s[1] + 1), []).append(s)
        return grouped

    ids = {at: Intervals(spans) for at, spans in by_scope(access).items()}
    found = [s for at, spans in by_scope(weak).items() if at in ids for s in spans if ids[at].near(s, reach)]
    keys = {at: Intervals(spans) for at, spans in by_scope([s for s in base if s[0] == 0] + found).items()}
    for at, spans in by_scope(points).items():
        if at in ids and at in keys:
            found += [s for s in spans if ids[at].near(s, reach) and keys[at].near(s, reach)]
    return found


def _scan(reach: int):
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                found = sorted(base + linked_spans(text, base, reach), key=lambda s: (s[1], s[0], s[2])) if base else base
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found])
            yield pa.record_batch([batch.column(0), pa.array(rows, spans)], ["doc_id", "spans"])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """Secret candidates of every whole text: (doc_id, spans array<kind, start, end>).

    Spans count code points, ends exclusive, ordered by start, then kind as in
    :data:`KINDS`. ``assign``, ``access`` and ``hex`` stand on their own; ``secret`` and
    ``endpoint`` come from linking parts in a scope (see :func:`linked_spans`), an
    interval join in which each part looks up its nearest neighbours only, so a text of
    many parts costs no pairs. Nothing is shuffled.

    Null and empty texts, and texts without candidates, give an empty array; null or
    repeated ids keep their rows; an empty table an empty result. Other columns are not read.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = f"{dict(known.dtypes)['doc_id']}"
    return known.mapInArrow(_scan(reach), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
