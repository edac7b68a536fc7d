"""Operator 13: product codes of vectors, with codebooks from Lloyd's rounds over heaps."""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, shared_folder
from tidemark.session import remove_folder, stored

#: Vectors of a block; its heaps and vectors stay together through all rounds.
BLOCK = 1 << 15
#: Bounds give way by this share, so that rounding can only cause a rescan too many.
_SLACK = 1e-9
_STATE = (
    "vec_ids array<{id}>, labels array<{label}>, vectors binary, keys binary, members binary, sizes binary, scanned long, "
    "moved array<struct<part: int, entry: int, n: long, total: array<long>>>"
)


def whole_vectors(vector: Column) -> Column:
    """Not null and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts of a vector, equal where ``parts`` divides its length."""
    return [(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: by a product of matrices where all its terms are
    whole numbers of a double, else component by component."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * 4 * most * most < 1 << 53:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    total = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        total += (x[:, i, None].astype(np.int64) - entries[None, :, i]) ** 2
    return total


def nearest(x: np.ndarray, entries: np.ndarray, strip: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, ties to the lower, and how much farther the second is, rounded down."""
    best, slack = np.empty(len(x), np.int64), np.full(len(x), np.inf)
    for low in range(0, len(x), strip):
        d = squared_distances(x[low : low + strip], entries)
        rows, first = np.arange(len(d)), d.argmin(axis=1)
        best[low : low + strip] = first
        if len(entries) > 1:
            upper = np.sqrt(d[rows, first].astype(np.float64))
            d[rows, first] = np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf
            lower = np.sqrt(d.min(axis=1).astype(np.float64))
            slack[low : low + strip] = lower - upper - _SLACK * (lower + upper)
    return best, slack


@dataclass
class Codebooks:
    """Entries of every part, their members' sums, and how far the bounds of an entry have drifted."""

    entries: list[np.ndarray]
    totals: list[np.ndarray]
    counts: np.ndarray
    drift: np.ndarray

    @classmethod
    def start(cls, vectors: np.ndarray, parts: int) -> Codebooks:
        entries = [vectors[:, a:b].copy() for a, b in cuts(vectors.shape[1], parts)]
        return cls(entries, [np.zeros_like(e) for e in entries], np.zeros((parts, len(vectors)), np.int64), np.zeros((parts, len(vectors))))

    def update(self, moved: list) -> None:
        """Take what moved between entries, set each used entry to the floor of its members' mean, and
        let bounds drift: a member may have come nearer to any other entry by that entry's move, and
        farther from its own by its own."""
        for part, entry, n, *total in moved:
            self.counts[part, entry] += n
            self.totals[part][entry] += np.array(total[: self.totals[part].shape[1]], np.int64)
        for part, old in enumerate(self.entries):
            used = self.counts[part] > 0
            new = old.copy()
            new[used] = self.totals[part][used] // self.counts[part][used][:, None]
            step = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + _SLACK)
            if len(step) > 1:
                first, second = np.argsort(-step, kind="stable")[:2]
                other = np.full(len(step), step[first])
                other[first] = step[second]
                self.drift[part] += step + other
            self.entries[part] = new

    def digest(self) -> str:
        numbers = (str(x) for part in self.entries for x in part.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


class BlockHeaps:
    """The heaps of a block: for each part and entry its members, least slack at the top.

    A member's key is its slack plus the drift of its entry when it was pushed, so no key changes while
    entries move: a member is safe while its key is above its entry's drift, and all that are not
    stand above all that are.
    """

    def __init__(self, keys: bytes, members: bytes, sizes: bytes, parts: int):
        sizes = np.frombuffer(sizes, np.int32).reshape(parts, -1)
        shape = (parts, int(sizes[0].sum()))
        self.keys = list(np.frombuffer(keys, np.float64).reshape(shape))
        self.members = list(np.frombuffer(members, np.int32).reshape(shape))
        self.sizes = list(sizes)

    @classmethod
    def pack(cls, keys: list, members: list, sizes: list) -> dict[str, bytes]:
        kinds = {"keys": (keys, np.float64), "members": (members, np.int32), "sizes": (sizes, np.int32)}
        return {n: np.concatenate(arrays).astype(kind).tobytes() for n, (arrays, kind) in kinds.items()}

    def assigned(self, part: int) -> np.ndarray:
        """The entry of every row of the block."""
        entry = np.empty(len(self.members[part]), np.int64)
        entry[self.members[part]] = np.repeat(np.arange(len(self.sizes[part])), self.sizes[part])
        return entry

    def rescan(self, part: int, x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pop every member that its bounds no longer hold, find its nearest entry anew, push it there.

        Returns the popped rows, their entries before and their entries now.
        """
        keys, members, ends = self.keys[part], self.members[part], np.cumsum(self.sizes[part])
        begins = ends - self.sizes[part]
        filled = np.flatnonzero(self.sizes[part])
        open_heaps = filled[keys[begins[filled]] <= drift[filled]]
        heaps: dict[int, list] = {}

        def heap(entry: int) -> list:
            if entry not in heaps:
                own = slice(begins[entry], ends[entry])
                heaps[entry] = list(zip(keys[own].tolist(), members[own].tolist(), strict=True))
            return heaps[entry]

        popped, before = [], []
        for entry in open_heaps.tolist():
            own, limit = heap(entry), drift[entry]
            while own and own[0][0] <= limit:
                popped.append(heapq.heappop(own)[1])
                before.append(entry)
        rows, before = np.array(popped, np.int64), np.array(before, np.int64)
        now, slack = nearest(x[rows], entries)
        for key, row, entry in zip((slack + drift[now]).tolist(), popped, now.tolist(), strict=True):
            heapq.heappush(heap(entry), (key, row))
        if heaps:
            sizes = self.sizes[part].copy()
            spans = [(keys[b:e], members[b:e]) for b, e in zip(begins, ends, strict=True)]
            for entry, own in heaps.items():
                spans[entry] = (np.array([k for k, _ in own], np.float64), np.array([m for _, m in own], np.int32))
                sizes[entry] = len(own)
            self.keys[part], self.members[part] = (np.concatenate([s[i] for s in spans]) for i in (0, 1))
            self.sizes[part] = sizes
        return rows, before, now


def _sums(part: int, x: np.ndarray, entry: np.ndarray, sign: int, into: dict) -> None:
    """Add ``sign`` times the counts and sums of rows by entry."""
    used, at = np.unique(entry, return_inverse=True)
    total = np.zeros((len(used), x.shape[1]), np.int64)
    np.add.at(total, at, x)
    for e, n, t in zip(used.tolist(), np.bincount(at, minlength=len(used)).tolist(), total, strict=True):
        known = into.setdefault((part, e), [0, np.zeros(x.shape[1], np.int64)])
        known[0] += sign * n
        known[1] += sign * t


def _moved(found: dict) -> list[dict]:
    return [{"part": p, "entry": e, "n": n, "total": t.tolist()} for (p, e), (n, t) in found.items() if n or t.any()]


def _vectors(batch: pa.RecordBatch, dim: int, scale: int) -> np.ndarray:
    """Integer components; their squared distances must fit a long."""
    numbers = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)
    numbers = np.floor(numbers * scale)
    most = float(np.abs(numbers).max(initial=0))
    if most >= 1 << 31 or dim * 4 * int(most) ** 2 >= 1 << 63:
        raise ValueError(f"components times {scale} up to {most}: squared distances do not fit a long")
    return numbers.astype(np.int32)


def _begin(books: Codebooks, dim: int, scale: int, schema: pa.Schema) -> Callable:
    """Vectors to blocks: every row's nearest entry, found by looking at all of them."""
    parts = cuts(dim, len(books.entries))

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.concatenate([_vectors(b, dim, scale) for b in batches])
        keys, members, sizes, found = [], [], [], {}
        for part, (low, high) in enumerate(parts):
            entry, slack = nearest(x[:, low:high], books.entries[part])
            order = np.lexsort((slack, entry))  # in order of slack, each entry's members are a heap already
            keys.append(slack[order])
            members.append(order)
            sizes.append(np.bincount(entry, minlength=len(books.entries[part])))
            _sums(part, x[:, low:high], entry, 1, found)
        table = pa.Table.from_batches(batches)
        row = {"vec_ids": table["vec_id"].to_pylist(), "labels": table["label"].to_pylist(), "vectors": x.tobytes(), "scanned": x.shape[0] * len(parts)}
        return pa.RecordBatch.from_pylist([row | BlockHeaps.pack(keys, members, sizes) | {"moved": _moved(found)}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                cut = batch.slice(low, BLOCK)
                if size + cut.num_rows > BLOCK:
                    yield block(held)
                    held, size = [], 0
                held.append(cut)
                size += cut.num_rows
        if size:
            yield block(held)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, BlockHeaps]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            x, keys, members, sizes = (row.column(c)[0].as_py() for c in ("vectors", "keys", "members", "sizes"))
            heaps = BlockHeaps(keys, members, sizes, parts)
            yield row, np.frombuffer(x, np.int32).reshape(len(heaps.members[0]), dim), heaps


def _round(books: Codebooks, dim: int, schema: pa.Schema) -> Callable:
    """One round over stored blocks: only members whose bounds broke are looked at."""
    parts = cuts(dim, len(books.entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, heaps in _blocks(batches, dim, len(parts)):
            found, scanned = {}, 0
            for part, (low, high) in enumerate(parts):
                own = x[:, low:high]
                rows, before, now = heaps.rescan(part, own, books.entries[part], books.drift[part])
                scanned += len(rows)
                gone = before != now
                _sums(part, own[rows[gone]], before[gone], -1, found)
                _sums(part, own[rows[gone]], now[gone], 1, found)
            state = BlockHeaps.pack(heaps.keys, heaps.members, heaps.sizes) | {"scanned": scanned, "moved": _moved(found)}
            fresh = pa.RecordBatch.from_pylist([state | dict.fromkeys(("vec_ids", "labels", "vectors"))], schema)
            yield pa.RecordBatch.from_arrays([row.column(f.name) if f.name in ("vec_ids", "labels", "vectors") else fresh.column(f.name) for f in schema], schema=schema)

    return run


def _end(books: Codebooks, dim: int, schema: pa.Schema) -> Callable:
    """Stored blocks to rows: codes of the final entries and exact distances to them."""
    parts = cuts(dim, len(books.entries))
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, heaps in _blocks(batches, dim, len(parts)):
            code, error = np.full(len(x), "", "U1"), np.zeros(len(x), np.int64)
            for part, (low, high) in enumerate(parts):
                heaps.rescan(part, x[:, low:high], books.entries[part], books.drift[part])
                entry = heaps.assigned(part)
                code = np.char.add(code, hexes[entry])
                error += ((x[:, low:high].astype(np.int64) - books.entries[part][entry]) ** 2).sum(axis=1)
            columns = [row.column("vec_ids").flatten(), row.column("labels").flatten(), pa.array(code.tolist(), pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _arrow(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def fit_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks, list[int]]:
    """Codes (vec_id, label, code, error) of ``vectors(vec_id, embedding, label)``, the codebooks, and how
    many parts each assignment looked at.

    Vectors that are null or hold null or non-finite components are left out, as are those whose length differs
    from that of the smallest ``vec_id``'s. Components become floor(scale * x), cut into ``parts``
    consecutive parts. Codebooks start as the first ``entries`` (256 at most) rows by ``vec_id``, null last,
    ties by vector; each round assigns every part to its nearest entry, ties to the lower index, and sets used
    entries to the floor of their members' mean; all is assigned once more at the end. No vectors, no rows. An error
    says where components are so large that distances would not fit a long.

    Rounds are exact, not approximate. The first looks at all entries. Later ones keep blocks of 32,768 vectors with a heap per part and
    entry in a table of the shared folder, written anew each round, the round before removed: only members
    whose slack is used up by the cumulative drift of the entries are popped and looked at again, and only what moved is summed. The
    driver holds codebooks, sums and drifts: entries times the length of a vector, however many vectors there are. Blocks come from the
    scan as they are, so nothing is shuffled but sums, and no key can be hot.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries: a code is two hex digits")
    spark = vectors.sparkSession
    types = {"id": vectors.schema["vec_id"].dataType.simpleString(), "label": vectors.schema["label"].dataType.simpleString()}
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").where(whole_vectors(F.col("embedding")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("vec_id", "embedding", F.size("embedding").alias("dim"))
    smallest = first.limit(1).collect()
    result = "vec_id {id}, label {label}, code string, error long".format(**types)
    if not smallest:
        return spark.createDataFrame([], result), Codebooks([], [], np.zeros((0, 0), np.int64), np.zeros((0, 0))), []
    dim = smallest[0]["dim"]
    begun = first.where(F.col("dim") == dim).limit(entries).collect()
    numbers = pa.RecordBatch.from_pydict({"embedding": pa.array([r["embedding"] for r in begun], pa.list_(pa.float64()))})
    books = Codebooks.start(_vectors(numbers, dim, scale).astype(np.int64), parts)
    width = max(b - a for a, b in cuts(dim, parts))

    folder, ddl, looked = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}", _STATE.format(**types), []
    schema = _arrow(ddl, spark)
    state = kept.where(F.size("embedding") == dim).mapInArrow(_begin(books, dim, scale, schema), ddl)
    for turn in range(rounds):
        if turn:
            state = state.mapInArrow(_round(books, dim, schema), ddl)
        state = stored(state, f"{folder}/{turn}")
        moves = state.select("scanned", F.explode_outer("moved").alias("m"))
        looked.append(state.agg(F.sum("scanned")).first()[0])
        moves = moves.where("m IS NOT NULL").groupBy("m.part", "m.entry").agg(F.sum("m.n"), *(F.sum(F.get("m.total", F.lit(i))) for i in range(width)))
        books.update([[x or 0 for x in row] for row in moves.collect()])
        if turn:
            remove_folder(spark, f"{folder}/{turn - 1}")
    codes = stored(state.mapInArrow(_end(books, dim, _arrow(result, spark)), result), f"{folder}/codes")
    if rounds:
        remove_folder(spark, f"{folder}/{rounds - 1}")
    return codes, books, looked


def compress_vectors(vectors: DataFrame, **settings: int) -> DataFrame:
    """Codes as :func:`fit_codes` gives them, each with the error of its label, nulls together, and a
    digest of the codebooks: (vec_id, code, error, label_error, codebooks_sha256)."""
    codes, books, _ = fit_codes(vectors, **settings)
    errors = codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(broadcast_if_small(errors), F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
