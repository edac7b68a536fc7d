"""Operator 2: embedding near-duplicates by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import reliable_checkpoint
from tidemark.llm.components import connected_components, forest


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Double-precision vectors of length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    unit = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # Divide by the largest component first: squares of extreme values stay finite.
    unit = unit / np.abs(unit).max(axis=1)[:, None]
    return unit / np.sqrt((unit * unit).sum(axis=1))[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, norms of the decoded vectors and norms of what is lost."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(unit - decoded, axis=1)


#: Arrays of a tile: vector numbers and copies, codes, and a scale and two norms per vector.
_ARRAYS = {"nodes": np.int64, "copies": np.int64, "codes": np.int8, "scales": np.float64, "norms": np.float64, "lost": np.float64}
_TILE = "label_name binary, dim int, tile int, tiles int, " + ", ".join(f"{a} binary" for a in _ARRAYS)


def _pack_tile(table: pa.Table) -> pa.Table:
    """One row of a tile; only codes and bounds travel from here."""
    dim = table["dim"][0].as_py()
    parts = (table["node"].to_numpy(), table["copies"].to_numpy(), *quantise(unit_vectors(table["embedding"], dim)))
    same = {c: table[c].slice(0, 1) for c in ("label_name", "dim", "tile", "tiles")}
    packed = {a: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for (a, kind), x in zip(_ARRAYS.items(), parts, strict=True)}
    return pa.table(same | packed)


def _found(names: np.ndarray, links: np.ndarray, edges: list[np.ndarray], tail: int = 0) -> dict[str, pa.Array]:
    """Columns of counts (node, links) and edges (node, other), then ``tail`` empty rows."""
    linked = links > 0
    e = names[np.concatenate([np.empty((0, 2), np.int64), *edges])].reshape(-1, 2)
    counted = int(linked.sum())
    nulls = lambda n, mask: pa.array(np.concatenate((n, np.zeros(tail, np.int64))), mask=np.append(mask, np.ones(tail, bool)))
    rows = counted + len(e)
    return {
        "node": nulls(np.concatenate((names[linked], e[:, 0])), np.zeros(rows, bool)),
        "links": nulls(np.concatenate((links[linked], np.zeros(len(e), np.int64))), np.zeros(rows, bool)),
        "other": nulls(np.concatenate((np.zeros(counted, np.int64), e[:, 1])), np.arange(rows) < counted),
    }


def _tile_links(limit: float, strip: int = 512):
    """Pairs of tiles to links that the codes prove, and packed pairs that they leave open.

    Rows are (node, links) counts, (node, other) edges that connect what is linked, and per
    strip (asked, left, right): the vectors that its open pairs need, and the pairs' numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, same = row["dim"], row["tile"] == row["tile2"]
                a, b = ({n: np.frombuffer(row[n + suffix], kind) for n, kind in _ARRAYS.items()} for suffix in ("", "2"))
                # Products of int8 codes are exact in float32 up to dim * 127**2 < 2**24.
                kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
                left, right = a["codes"].reshape(-1, dim).astype(kind), b["codes"].reshape(-1, dim).astype(kind)
                counts = [np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)]
                names = a["nodes"] if same else np.concatenate((a["nodes"], b["nodes"]))
                edges, label, shift, open_ = [], np.arange(len(names)), 0 if same else len(left), []
                for low in range(0, len(left), strip):
                    high = min(low + strip, len(left))
                    scale, norm, lost = (a[c][low:high, None] for c in ("scales", "norms", "lost"))
                    estimate = (left[low:high] @ right.T) * scale * b["scales"]
                    # |x.y - x'.y'| <= |x'||y - y'| + |x - x'||y'| + |x - x'||y - y'|
                    bound = norm * b["lost"] + lost * b["norms"] + lost * b["lost"] + 1e-9
                    for sure in (True, False):
                        hit = estimate - bound >= limit if sure else (estimate + bound >= limit) & (estimate - bound < limit)
                        x, y = np.nonzero(hit)
                        x = x + low
                        if same:
                            x, y = x[x < y], y[x < y]
                        if sure:
                            counts[0] += np.bincount(x, b["copies"][y], len(left)).astype(np.int64)
                            counts[1] += np.bincount(y, a["copies"][x], len(right)).astype(np.int64)
                            forest(x, y + shift, label, edges)
                        elif len(x):
                            open_.append((x.astype(np.int32), (y + shift).astype(np.int32)))
                links = counts[0] + counts[1] if same else np.concatenate(counts)
                columns = _found(names, links, edges, len(open_))
                none = [None] * (len(columns["node"]) - len(open_))
                asked, pairs = [], []
                for x, y in open_:
                    need, at = np.unique(np.concatenate((x, y)), return_inverse=True)
                    asked.append(names[need].tolist())
                    pairs.append((at[: len(x)].astype(np.int32).tobytes(), at[len(x) :].astype(np.int32).tobytes()))
                columns["asked"] = pa.array(none + asked, pa.list_(pa.int64()))
                columns["left"] = pa.array(none + [p[0] for p in pairs], pa.binary())
                columns["right"] = pa.array(none + [p[1] for p in pairs], pa.binary())
                yield pa.record_batch(columns)

    return run


_OPEN = "node long, links long, other long, asked array<long>, left binary, right binary"


def _exact_links(limit: float):
    """Open pairs of a strip in double precision: rows as of :func:`_found`."""

    def run(table: pa.Table) -> pa.Table:
        pair = table.filter(pc.is_valid(table["left"]))
        x, y = (np.frombuffer(pair[c][0].as_py(), np.int32) for c in ("left", "right"))
        # In the order of the numbers that the pairs were given.
        order = np.argsort(table["place"].to_numpy())
        names, copies = table["node"].to_numpy()[order], table["copies"].to_numpy()[order]
        units = unit_vectors(table["embedding"], table["dim"][0].as_py())[order]
        links, edges, label = np.zeros(len(names), np.int64), [], np.arange(len(names))
        for start in range(0, len(x), 1 << 16):
            i, j = x[start : start + (1 << 16)], y[start : start + (1 << 16)]
            exact = np.einsum("ij,ij->i", units[i], units[j]) >= limit
            i, j = i[exact], j[exact]
            links += np.bincount(i, copies[j], len(names)).astype(np.int64) + np.bincount(j, copies[i], len(names)).astype(np.int64)
            forest(i, j, label, edges)
        return pa.table(_found(names, links, edges))

    return run


def embedding_near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    limit: float = 0.93,
    tile_rows: int = 2048,
) -> DataFrame:
    """Links of cosine >= ``limit`` between vectors of equal, non-null labels.

    Returns one row per input row: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable, itself included), ``kept`` (id = component).

    Method: equal vectors of a label count once, with a weight. Labels are cut into tiles by
    a hash, quantised once to int8 codes with scales and error norms; every pair of
    tiles of a label is a task, and only codes travel to it. The norms bound the error of each
    product: pairs that surely reach the limit link, and those that only may are computed
    again in double precision from the vectors that they name, so no link is missed or wrong.
    Tasks return counts and spanning forests, never a row per pair.

    Vectors that are null, empty or zero, or that hold null or non-finite components, and
    rows with a null label have no links. Vectors of different length do not link. Repeated
    rows link with each other; rows of a null id keep their row, and the id is null where
    a whole component has none. An empty table gives an empty result. Equal vectors
    are told by 128 bits, labels by their text.
    """
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").cast("binary").alias("label_name")
    )
    rows = rows.withColumn("embedding", F.when(F.col("label_name").isNotNull() & usable(F.col("embedding")), F.col("embedding")))
    names = [F.xxhash64("label_name", "embedding"), F.xxhash64(F.lit(1), "embedding", "label_name")]
    rows = rows.withColumns({f"h{i}": F.when(F.col("embedding").isNotNull(), h) for i, h in enumerate(names)})
    nodes = rows.where("h0 IS NOT NULL").groupBy("h0", "h1").agg(F.count("*").alias("copies"), F.min(F.struct("label_name", "embedding")).alias("v"))
    nodes = nodes.select("h0", "h1", "copies", "v.*", F.size("v.embedding").alias("dim"))
    nodes = reliable_checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    cut = nodes.groupBy("label_name", "dim").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    tiles = (
        nodes.join(reliable_checkpoint(cut), ["label_name", "dim"])
        .withColumn("tile", F.pmod(F.xxhash64("h0", F.lit(1)), F.col("tiles")).cast("int"))
        .select("label_name", "dim", "tile", "tiles", "node", "copies", "embedding")
        .groupBy("label_name", "dim", "tile")
        .applyInArrow(_pack_tile, _TILE)
    )
    tiles = reliable_checkpoint(tiles)
    second = tiles.select("label_name", "dim", F.col("tile").alias("tile2"), *(F.col(c).alias(f"{c}2") for c in _ARRAYS))
    first = tiles.withColumn("tile2", F.explode(F.sequence("tile", F.col("tiles") - 1)))
    pairs = first.join(second.hint("shuffle_merge"), ["label_name", "dim", "tile2"]).drop("label_name", "tiles")
    found = reliable_checkpoint(pairs.mapInArrow(_tile_links(limit), _OPEN))

    # The vectors that open pairs need, with their places in the pairs' numbering.
    strips = found.where("asked IS NOT NULL").select(F.monotonically_increasing_id().alias("strip"), "asked", "left", "right")
    strips = reliable_checkpoint(strips)
    asked = strips.select("strip", F.posexplode("asked").alias("place", "node"))
    asked = asked.join(nodes.select("node", "copies", "dim", "embedding"), "node")
    # The pairs travel with the first vector of their strip.
    asked = asked.join(strips.select("strip", "left", "right").withColumn("place", F.lit(0)), ["strip", "place"], "left")
    exact = reliable_checkpoint(asked.groupBy("strip").applyInArrow(_exact_links(limit), "node long, links long, other long"))

    counted = found.where("asked IS NULL").select("node", "links", "other").unionByName(exact)
    links = counted.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(counted.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    weighed = nodes.select("h0", "h1", "node", "copies").join(links, "node", "left").join(roots, "node", "left")
    weighed = weighed.select(
        "h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    # Checkpoints take away the partitioning of what is joined, so that a vector or component
    # of many rows can be split.
    keyed = rows.select("vec_id", "h0", "h1").join(reliable_checkpoint(weighed), ["h0", "h1"], "left")
    least = reliable_checkpoint(keyed.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least")))
    result = keyed.join(least, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")
    )
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
