"""Operator 5: nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import reliable_checkpoint
from tidemark.llm.neardup import usable

_PACKED = "dim int, block int, ids binary, vectors binary, codes binary, norms binary, corrections binary"


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def one_bit_codes(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs after rotation, norms, and each unit vector's product with its decoded code."""
    # Divide by the largest component first: squares of extreme values stay finite.
    largest = np.abs(vectors).max(axis=1)
    unit = vectors / largest[:, None]
    length = np.sqrt((unit * unit).sum(axis=1))
    turned, norms = (unit / length[:, None]) @ rotation(vectors.shape[1], seed).T, largest * length
    return np.packbits(turned >= 0, axis=1), norms, np.abs(turned).sum(axis=1) / math.sqrt(vectors.shape[1])


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    dim = table["dim"][0].as_py()
    flat = table["embedding"].combine_chunks().flatten().to_numpy()
    return table["vec_id"].to_numpy(), flat.reshape(-1, dim)


def _vectors(raw: bytes, rows: int, dim: int) -> np.ndarray:
    """Vectors as they were stored, in single or double precision."""
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * rows * dim else np.float64).reshape(rows, dim)


def _pack(seed: int):
    def run(table: pa.Table) -> pa.Table:
        ids, vectors = _rows(table)
        codes, norms, corrections = one_bit_codes(vectors.astype(np.float64), seed)
        first = {c: table[c].slice(0, 1) for c in ("dim", "block")}
        parts = {"ids": ids, "vectors": vectors, "codes": codes, "norms": norms, "corrections": corrections}
        return pa.table(first | {k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()})

    return run


def _pack_queries(table: pa.Table) -> pa.Table:
    ids, vectors = _rows(table)
    first = {c: table[c].slice(0, 1) for c in ("dim", "q")}
    return pa.table(first | {"query_ids": pa.array([ids.tobytes()], pa.binary()), "queries": pa.array([vectors.tobytes()], pa.binary())})


def inner_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Double-precision products, summed component by component from the first."""
    total = np.zeros(len(vectors))
    for j, x in enumerate(query):
        total += x * vectors[:, j]
    return total


#: Signs of the eight bits of each byte value, the first bit first.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def code_products(turned: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Products of a rotated query with the decoded signs of each code, from its packed bytes.

    ``codes`` has a row per byte place. A table per place holds the sum of the query's eight
    components there for each byte value, so a code costs a look-up per byte.
    """
    padded = np.zeros(8 * len(codes), np.float32)
    padded[: len(turned)] = turned
    tables = padded.reshape(-1, 8) @ _SIGNS.T
    total = tables[0][codes[0]]
    for table, code in zip(tables[1:], codes[1:], strict=True):
        total += table[code]
    return total / np.float32(math.sqrt(len(turned)))


def search_block(
    query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, estimate: np.ndarray, error: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The block's ``k`` nearest: (row numbers, exact scores), nearest first, ties to smaller id.

    The best estimates are scored exactly first; their k-th score is a floor, and every
    vector whose upper bound reaches it is chosen for reranking. Products in the stored
    precision, within their rounding error, leave few of these for the exact sum.
    """
    rows = np.flatnonzero(ids != own)
    exact = lambda at: inner_products(query.astype(np.float64), vectors[at].astype(np.float64))
    # Norms beyond single precision leave no estimate: then all are chosen.
    if len(rows) > 4 * k and np.isfinite(estimate).all() and np.isfinite(error).all():
        estimate[ids == own] = -np.inf
        head = np.argpartition(estimate, -4 * k)[-4 * k :]
        floor = np.partition(exact(head), -k)[-k]
        rows = np.flatnonzero(estimate + error >= floor - 1e-6 * abs(floor))
    if len(rows) > 2 * k:
        near = (vectors[rows] @ query).astype(np.float64)
        slack = np.finfo(vectors.dtype).eps * (len(query) + 4) * math.sqrt(query.astype(np.float64) @ query) * norms[rows]
        if np.isfinite(near).all() and np.isfinite(slack).all():
            rows = rows[near + slack >= np.partition(near - slack, -k)[-k]]
    scores = exact(rows)
    order = np.lexsort((ids[rows], -scores))[:k]
    return rows[order], scores[order]


def _search(k: int, seed: int, bound: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                query_ids, ids = (np.frombuffer(row[c], np.int64) for c in ("query_ids", "ids"))
                queries, vectors = _vectors(row["queries"], len(query_ids), dim), _vectors(row["vectors"], len(ids), dim)
                norms, corrections = (np.frombuffer(row[c], np.float64) for c in ("norms", "corrections"))
                codes = np.ascontiguousarray(np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1).T)
                turned = (queries.astype(np.float64) @ rotation(dim, seed).T).astype(np.float32)
                # <o, q> = <code, q> / c up to |q| sqrt(1 - c^2) / c times a component of a random direction.
                spread = np.sqrt(np.maximum(0, 1 - corrections**2)) / corrections * min(1.0, bound / math.sqrt(max(1, dim - 1)))
                # Single precision rounds by less than the margin of 1e-5.
                scale, error = (norms / corrections).astype(np.float32), ((spread + 1e-5) * norms).astype(np.float32)
                out: list[list] = [[], [], []]
                for i, query in enumerate(queries):
                    length = math.sqrt(query.astype(np.float64) @ query)
                    estimate = scale * code_products(turned[i], codes)
                    found, scores = search_block(query, query_ids[i], ids, vectors, norms, estimate, error * np.float32(length), k)
                    for column, x in zip(out, (np.full(len(found), query_ids[i]), ids[found], scores), strict=True):
                        column.append(x)
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bound: float = 4.0,
    seed: int = 11,
    block_rows: int = 8_192,
    query_rows: int = 1_024,
) -> DataFrame:
    """The ``k`` rows of largest inner product for each query row, but for itself.

    ``is_query`` is a condition on the input's columns. Returns (query_id, rank, vec_id,
    score) with scores in double precision on the original vectors, nearest first, ties to
    the smaller id; all candidates, if fewer.

    Method: every vector is rotated at random and kept as packed signs, its norm and the
    product of its direction with the decoded signs. Blocks of codes meet blocks of queries;
    an estimate, from a table per byte of the codes, of each inner product with an error of ``bound`` standard deviations chooses
    what is scored exactly. At 4 a true neighbour is missed with a chance of about 3 in
    100,000. All rows are coded, in blocks of about ``block_rows``; only the best k of a
    block are shuffled, and merged by rank.

    Vectors that are null, empty or zero, or that hold null or non-finite components, and
    rows with null ids take no part. A repeated id counts once, with the smallest vector.
    Vectors of other lengths are no candidates. Empty tables give an empty result.
    """
    known = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), is_query.alias("asks"))
    known = known.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    known = known.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.bool_or("asks").alias("asks"))
    known = reliable_checkpoint(known.withColumn("dim", F.size("embedding")))
    sizes = known.groupBy("dim").agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.ceil(F.count_if("asks") / query_rows).cast("int").alias("asked")
    )
    sized = known.join(sizes, "dim")
    place = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.greatest(F.col(n), F.lit(1))).cast("int")
    codes = (
        sized.select("dim", place("blocks", 1).alias("block"), "vec_id", "embedding").groupBy("dim", "block").applyInArrow(_pack(seed), _PACKED)
    )
    queries = (
        sized.where("asks")
        .select("dim", place("asked", 2).alias("q"), "vec_id", "embedding")
        .groupBy("dim", "q")
        .applyInArrow(_pack_queries, "dim int, q int, query_ids binary, queries binary")
        .join(sizes.select("dim", "blocks"), "dim")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "block", "query_ids", "queries")
    )
    pairs = queries.join(codes.hint("shuffle_merge"), ["dim", "block"])
    pairs = pairs.repartition(F.xxhash64("query_ids", "block"))
    best = pairs.mapInArrow(_search(k, seed, bound), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
