"""Operator 8: toxicity by FTRL-proximal logistic regression over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import fold_hashes, giving_back, slices
from tidemark.llm.words import batch_words, span_hashes

#: A-Z lower-cased, other ASCII that is no letter or digit to a space; other bytes stay.
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class FtrlSettings:
    """Rates, penalties and bounds of training."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    epochs: int = 4
    #: At most this many labelled rows are read for training, chosen by a hash of their id.
    max_documents: int = 16_000
    seed: int = 5


#: Bytes of a word that make its stem.
STEM_BYTES = 5


def features(texts: pa.Array, bits: int, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of words, their stems, neighbouring pairs and pairs with one word
    between, each pair once, in order; of the ``counted`` buckets alone, if given.

    A stem, a word's first bytes, lets rare forms of a word share what is learnt.
    """
    words = batch_words(texts, translate=_PLAIN)
    stems = span_hashes(words.data, words.starts, np.minimum(words.starts + STEM_BYTES, words.ends))
    w, left = words.hashes, words.left()
    row = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    two, three = np.flatnonzero(left > 1), np.flatnonzero(left > 2)
    kinds = (
        (row, fold_hashes([w])),
        (row, fold_hashes([stems, np.full(len(stems), STEM_BYTES, np.uint64)])),
        (row[two], fold_hashes([w[two], w[two + 1]])),
        (row[three], fold_hashes([w[three], w[three + 2], w[three + 2]])),
    )
    rows = np.concatenate([r for r, _ in kinds]).astype(np.uint64)
    buckets = np.concatenate([h for _, h in kinds]) >> np.uint64(64 - bits)
    if counted is not None:
        use = counted[buckets]
        rows, buckets = rows[use], buckets[use]
    pairs = np.unique(rows << np.uint64(bits) | buckets)
    return (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)


def packed(buckets: np.ndarray) -> bytes:
    """Ascending numbers as steps of two bytes; 65535 is part of a longer step."""
    step = np.diff(buckets, prepend=0)
    long = step // 65535
    out = np.full(len(step) + int(long.sum()), 65535, np.uint16)
    out[np.cumsum(long + 1) - 1] = step % 65535
    return out.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    step = np.frombuffer(raw, np.uint16)
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def ftrl(rows: list[np.ndarray], labels: list[int], settings: FtrlSettings) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on presence features.

    The per-coordinate update of FTRL-proximal: each coordinate has its own rate from the
    squares of its gradients, and weights within the L1 penalty are exactly zero.
    """
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(settings.seed)

    def weights(at: np.ndarray) -> np.ndarray:
        # The bias, in the last place, has no penalty.
        l1 = np.where(at == size, 0.0, settings.l1)
        step = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / step)

    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            gradient = 1 / (1 + np.exp(-min(max(w.sum(), -35.0), 35.0))) - labels[i]
            rate = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / settings.alpha
            z[at] += gradient - rate * w
            n[at] += gradient * gradient
    w = weights(np.arange(size + 1))
    return w[:size], float(w[size])


def _hash(bits: int):
    """Rows of (key, label, text) to (key, label, at), the text's packed buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, bucket = features(part.column("text"), bits)
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                at = pa.array([packed(bucket[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.record_batch([part.column("key"), part.column("label"), at], ["key", "label", "at"])

    return giving_back(run)


def _train(settings: FtrlSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, end = [], 1 << settings.bits
        for batch in batches:
            key, label, at = batch.columns
            for i in range(len(batch)):
                rows.append((key[i].as_py(), label[i].as_py(), np.append(unpacked(at[i].as_py()), end).astype(np.int32)))
        w, bias = ftrl([r[2] for r in rows], [r[1] for r in rows], settings) if rows else (np.zeros(1), 0.0)
        at = np.flatnonzero(w)
        yield pa.record_batch(
            [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], bias), pa.float64())], ["bucket", "weight"]
        )

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, settings: FtrlSettings, id_col: str, text_col: str, label_col: str) -> dict[int, float]:
    """Non-zero weights by bucket, and the bias at -1, from a bounded sample of labelled rows.

    ``usable`` is a condition on the labels' id column, named ``doc_id``. Null labels,
    and ids with contradicting labels, are left out. The sample holds
    ``max_documents`` rows at most, so one task trains on it.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.where(usable & F.col("label").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    marked = marked.where("label = most").select("doc_id", "label", F.xxhash64("doc_id", F.lit(settings.seed)).alias("key"))
    chosen = marked.orderBy("key", "doc_id").limit(settings.max_documents)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The limit bounds what is broadcast, so no text but the sample's is shuffled.
    sample = texts.join(F.broadcast(chosen), "doc_id").select("key", "label", F.coalesce("text", F.lit("")).alias("text"))
    # Texts are hashed where they are read; the task that trains gets numbers, in a fixed order.
    hashed = sample.mapInArrow(_hash(settings.bits), "key long, label int, at binary")
    hashed = hashed.orderBy("key", "label", "at").limit(settings.max_documents)
    learnt = hashed.repartition(1).sortWithinPartitions("key", "label", "at").mapInArrow(_train(settings), "bucket long, weight double")
    return {r["bucket"]: r["weight"] for r in learnt.collect()}


def _score(model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sparse = model.value
        dense = np.zeros(1 << bits)
        bias = sparse.get(-1, 0.0)
        for at, w in sparse.items():
            if at >= 0:
                dense[at] = w
        counted = dense != 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, bucket = features(part.column("text"), bits, counted)
                total = bias + np.bincount(row, dense[bucket], len(part))
                scores = 1 / (1 + np.exp(-np.clip(total, -35.0, 35.0)))
                yield pa.record_batch([part.column(0), pa.array(scores, pa.float64())], [part.schema.names[0], "score"])

    return giving_back(run)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored_rows(
    docs: DataFrame, labels: DataFrame, key: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: FtrlSettings = FtrlSettings()
) -> DataFrame:
    """(key, score) of every row, its ``key`` being any column of ``docs`` (see :func:`score_toxicity`)."""
    weights = train_toxicity(docs, labels, ~held_out(F.col("doc_id")), settings, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    known = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    return known.mapInArrow(_score(model, settings.bits), StructType([known.schema["key"], StructField("score", DoubleType())]))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    settings: FtrlSettings = FtrlSettings(),
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Only labels of rows that are not held out are learnt (see :func:`held_out`); an input
    of the score is the text alone. The model is broadcast as its non-zero weights, at
    most 2 to the power of ``bits`` pairs. Scoring shuffles nothing and holds one text's
    features at a time.

    Null and empty texts get the score of the bias. Null or repeated ids keep their rows;
    null ids are not held out. Without labels every score is 0.5. An empty table gives an
    empty result. Other columns are not read.
    """
    scored = scored_rows(docs, labels, F.col(id_col), id_col, text_col, label_col, settings).withColumnRenamed("key", "doc_id")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
