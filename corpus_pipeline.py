"""A corpus pipeline over the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and
read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_round_trip
from tidemark.llm.common import WORD_PATTERN, broadcast_if_small, reliable_checkpoint, shared_folder
from tidemark.llm.line_dedup import remove_repeated_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import linked_rows
from tidemark.llm.queries import read, vocabulary
from tidemark.llm.toxicity import scored_rows
from tidemark.session import remove_folder


#: Fixed value: the score from which a text is toxic, as in ``score_toxicity``.
TOXIC = 0.7


def of_source() -> list[Column]:
    """Id and source of a row, never null; null ids and sources come last."""
    return [
        F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"),
        F.col("source").isNull().alias("m"), F.coalesce("source", F.lit("")).alias("s"),
    ]


def row_key() -> Column:
    """Names a row by id, source and a hash of its text."""
    return F.struct(*of_source(), F.xxhash64("text").alias("h"))


def held(docs: DataFrame, key: Column) -> DataFrame:
    """(d, key): each row in one struct beside its key, so that no column's name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), key.alias("key"))


def shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of the structs ``d``."""
    return rows.select(*(F.col("d").getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject, unchanged; each is judged by its own text,
    whatever its id."""
    scored = scored_rows(docs, read(spark, sf_dir, "labels"), row_key())
    rejected = reliable_checkpoint(scored.where(F.col("score") >= TOXIC).select("key").distinct())
    return shown(held(docs, row_key()).join(broadcast_if_small(rejected), "key", "left_anti"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; later repeats of word runs are cut from text, and n_chars follows.

    Rows equal in id and text count as one document and are cut alike; the next stage
    keeps one of them.
    """
    cut = remove_repeated_lines(docs)
    length = F.when(F.size("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*((length if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one: that with the smallest id, null ids last, then by
    source and text hash; of rows with the same key that with the smallest hash of all its columns, which
    may be of any type. Rows without words link with nothing and stay.
    """
    linked = linked_rows(docs, row_key()).where("root IS NOT NULL").select("key", "root")
    # Checkpoints take the sums' partitioning away, so that hot groups and keys can be split.
    best = linked.groupBy("root").agg(F.min("key").alias("best"), F.count("*").alias("c")).where("c > 1").drop("c")
    judged = linked.join(reliable_checkpoint(best), "root")
    judged = judged.groupBy("key").agg(F.first(F.col("key") == F.col("best")).alias("stays"), F.count("*").alias("c"))
    judged = reliable_checkpoint(judged.where("NOT stays OR c > 1").select("key", "stays"))
    keyed = held(docs, row_key())
    alone = keyed.join(judged.select("key"), "key", "left_anti").select("d")
    repeated = judged.where("stays").select("key")
    if repeated.isEmpty():
        return shown(alone, docs)
    one = keyed.join(broadcast_if_small(repeated), "key", "left_semi").groupBy("key").agg(F.min_by("d", F.xxhash64(F.to_json("d"))).alias("d"))
    return shown(alone.unionByName(one.select("d")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, so a document may come twice.

    The mix decides by id and source: rows that share both are taken alike, as are the
    rows of a source whose ids are null; rows without words are not taken.
    """
    mixed = mix_sources(docs).where("taken > 0")
    times = mixed.select(F.struct(*of_source()).alias("key"), F.expr("taken div size").cast("int").alias("times")).distinct()
    # The checkpoint takes the distinct rows' partitioning away, so that a key of many rows can be split.
    times = reliable_checkpoint(times)
    worded = held(docs, F.struct(*of_source())).where(F.col("d.text").rlike(WORD_PATTERN))
    return shown(worded.join(times, "key").select("d", F.explode(F.sequence(F.lit(1), F.col("times")))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and a check that they decode to its text."""
    path, pattern = vocabulary()
    return bpe_round_trip(docs, path, pattern)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: Learnt weights and token merges are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a
    stage wrote goes once the next one is written."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        place = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")
    return docs
