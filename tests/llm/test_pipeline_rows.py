"""Rows that repeat an id or have none, through the stages of the corpus pipeline."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from test_pipeline import DOCUMENTS, planted

WORDS = [f"w{i}" for i in range(400)]


def text(k, n=40):
    return " ".join(WORDS[k : k + n])


def after(spark, stage, rows, folder=""):
    return Counter(tuple(r) for r in stage(spark, spark.createDataFrame(rows, DOCUMENTS), folder).collect())


def test_toxic_rows_go_by_their_text(spark, tmp_path):
    rows, labels = planted()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    vile = next(r[1] for r in rows if r[1] and " vile " in r[1])
    clean = next(r[1] for r in rows if r[1] and " vile " not in r[1] and " foul " not in r[1])
    toxic = [(None, vile, "en", "s0", 1), (900, vile, "en", "s0", 1)]
    fine = [(None, clean, "en", "s0", 1), (900, clean, "en", "s0", 1), (900, clean, "en", "s1", 1)]
    got = after(spark, corpus_pipeline.drop_toxic, rows + toxic + fine, str(tmp_path))
    assert not any(got[r] for r in toxic) and all(got[r] == 1 for r in fine)


def test_one_row_of_each_group(spark):
    first = (1, text(0), "en", "a", 1)
    rows = [first, first, first, (2, text(0), "en", "a", 1), (None, text(0), "en", "a", 1), (1, text(0), "en", "b", 1)]
    nobody = [(None, text(100), "en", "b", 1), (None, text(100), "en", "a", 1), (None, text(100), "en", None, 1)]
    # An id of a group's later row names another row that is alone.
    alone = [(2, text(200), "en", "a", 1), (None, text(300), "en", "a", 1), (3, "", "en", "a", 0), (3, "", "en", "a", 0), (None, None, None, None, None)]
    got = after(spark, corpus_pipeline.keep_one_of_each, rows + nobody + alone)
    assert got == Counter([first, nobody[1], *alone])


def test_mix_takes_each_row_by_its_source(spark):
    # Source a is small and of weight 3, so each of its rows is taken twice, nameless or not.
    small = [(None, text(0), "en", "a", 1), (1, text(40), "en", "a", 1), (1, "", "en", "a", 0)]
    large = [(i, text(i % 300), "en", "b", 1) for i in range(1, 60)]
    got = after(spark, corpus_pipeline.mix, small + large)
    assert [got[r] for r in small] == [2, 2, 0]
    # An id of two sources is taken in each as that source's other ids are.
    assert max(got[r] for r in large) - min(got[r] for r in large) <= 1 and sum(got[r] for r in large) < 1.6 * len(large)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows, labels = planted()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows += [rows[0], rows[0]]
    schema = DOCUMENTS + ", `a.b` int, times int, key string, d int, removed_words int, stays boolean, root long, tags map<string, array<int>>"
    docs = spark.createDataFrame([(*r, 1, 2, "k", 3, 4, True, 5, {"m": [i]}) for i, r in enumerate(rows)], schema)
    docs = docs.withColumn("any", F.parse_json(F.lit('{"a": 1}')))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        kept = [c for c in docs.columns if c != "removed_words"] if stage is corpus_pipeline.drop_repeated_lines else docs.columns
        assert [c for c in out.columns if c in kept] == kept
        assert {tuple(r)[5:9] for r in out.collect()} == {(1, 2, "k", 3)}
