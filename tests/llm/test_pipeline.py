"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
import sys

import numpy as np
import pytest

import corpus_pipeline
from tests_support import dedup_oracle, jaccard_oracle, tiktoken_encoding_of
from tidemark.llm.mixing import mix_sources
from tidemark.llm.toxicity import score_toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(4000)}"
    line = lambda k: " ".join(word() for _ in range(k))
    passage = line(55)
    rows, labels = [], []
    for i in range(240):
        lines = [line(int(rng.integers(8, 30))) for _ in range(5)]
        if i % 20 == 0:
            lines[3:3] = [passage]
        if i % 4 == 1:
            lines[1] = f"{line(4)} {('vile', 'foul')[i % 8 > 3]} {line(4)}"
        text = "\n".join(lines)
        if i % 15 == 14:
            text = rows[i - 4][1]
            # Changed often enough that no 50 words in a row are shared, so that line dedup leaves it whole.
            words = text.split()
            words[24::45] = [f"changed{i}"] * len(words[24::45])
            text = " ".join(words)
        if i % 30 == 29:
            text = rows[i - 9][1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(" vile " in text or " foul " in text)))
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0), (502, "short", "en", None, 5), (None, "no id here", "en", "s1", 10)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, labels = planted()
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()])

    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = score_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("predicted = 1").collect()
    rejected = {r["doc_id"] for r in scored}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r[0] not in rejected)
    toxic = {r[0] for r in before if r[1] and (" vile " in r[1] or " foul " in r[1])}
    assert len(rejected & toxic) >= 0.9 * len(toxic) and not rejected - toxic

    before, after = kept["line dedup"]
    want = dedup_oracle([r[:2] for r in before])
    assert sorted((str(r[0]), str(r[1])) for r in after) == sorted((str(r[0]), str(want[r[0], r[1]][0] if r[1] is not None else None)) for r in before)
    assert all(r[4] == (len(r[1]) if r[1] is not None else None) for r in after)

    before, after = kept["n-gram Jaccard join"]
    groups = jaccard_oracle([r[:2] for r in before])
    stay = {d for d, _, c in groups if d is None or d == c}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r[0] in stay)
    assert len(after) < len(before)

    before, after = kept["mixing"]
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mix_sources(spark.createDataFrame(before, DOCUMENTS)).collect() if r["size"]}
    assert sorted(map(str, after)) == sorted(str(r) for r in before for _ in range(times.get(r[0], 0) if r[0] is not None else 0))

    before, after = kept["byte-level BPE"]
    encoding = tiktoken_encoding_of()
    want = []
    for r in before:
        ids = encoding.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(str, after)) == sorted(map(str, want))


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 100
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert "corpus_pipeline" in sys.modules
