"""Operators 2, 5 and 9 against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests_support import jaccard_oracle, roots, thue_morse
from tidemark.llm.ann import code_products, nearest_neighbours, one_bit_codes, rotation
from tidemark.llm.components import connected_components
from tidemark.llm.neardup import embedding_near_duplicates, quantise
from tidemark.llm.ngram_join import ngram_jaccard_join
from tidemark.llm.tries import link_groups, links_between


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=14), st.integers(0, 3))
def test_trie_links_equal_brute_force(sets, unique):
    tokens = [np.array(sorted(s), np.uint64) for s in sets]
    sizes = np.array([len(s) + (i % (unique + 1)) for i, s in enumerate(sets)])
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if 175 * len(sets[i] & sets[j]) >= 75 * (sizes[i] + sizes[j])
    ]
    want = roots(links, range(len(sets)))
    half = len(tokens) // 2
    met = set(links_between(tokens[:half], sizes[:half], tokens[half:], sizes[half:], 75))
    assert met == {(j, i - half) for i, j in links if j < half <= i}
    # In the order of the sets at hand, and in one that is given for all.
    for classes in (None, [(t % 3).astype(np.uint8) for t in tokens]):
        got = link_groups(tokens, sizes, 75, classes)
        assert len({(want[i], int(got[i])) for i in want}) == len(set(want.values())) == len(set(got.tolist()))


@pytest.mark.parametrize("in_a_task", [0, 30, 200_000])
def test_components_of_paths_stars_and_loops(spark, in_a_task):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), in_a_task=in_a_task).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(100, 130)), [200, 201]]
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def near_copies(rng, count, words=60, edits=3):
    base = [f"w{rng.integers(1000)}" for _ in range(words)]
    for _ in range(count):
        copy = list(base)
        for at in rng.integers(words, size=rng.integers(0, edits + 1)):
            copy[at] = f"x{rng.integers(1000)}"
        yield " ".join(copy)


@pytest.mark.parametrize("block_sets", [4000, 7, 2])
def test_ngram_join_equals_brute_force(spark, block_sets):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [t for _ in range(6) for t in near_copies(rng, 12)]
    texts += [f"{' '.join(f'u{rng.integers(10**6)}' for _ in range(50))} {passage}" for _ in range(15)]
    texts += [None, "", " \t\n", "One two", "one TWO", "one two three", "é É one two three", "é É one two three", "a " * 3000]
    texts += [f"q r s t {word}" for word in thue_morse(1024)]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(5000, texts[0]), (5000, texts[0]), (5001, "one two")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n long, component_id int")
    got = ngram_jaccard_join(df, block_sets=block_sets).collect()
    assert sorted((tuple(r) for r in got)) == jaccard_oracle(rows)


def test_ngram_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in ngram_jaccard_join(nulls).collect())))
    assert got == ["(4, 1, 4)", "(None, 0, None)", "(None, 1, 4)"]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40))
def test_quantisation_bound_holds(seed, dim):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((6, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, norm, lost = quantise(x)
    estimate = (codes.astype(np.float64) @ codes.T.astype(np.float64)) * scale[:, None] * scale
    bound = norm[:, None] * lost + lost[:, None] * norm + lost[:, None] * lost + 1e-9
    assert (np.abs(x @ x.T - estimate) <= bound).all()


def cosine_oracle(rows):
    def ok(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [i for i, (_, v, label) in enumerate(rows) if ok(v, label)]
    links = []
    for i in good:
        for j in good:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links.append((i, j))
    top = roots(links, range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        least[top[i]] = min(r[0], least.get(top[i], r[0]))
    return sorted((r[0], sum(i in x for x in links), least[top[i]], r[0] == least[top[i]]) for i, r in enumerate(rows))


@pytest.mark.parametrize("tile", [1024, 9])
def test_near_duplicates_equal_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        v = rng.standard_normal(16) if i % 4 == 0 else np.array(rows[-1][1]) + 0.18 * rng.standard_normal(16)
        rows.append((1000 - i, [float(np.float32(x)) for x in v], int(i % 40 > 20)))
    nan, inf = float("nan"), float("inf")
    rows += [(2000 + i, rows[i // 3][1], rows[i // 3][2]) for i in range(12)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [nan] + [1.0] * 15, 1), (3003, [inf] + [1.0] * 15, 1), (3004, [None] + [1.0] * 15, 1)]
    rows += [(3005, rows[0][1], None), (3006, [1.0, 0.0], 0), (3007, [2.0, 0.0], 0), (3008, [], 0), (3009, [-0.0, 1.0], 0), (3010, [0.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, links int")
    got = embedding_near_duplicates(df, tile_rows=tile).collect()
    assert sorted(tuple(r) for r in got) == cosine_oracle(rows)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dim", [1, 7, 8, 64, 70])
def test_packed_codes_give_the_products_of_their_signs(dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((50, dim))
    codes, norms, corrections = one_bit_codes(x, 3)
    turned, query = x / norms[:, None] @ rotation(dim, 3).T, rng.standard_normal(dim).astype(np.float32)
    signs = np.where(turned >= 0, 1, -1) / np.sqrt(dim)
    assert np.allclose(code_products(query, np.ascontiguousarray(codes.T)), signs @ query, atol=1e-5)
    assert np.allclose(corrections, (turned * signs).sum(axis=1))


def test_nearest_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 32)).astype(np.float32)
    x[5] = x[9] = x[20]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (None, x[0].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, block_rows=150, query_rows=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 600, 20):
        scores = x.astype(np.float64) @ x[q].astype(np.float64)
        want = [i for i in sorted(range(600), key=lambda i: (-round(scores[i], 9), i)) if i != q][:20]
        mine = [v for _, v, _ in sorted(got[q])]
        hits += len(set(want) & set(mine))
        total += 20
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in got[q])
    assert hits / total >= 0.99 and set(got) == set(range(0, 600, 20))


def test_nearest_neighbours_of_extreme_vectors(spark):
    x = np.random.default_rng(6).standard_normal((120, 8)) * 1e60
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=5).collect()}
    for q in range(0, 120, 20):
        scores = x @ x[q]
        want = [int(i) for i in np.argsort(-scores) if i != q][:5]
        assert [got[q, r] for r in range(1, 6)] == want


def test_nearest_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest_neighbours(df, F.lit(True)).orderBy("query_id").collect()] == [(0, 1, 1, 0.5), (1, 1, 0, 0.5)]
    assert nearest_neighbours(df.where("vec_id > 9"), F.lit(True)).count() == 0
