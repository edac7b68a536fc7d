"""Vector codes against plain rounds that look at every entry, in Python's own integers."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import heap_lloyd
from tidemark.llm.heap_lloyd import compress_vectors, fit_codes, nearest, squared_distances

VECTORS = "vec_id long, embedding array<double>, label string, code int, error int, l string"


def lloyd_oracle(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{vec_id: (code, error, label error, digest)}; rows are (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    cut = lambda v, p: [math.floor(x * scale) for x in v[p * dim // parts : (p + 1) * dim // parts]]
    vectors = [[cut(v, p) for p in range(parts)] for _, v, _ in kept]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in vectors]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(vectors, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(vectors, codes, strict=True)]
    by = {}
    for r, e in zip(kept, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((str(r[0]), "".join(f"{x:02x}" for x in c), e, by[r[2]], digest) for r, c, e in zip(kept, codes, errors, strict=True)))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 1, "x") for i, v, lab in rows], VECTORS)


def rows_of(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def clustered(n, dim, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + rng.normal(scale=spread, size=(n, dim))).tolist()


@pytest.mark.parametrize("settings", [{}, {"entries": 9}, {"entries": 5, "rounds": 7, "scale": 16}, {"parts": 3, "entries": 20}, {"rounds": 0, "entries": 4}, {"entries": 1}])
def test_equals_plain_rounds(spark, settings, monkeypatch):
    rows = [(i * 3 % 331, v, (None, "a", "b")[i % 3]) for i, v in enumerate(clustered(330, 11, 4))]
    assert rows_of(compress_vectors(frame(spark, rows).repartition(5), **settings)) == lloyd_oracle(rows, **settings)


def test_ties_copies_nulls_and_odd_lengths(spark):
    rows = [(i, [float(i % 3), 0.0, 1.0, float(i % 2)], None) for i in range(40)]
    rows += [(100, None, "a"), (101, [1.0, None, 0.0, 0.0], "a"), (102, [1.0, math.nan, 0.0, 0.0], "a"), (103, [math.inf, 0.0, 0.0, 0.0], "a")]
    rows += [(104, [1.0, 2.0], "a"), (105, [], "a"), (None, [0.0, 0.0, 0.0, -0.001], "a"), (7, [5.0, 5.0, 5.0, 5.0], "b"), (7, [5.0, 5.0, 5.0, 5.0], "b"), (7, [-5.0, 5.0, 5.0, 5.0], "b")]
    got = compress_vectors(frame(spark, rows).repartition(3), entries=6)
    assert rows_of(got) == lloyd_oracle(rows, entries=6)


def test_empty_tables(spark):
    for rows in ([], [(1, None, "a")], [(1, [math.nan], "a")]):
        got = compress_vectors(frame(spark, rows))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0
    assert [r[1] for r in rows_of(compress_vectors(frame(spark, [(1, [], "a"), (2, [], "a")])))] == ["00000000"] * 2


def test_heaps_look_at_less_and_carry_on_through_blocks(spark, monkeypatch):
    rows = [(i, v, "a") for i, v in enumerate(clustered(3000, 8, 5, 0.01))]
    codes, books, looked = fit_codes(frame(spark, rows).coalesce(1), entries=12, rounds=6)
    assert looked[0] == 12_000 and sum(looked[3:]) < 0.2 * 12_000 * len(looked[3:])
    assert [r[1] for r in lloyd_oracle(rows, entries=12, rounds=6)] == [r.code for r in sorted(codes.collect(), key=lambda r: str(r.vec_id))]


def test_blocks_are_cut(monkeypatch):
    """A run of batches becomes blocks of a fixed size, whatever the batches' sizes."""
    import pyarrow as pa

    monkeypatch.setattr(heap_lloyd, "BLOCK", 10)
    made = []
    books = heap_lloyd.Codebooks.start(np.zeros((1, 4), np.int64), 4)
    names = ["vec_ids", "labels", "vectors", "keys", "members", "sizes", "scanned", "moved"]
    moved = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))
    kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 4, pa.int64(), moved]
    run = heap_lloyd._begin(books, 4, 1024, pa.schema(list(zip(names, kinds, strict=True))))
    batch = lambda n: pa.RecordBatch.from_pydict({"vec_id": list(range(n)), "embedding": [[0.0] * 4] * n, "label": ["a"] * n})
    for out in run(iter([batch(3), batch(25), batch(1), batch(7)])):
        made.append(len(out.column("vec_ids")[0].as_py()))
    assert sum(made) == 36 and max(made) <= 10


def test_large_components_are_exact_or_refused(spark):
    rng = np.random.default_rng(6)
    x, c = rng.integers(-(2**28), 2**28, (50, 4)), rng.integers(-(2**28), 2**28, (7, 4))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in c] for r in x]
    assert squared_distances(x, c).tolist() == want
    assert nearest(x, c)[0].tolist() == [min(range(7), key=lambda e: r[e]) for r in want]
    with pytest.raises(Exception, match="do not fit"):
        compress_vectors(frame(spark, [(1, [0.0] * 4, "a"), (2, [1e30] * 4, "a")])).collect()
