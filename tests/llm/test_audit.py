"""The filter audit against filters applied one after another, order by order."""

import re
from itertools import permutations

import pytest

from tidemark.llm.audit import failure_masks, interaction_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, mask int, n long, part string"
LABELS = "doc_id long, quality int, toxic int, id string"


def audit_oracle(docs, labels):
    """{(part, order, step): figures} by running every order over every document."""
    known = {}
    for d, q, t in labels:
        if d is not None:
            good, bad = known.get(d, (False, False))
            known[d] = (good or q == 1, bad or t == 1)
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = WORDS.findall(t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if d is not None and d > least[t] else set()
        rows.append((lang or "", fails, *known.get(d, (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                again = sum(f in r[1] for r in gone)
                left = [r for r in left if f not in r[1]]
                gone += here
                only = sum(r[1] == {f} for r in rows if r[0] == part)
                out[part, "".join(order), step] = [len(left), len(here), again, only, sum(r[2] for r in here), sum(r[3] for r in here)]
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(frame):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in frame.collect()}


def cases():
    long = " ".join(f"word{i}" for i in range(260))
    texts = [long, long + " $5", "LOUD " * 300, "x " * 250, "", None, "short & LOUD", long.upper(), "é" * 50_000 + " Ü" * 300, "a b " * 210]
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)]
    docs += [(100 + i, long, "en") for i in range(6)] + [(50, long, "de"), (50, long, "de"), (50, "LOUD", "fr"), (50, long, "fr")]
    docs += [(None, long, "en"), (None, None, None), (None, "x " * 250, "fr"), (-3, "short & LOUD", "de")]
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (50, 1, None), (50, None, 1), (101, 1, 0), (101, 0, 0), (None, 1, 1), (999, 1, 1), (-3, None, None), (4, 1, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def audited(spark):
    docs, labels = cases()
    frame = spark.createDataFrame([(*r, 7, 7, "x") for r in docs], DOCS)
    masks = failure_masks(frame, spark.createDataFrame([(*r, "x") for r in labels], LABELS))
    return rows_of(interaction_audit(masks))


def test_equals_every_order_applied(audited):
    assert audited == audit_oracle(*cases())


def test_shapley_adds_up(audited):
    """Over the filters it is 120 times the documents that fail any."""
    docs, _ = cases()
    for part in {p for p, _, _ in audited}:
        by = {order[step - 1]: v[6] for (p, order, step), v in audited.items() if p == part}
        kept = audited[part, "ABCDE", 5][0]
        assert sum(by.values()) == 120 * (sum((lang or "") == part for _, _, lang in docs) - kept)


def test_no_documents_no_rows(spark):
    masks = failure_masks(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert interaction_audit(masks).count() == 0


def test_no_labels_and_other_filters(spark):
    masks = spark.createDataFrame([("", False, False, 3, 5), ("", False, False, 0, 2), ("", True, False, 1, 1)], "part string, good boolean, toxic boolean, mask int, n long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in interaction_audit(masks, "XY").collect()}
    assert got == {("XY", 1): (2, 6, 0, 1, 1, 7), ("XY", 2): (2, 0, 5, 0, 0, 5), ("YX", 1): (3, 5, 0, 0, 0, 5), ("YX", 2): (2, 1, 5, 1, 1, 7)}
    with pytest.raises(ValueError):
        interaction_audit(masks, "ABCDEFG")
