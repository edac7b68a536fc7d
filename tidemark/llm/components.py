"""Connected components of an edge table, in rounds of randomised contraction."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import reliable_checkpoint, shared_folder
from tidemark.session import remove_folder, stored


def _priority(node: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("p"), node.alias("v"))


def forest(x: np.ndarray, y: np.ndarray, label: np.ndarray, edges: list[np.ndarray]) -> None:
    """Add the links (x, y) that join new components; ``label`` holds each row's component."""
    while True:
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return
        high, low = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
        roots, first = np.unique(high, return_index=True)
        edges.append(np.stack((x[first], y[first]), axis=1))
        up = np.arange(len(label))
        up[roots] = low[first]
        while not np.array_equal(up, flat := up[up]):
            up = flat
        label[:] = up[label]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph to (node, to), the smallest node of each one's component."""
    table = list(batches)
    a, b = (np.concatenate([np.empty(0, np.int64), *(x.column(c).to_numpy() for x in table)]) for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = np.arange(len(nodes))
    forest(at[: len(a)], at[len(a) :], label, [])
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[label])], ["node", "to"])


def connected_components(edges: DataFrame, max_rounds: int = 60, in_a_task: int = 200_000) -> DataFrame:
    """Map every node of ``edges(a long, b long)`` to a root: ``(node, root)``.

    Each round lets every node follow the neighbour (or itself) of the smallest
    pseudo-random priority, and contracts the edges. A new order each round keeps
    long paths from costing a round per link: a constant share of the nodes goes
    each time, so rounds grow with the logarithm of the node count. Hot nodes cost
    no task their whole neighbourhood, because minima are pre-aggregated and the
    joins can be split. Once at most ``in_a_task`` edges are left, 3 MB of them, one task
    ends the work, as rounds over so few cost more than they do. Roots are arbitrary members of their component. Nulls and
    self-loops are ignored; no edges give an empty table.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    live = stored(edges.select("a", "b").where("a <> b").distinct(), f"{folder}/edges")
    maps: list[DataFrame] = []
    for turn in range(max_rounds):
        left_over = live.count()
        if left_over == 0:
            break
        if left_over <= in_a_task:
            maps.append(stored(live.coalesce(1).mapInArrow(_whole, "node long, to long"), f"{folder}/map-{turn}"))
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        follow = both.groupBy("a").agg(
            F.least(F.min(_priority(F.col("b"), turn)), _priority(F.col("a"), turn))["v"].alias("to")
        )
        follow = stored(follow.withColumnRenamed("a", "node"), f"{folder}/map-{turn}")
        maps.append(follow)
        left = follow.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = follow.select(F.col("node").alias("b"), F.col("to").alias("y"))
        live = live.join(left, "a").join(right, "b").where("x <> y")
        live = stored(live.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{folder}/edges-{turn}")
    else:
        raise RuntimeError("contraction did not end")
    if not maps:
        roots = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        # Later maps are smaller: compose from the back, a step at a time.
        roots = maps[-1].withColumnRenamed("to", "root")
        for turn, earlier in reversed(list(enumerate(maps[:-1]))):
            later = roots.select(F.col("node").alias("to"), F.col("root").alias("end"))
            roots = stored(earlier.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("root")), f"{folder}/roots-{turn}")
    roots = reliable_checkpoint(roots)
    remove_folder(spark, folder)
    return roots
