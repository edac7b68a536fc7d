"""Operator 9: n-gram Jaccard join over prefix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import broadcast_if_small, giving_back, giving_back_groups, mix64, reliable_checkpoint, shuffle_partitions, slices
from tidemark.llm.components import connected_components
from tidemark.llm.tries import link_groups, links_between
from tidemark.llm.words import Runs, Words, batch_words

#: Tokens that one task holds at once: some 100 MB with all copies that its sorts make.
SLOT_TOKENS = 1_000_000

#: Rows of names and places, 10 MB, up to which they are broadcast rather than tokens shuffled.
NARROW_ROWS = 200_000

_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(words: Words, hashes: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words make one shingle."""
    runs, bounds = Runs(hashes), words.bounds
    start = np.flatnonzero(words.left() >= k)
    tokens, cuts = runs.of(start, start + k), np.searchsorted(start, bounds)
    few = np.diff(bounds) < k
    whole = runs.of(bounds[:-1][few], bounds[1:][few])
    sets = [np.unique(tokens[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    for i, token in zip(np.flatnonzero(few).tolist(), whole, strict=True):
        if bounds[i] < bounds[i + 1]:
            sets[i] = np.array([token], np.uint64)
    return sets


def set_name(tokens: np.ndarray, seed: int) -> int:
    """A 64-bit name of a shingle set."""
    total = mix64(tokens ^ (np.uint64(seed + 1) * _FOLD)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix64(np.array([total])).view(np.int64)[0])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text", 1 << 20)


def _bytes(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _describe(k: int, seed: int):
    """Rows of (key, text) to (key, n, node, check): set size and two names of the set, which come from
    two kinds of hashes of its words, so that words that clash in one do not in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches):
            words = batch_words(part.column("text"), lower=True, kind=2 * seed)
            sets = shingle_sets(words, words.hashes, k)
            names = [[set_name(s, seed) if len(s) else None for s in group] for group in (sets, shingle_sets(words, words.named(2 * seed + 1), k))]
            columns = [[len(s) for s in sets], *names]
            yield pa.record_batch([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], [part.schema.names[0], "n", "node", "check"])

    return giving_back(run)


def _by_range(k: int, ranges: int, seed: int, most: int = 1 << 20, remembered: int = 200_000):
    """Documents to packed token arrays, one row per hash range and about ``most`` tokens.

    A task passes over sets it has sent before, of the first ``remembered`` names; copies
    that come through all the same are told apart by name in :func:`_shared_tokens`.
    """

    def pack(sets: list[np.ndarray], named: list[int]) -> pa.RecordBatch:
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        names = np.array(named, np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        at = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        order = np.argsort(at, kind="stable")
        at, tokens, owner = at[order], tokens[order], owner[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)]))
        columns: list[list] = [[], [], [], [], []]
        for low, high in zip(cuts, cuts[1:], strict=False):
            who, count = np.unique(owner[low:high], return_counts=True)
            for column, x in zip(
                columns, (int(at[low]), tokens[low:high], names[who], count.astype(np.int32), sizes[who]), strict=True
            ):
                column.append(x)
        return pa.record_batch(
            [pa.array(columns[0], pa.int32()), *map(_bytes, columns[1:])], ["slot", "tokens", "nodes", "counts", "sizes"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, named, total = [], [], 0
        seen: set[int] = set()
        for part in _texts(batches):
            words = batch_words(part.column("text"), lower=True, kind=2 * seed)
            for tokens in shingle_sets(words, words.hashes, k):
                if not len(tokens) or (name := set_name(tokens, seed)) in seen:
                    continue
                if len(seen) < remembered:
                    seen.add(name)
                sets.append(tokens)
                named.append(name)
                total += len(tokens)
                if total >= most:
                    yield pack(sets, named)
                    sets, named, total = [], [], 0
        if sets:
            yield pack(sets, named)

    return giving_back(run)


_PACKED = "slot int, tokens binary, nodes binary, counts binary, sizes binary"


def _shared_tokens(buckets: int):
    """Within a hash range: the tokens that two or more sets hold, regrouped by set."""

    def run(table: pa.Table) -> pa.Table:
        tokens = _joined(table["tokens"], np.uint64)
        counts = _joined(table["counts"], np.int32)
        node = np.repeat(_joined(table["nodes"], np.int64), counts)
        size = np.repeat(_joined(table["sizes"], np.int64), counts)
        order = np.argsort(tokens)
        ordered = tokens[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        runs = np.diff(np.append(np.flatnonzero(new), len(ordered)))
        order = order[np.repeat(runs > 1, runs)]
        tokens, node, size = tokens[order], node[order], size[order]
        order = np.lexsort((node, tokens))
        tokens, node, size = tokens[order], node[order], size[order]
        if len(tokens):
            # Copies of a document name the same set: one of them counts.
            fresh = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (node[1:] != node[:-1])))
            tokens, node, size = tokens[fresh], node[fresh], size[fresh]
        _, inverse, often = np.unique(tokens, return_inverse=True, return_counts=True)
        often = often[inverse] if len(tokens) else often
        keep = often > 1
        tokens, node, size, often = tokens[keep], node[keep], size[keep], often[keep]
        bucket = (mix64(node.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((node, bucket))
        tokens, node, size, often, bucket = tokens[order], node[order], size[order], often[order], bucket[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else []
        columns: list[list] = [[], [], [], [], [], []]
        for low, high in zip(cuts, cuts[1:], strict=False):
            who, first, count = np.unique(node[low:high], return_index=True, return_counts=True)
            for column, x in zip(
                columns,
                (int(bucket[low]), tokens[low:high], often[low:high].astype(np.int32), who, count.astype(np.int32), size[low:high][first]),
                strict=True,
            ):
                column.append(x)
        return pa.table(
            [pa.array(columns[0], pa.int32()), *map(_bytes, columns[1:])],
            ["bucket", "tokens", "often", "nodes", "counts", "sizes"],
        )

    return giving_back_groups(run)


def _alive(percent: int):
    """Within a bucket of sets: those that could still link, with tokens in an order that all sets share, rare
    ones first, their prefix, and how frequent each token is, as a power of two."""

    def run(table: pa.Table) -> pa.Table:
        tokens, often = _joined(table["tokens"], np.uint64), _joined(table["often"], np.int32)
        counts = _joined(table["counts"], np.int32)
        node = np.repeat(_joined(table["nodes"], np.int64), counts)
        size = np.repeat(_joined(table["sizes"], np.int64), counts)
        order = np.lexsort((tokens, often, node))
        tokens, node, size = tokens[order], node[order], size[order]
        classes = np.log2(np.maximum(often[order], 1)).astype(np.uint8)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1, [len(node)])) if len(node) else []
        out: list[list] = [[], [], [], [], []]
        for low, high in zip(cuts, cuts[1:], strict=False):
            n, shared = int(size[low]), int(high - low)
            least = -(-percent * n // 100)
            if shared < least:
                continue
            prefix = n - least + 1 - (n - shared)
            for column, x in zip(
                out, (int(node[low]), n, tokens[low : low + prefix].view(np.int64), tokens[low:high].tobytes(), classes[low:high].tobytes()), strict=True
            ):
                column.append(x)
        return pa.table(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())],
            ["node", "n", "prefix", "tokens", "classes"],
        )

    return giving_back_groups(run)


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Names, sizes, tokens and their classes of the rows of a table, each name once, in order."""
    node, first = np.unique(table["node"].to_numpy(), return_index=True)
    raw, kinds = table["tokens"].combine_chunks(), table["classes"].combine_chunks()
    tokens = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in first]
    return node, table["n"].to_numpy()[first], tokens, [np.frombuffer(kinds[int(i)].as_buffer(), np.uint8) for i in first]


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    none = [np.empty(0, np.int64)]
    return pa.table([pa.array(np.concatenate(none + a)), pa.array(np.concatenate(none + b))], ["a", "b"])


def _tree_join(percent: int):
    """Link the sets of each block of a group; rows (a, b) that connect what is linked."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]))
        member, root = [], []
        for low, high in zip(cuts, cuts[1:], strict=False):
            node, size, tokens, classes = _sets(table.take(pa.array(order[low:high])))
            group = link_groups(tokens, size, percent, classes)
            other = group != np.arange(len(node))
            member.append(node[other])
            root.append(node[group[other]])
        return _edges(member, root)

    return giving_back_groups(run)


def _tree_probe(percent: int):
    """Links between the asking sets of a group and its other sets of another component."""

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"]
        node, size, tokens, classes = _sets(table.filter(pc.invert(asks)))
        probe, probe_size, probe_tokens, probe_classes = _sets(table.filter(asks))
        label = dict(zip(table["node"].to_pylist(), table["label"].to_pylist(), strict=True))
        pairs = links_between(probe_tokens, probe_size, tokens, size, percent, classes + probe_classes)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for i, j in pairs:
            a, b = int(probe[i]), int(node[j])
            if label[a] != label[b]:
                found.setdefault((label[a], label[b]), (a, b))
        links = np.array(list(found.values()), np.int64).reshape(-1, 2)
        return _edges([links[:, 0]], [links[:, 1]])

    return giving_back_groups(run)


def _tile(count: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count)).cast("int")


def _pivots(placed: DataFrame, count: int = 4) -> DataFrame:
    """(node, block, tiles): a few sets of each large block, the same for all its tiles."""
    chosen = [F.min_by("node", F.xxhash64("node", F.lit(salt))) for salt in range(count)]
    return placed.where("tiles > 1").groupBy("block", "tiles").agg(F.array_distinct(F.array(*chosen)).alias("p")).select(F.explode("p").alias("node"), "block", "tiles")


def _links_across(alive: DataFrame, postings: DataFrame, placed: DataFrame, near: DataFrame, percent: int, most: int) -> DataFrame | None:
    """(a, b) edges that connect links between tiles of large blocks that ``near`` leaves apart.

    What is not of a block's largest component so far asks for links to other components, but
    only those sets that share a prefix token with one that asks, since others cannot link.
    """
    labels = placed.where("tiles > 1").join(connected_components(near).withColumnRenamed("root", "label"), "node", "left")
    labels = reliable_checkpoint(labels.select("node", "block", F.coalesce("label", "node").alias("label")))
    parts = labels.groupBy("block", "label").agg(F.count("*").alias("c"))
    main = parts.groupBy("block").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("parts"))
    main = reliable_checkpoint(main.where("parts > 1").drop("parts"))
    if main.isEmpty():
        return None
    rest = reliable_checkpoint(labels.join(broadcast_if_small(main), "block").where("label <> main").drop("main"))
    tokens = postings.join(broadcast_if_small(rest.select("node")), "node").select("token").distinct()
    tokens = reliable_checkpoint(tokens)
    met = postings.join(broadcast_if_small(tokens), "token", "left_semi").select("node").distinct()
    met = reliable_checkpoint(labels.join(reliable_checkpoint(met), "node"))
    count = lambda rows, name: rows.groupBy("block").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = reliable_checkpoint(count(rest, "asking").join(count(met, "tiles"), "block"))
    columns = ["node", "label", "block", "tile", "ask", "asks"]
    every = met.join(sizes, "block").withColumns({"tile": _tile("tiles", 7), "ask": F.explode(F.sequence(F.lit(0), F.col("asking") - 1)), "asks": F.lit(False)})
    asked = rest.join(sizes, "block").withColumns({"ask": _tile("asking", 8), "tile": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), "asks": F.lit(True)})
    rows = reliable_checkpoint(every.select(columns).unionByName(asked.select(columns)))
    held = alive.select("node", "n", "tokens", "classes").join(broadcast_if_small(rows, NARROW_ROWS), "node")
    return held.groupBy("block", "tile", "ask").applyInArrow(_tree_probe(percent), "a long, b long")


def similar_sets(
    docs: DataFrame, described: DataFrame, text_col: str, k: int, percent: int, block_sets: int, block_tokens: int, seed: int
) -> DataFrame:
    """(node, root) of every set that links with another one.

    Tokens are dealt by hash range, then by set, then once more with their blocks. A block
    too large for a task is cut into tiles; each is joined inside, together with a few pivots
    of the whole block, so that a group of near copies becomes one component in work that
    grows with its size, and :func:`_links_across` finds what is left between tiles.
    """
    spark = docs.sparkSession
    total = described.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slots = max(shuffle_partitions(spark), total // SLOT_TOKENS + 1)
    # Enough tokens in a batch for each of its slots to get a run of them.
    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(_by_range(k, slots, seed, min(1 << 23, max(1 << 20, 64 * slots))), _PACKED)
    shared = packed.groupBy("slot").applyInArrow(
        _shared_tokens(slots), "bucket int, tokens binary, often binary, nodes binary, counts binary, sizes binary"
    )
    alive = shared.groupBy("bucket").applyInArrow(_alive(percent), "node long, n long, prefix array<long>, tokens binary, classes binary")
    alive = reliable_checkpoint(alive)

    # A star per prefix token joins all sets that could link into coarse blocks.
    postings = alive.select("node", F.explode("prefix").alias("token"))
    stars = postings.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    # A checkpoint takes the sum's partitioning away: both sides are then dealt anew, and
    # a key of many rows can be split.
    stars = reliable_checkpoint(stars)
    pairs = postings.join(stars, "token").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    coarse = connected_components(pairs)

    sizes = alive.select("node", (F.length("tokens") / 8).alias("held")).join(coarse.withColumnRenamed("root", "block"), "node")
    weight = sizes.groupBy("block").agg(F.count("*").alias("sets"), F.sum("held").alias("held"))
    weight = reliable_checkpoint(
        weight.withColumn("tiles", F.ceil(F.greatest(F.col("sets") / block_sets, F.col("held") / block_tokens)).cast("int"))
    )
    tasks = max(shuffle_partitions(spark), (weight.agg(F.sum("held")).first()[0] or 0) // SLOT_TOKENS + 1)
    placed = reliable_checkpoint(sizes.drop("held").join(weight.select("block", "tiles"), "block"))
    # Small blocks share tasks; a tile has its own.
    tile = F.xxhash64("block", _tile("tiles", 7))
    own = placed.select("node", "block", F.when(F.col("tiles") > 1, tile).otherwise(F.pmod(F.xxhash64("block"), F.lit(int(tasks)))).alias("task"))
    pivots = _pivots(placed).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pivots = reliable_checkpoint(pivots.select("node", "block", F.xxhash64("block", "tile").alias("task")))
    sets = alive.select("node", "n", "tokens", "classes")
    joined = sets.join(broadcast_if_small(own, NARROW_ROWS), "node").unionByName(sets.join(broadcast_if_small(pivots), "node"))
    links = reliable_checkpoint(joined.groupBy("task").applyInArrow(_tree_join(percent), "a long, b long"))
    if not pivots.isEmpty():
        across = _links_across(alive, postings, placed, links, percent, block_sets)
        links = links if across is None else links.unionByName(across)
    return connected_components(links)


def linked_rows(
    docs: DataFrame,
    key: Column,
    text_col: str = "text",
    k: int = 5,
    percent: int = 75,
    block_sets: int = 100,
    block_tokens: int = 400_000,
) -> DataFrame:
    """(key, n, node, root) of every row: ``key`` of it, set size, set name and a name of
    its group, null for a row without words (see :func:`ngram_jaccard_join`)."""
    plain = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    schema = StructType([plain.schema["key"], *(StructField(c, LongType()) for c in ("n", "node", "check"))])
    for seed in range(8):
        described = reliable_checkpoint(plain.mapInArrow(_describe(k, seed), schema))
        twice = described.where("node IS NOT NULL").groupBy("node").agg((F.min("check") != F.max("check")).alias("clash"))
        if twice.where("clash").isEmpty():
            break
    else:
        raise ValueError("too many sets for names of 64 bits")
    described = described.drop("check")
    roots = similar_sets(docs, described, text_col, k, percent, block_sets, block_tokens, seed)
    return described.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 75,
    block_sets: int = 100,
    block_tokens: int = 400_000,
) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of k-word shingle sets.

    Returns one row per input row: ``doc_id``, ``n_shingles`` (set size) and
    ``component_id`` (smallest id reachable by links, itself included). Words are
    split at space and U+0009 to U+000D, A-Z lower-cased. Two documents link when
    100 * intersection >= ``percent`` * union.

    Method: equal sets count once. Tokens travel as packed arrays by hash range;
    each range keeps those of two or more sets. A set of which less than
    ``percent`` % is shared cannot link. Others meet in coarse blocks over their
    rarest tokens (the prefix filter), and inside a block a prefix tree is walked, whose
    order of tokens, by their frequency in all sets, is the same in every block.
    A block beyond ``block_sets`` or ``block_tokens`` is cut into tiles. Each is joined with a
    few pivots of the block, and what is not of the block's largest component then asks
    all other tiles, so no bound drops a link.

    Null or empty text, or text without words: 0 shingles, linked with nothing.
    Fewer than ``k`` words: one shingle of all. Null ids keep their row and never
    become a component id while another member has one. Repeated rows link with each
    other. An empty table gives an empty result. Other columns are not read.
    Tokens are named by 64-bit hashes. So are sets, whose names are checked by a second
    hash of the words themselves; where two sets share a name, all hashes are drawn anew.
    """
    grouped = linked_rows(docs, F.col(id_col), text_col, k, percent, block_sets, block_tokens).withColumnRenamed("key", "doc_id")
    least = reliable_checkpoint(grouped.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")))
    return grouped.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )
