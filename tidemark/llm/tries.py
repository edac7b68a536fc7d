"""A prefix tree over ordered token sets and the joins that walk it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class PrefixTree:
    """Path-compressed prefix tree of sorted token-rank arrays.

    Each node keeps its token segment, the longest remainder and the smallest full
    set size below it, so a walk can share the overlap of a common prefix between
    all sets under it and leave subtrees that cannot reach the threshold.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, members: list[int]):
        order = sorted(members, key=lambda i: sets[i].astype(">u4").tobytes())
        #: segment, depth at its end, children, leaf, longest remainder, smallest size
        self.nodes: list[list] = [[np.empty(0, np.int64), 0, [], [], 0, 0]]
        stack, last = [0], None
        for i in order:
            tokens = sets[i]
            shared = 0
            if last is not None:
                n = min(len(last), len(tokens))
                differ = np.flatnonzero(last[:n] != tokens[:n])
                shared = int(differ[0]) if len(differ) else n
            while self.nodes[stack[-1]][1] > shared:
                top = stack.pop()
                parent = stack[-1]
                if self.nodes[parent][1] < shared:  # split the edge at the shared depth
                    begin = self.nodes[parent][1]
                    segment = self.nodes[top][0]
                    middle = len(self.nodes)
                    self.nodes.append([segment[: shared - begin], shared, [top], [], 0, 0])
                    self.nodes[top][0] = segment[shared - begin :]
                    self.nodes[parent][2][-1] = middle
                    stack.append(middle)
            if len(tokens) > shared:
                self.nodes.append([tokens[shared:], len(tokens), [], [], 0, 0])
                self.nodes[stack[-1]][2].append(len(self.nodes) - 1)
                stack.append(len(self.nodes) - 1)
            self.nodes[stack[-1]][3].append(i)
            last = tokens
        self._bound(sizes)

    def _bound(self, sizes: np.ndarray) -> None:
        walk, order = [0], []
        while walk:
            order.append(at := walk.pop())
            walk.extend(self.nodes[at][2])
        for at in reversed(order):
            node = self.nodes[at]
            below = [self.nodes[c] for c in node[2]]
            node[4] = max([c[4] + len(c[0]) for c in below], default=0)
            node[5] = min([*(int(sizes[i]) for i in node[3]), *(c[5] for c in below)])

    def linked(self, probe: np.ndarray, size: int, sizes: np.ndarray, percent: int, mask: np.ndarray) -> list[int]:
        """Members whose Jaccard similarity with the probe is ``percent`` or more."""
        mask[probe] = True
        total, found = len(probe), []
        walk = [(0, 0)]
        while walk:
            at, overlap = walk.pop()
            segment, _, children, leaves, rest, least = self.nodes[at]
            if len(segment):
                left = total - int(np.searchsorted(probe, segment[0], "left"))
                if (100 + percent) * (overlap + min(left, len(segment) + rest)) < percent * (size + least):
                    continue
                overlap += int(np.count_nonzero(mask[segment]))
            for i in leaves:
                if (100 + percent) * overlap >= percent * (size + int(sizes[i])):
                    found.append(i)
            if children:
                left = total - (int(np.searchsorted(probe, segment[-1], "right")) if len(segment) else 0)
                if (100 + percent) * (overlap + min(left, rest)) >= percent * (size + least):
                    walk.extend((c, overlap) for c in children)
        mask[probe] = False
        return found


def ranked_sets(tokens: list[np.ndarray], classes: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], int]:
    """Each set as sorted ranks of its tokens, and how many different tokens there are.

    Frequent tokens come first: common prefixes are long, and their overlaps are shared. ``classes`` say
    how frequent a token is in all sets, so that every tree has the same order; without them
    the sets at hand are counted.
    """
    names, first, inverse, often = np.unique(np.concatenate(tokens), return_index=True, return_inverse=True, return_counts=True)
    if classes is not None:
        often = np.concatenate(classes).astype(np.int64)[first]
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -often))] = np.arange(len(names))
    ranked = rank[inverse]
    cuts = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
    return [np.sort(ranked[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], len(names)


def links_between(
    probes: list[np.ndarray], probe_sizes: np.ndarray, tokens: list[np.ndarray], sizes: np.ndarray, percent: int, classes: list[np.ndarray] | None = None
) -> Iterator[tuple[int, int]]:
    """Pairs (number of a probe, number of a set) of Jaccard >= ``percent``/100; ``classes`` are those
    of the sets, then those of the probes (see :func:`ranked_sets`)."""
    if not probes or not tokens:
        return
    sets, different = ranked_sets([*tokens, *probes], classes)
    tree, mask = PrefixTree(sets[: len(tokens)], sizes, list(range(len(tokens)))), np.zeros(different, bool)
    for i, probe in enumerate(sets[len(tokens) :]):
        for j in tree.linked(probe, int(probe_sizes[i]), sizes, percent, mask):
            yield i, j


def link_groups(tokens: list[np.ndarray], sizes: np.ndarray, percent: int, classes: list[np.ndarray] | None = None) -> np.ndarray:
    """Component number of each set, where sets of Jaccard >= ``percent``/100 link.

    ``tokens`` hold what a set shares with any other, ``sizes`` the full set sizes.
    A found set leaves the tree and becomes a probe itself, so a group whose members
    link is not compared pair by pair, and no link between components is missed.
    """
    count = len(tokens)
    group = np.full(count, -1, np.int64)
    sets, different = ranked_sets(tokens, classes)
    mask = np.zeros(different, bool)
    waiting = set(range(count))
    tree, built = None, 0
    for start in range(count):
        if group[start] >= 0:
            continue
        group[start] = start
        waiting.discard(start)
        queue = [start]
        while queue and waiting:
            if tree is None or len(waiting) * 2 < built:
                built = len(waiting)
                tree = PrefixTree(sets, sizes, sorted(waiting))
            probe = queue.pop()
            for i in tree.linked(sets[probe], int(sizes[probe]), sizes, percent, mask):
                if i in waiting:
                    waiting.discard(i)
                    group[i] = start
                    queue.append(i)
    return group
