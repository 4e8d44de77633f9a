"""Extremely randomised trees, grown level by level over a distributed table.

All trees grow together. For the open nodes of a level the executors find the least
and greatest value of each drawn feature (a first pass), a cut is drawn between
them, and the executors count the classes on either side of each cut (a second
pass). Both passes end in a combined aggregate, and the best cut of a node is chosen
before anything is collected: the driver holds nodes, never rows.

A training set of at most WHOLE_BYTES is not worth two jobs a level: each of a few
tasks gets all of its rows by a shuffle and grows some of the trees whole. The nodes are the same.

In a larger set only the nodes above LOCAL_BYTES are cut level by level. The rows of
every smaller open node go to one task, which grows all that is below it, all nodes of a
level at once. These parts are a table in the shared folder, for there are about as many nodes as
rows in a tree: rows to predict are sent to the parts that they fall into. Both ways a few trees go at a time,
as many as have WAVE_BYTES of rows for each core, and leave no shuffle files: the disk does not grow with the trees.

What is drawn at a node depends on (seed, tree, node) only, below the bound on (seed, tree, the part's
first node, level), so a model does not depend on how its rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadix.sources.shared import passing, scratch, written

TREES, SHARE = 200, 0.1
LOCAL_BYTES = 64 << 20  # features of a training set that one task may hold
WHOLE_BYTES = 4 << 20  # features of a training set that is grown node by node: beyond that the calls for each node cost more than the rows
LOCAL_TASKS = 32  # copies of such a set
WAVE_BYTES = 4 * LOCAL_BYTES  # of rows x trees that are dealt to parts at a time, for each core: what is on disk of them
HELD = 8 << 20  # numbers that a task holds of the open nodes, and again of a portion of rows
BLOCK = 1 << 20  # bytes of rows that travel as one value
CUTS, CUT_ROWS = 31, 2048  # cuts of a feature in a forest's nodes above the bound: quantiles of so many rows
PART = "tree int, node int, feature binary, cut binary, down binary, counts binary"


def drawn(seed: int, tree: int, node: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A node's order of the features, and where between least and greatest value each one's cut lies."""
    rng = np.random.default_rng((seed, tree, node))
    return rng.permutation(width), rng.random(width)


@dataclass
class Tree:
    """Nodes by number: the feature that they cut (-1: leaf), the cut, their two children and their rows by class."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    down: list[tuple[int, int]] = field(default_factory=list)
    counts: list[list[int]] = field(default_factory=list)

    def add(self, counts: list[int]) -> int:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.down.append((-1, -1))
        self.counts.append(counts)
        return len(self.feature) - 1

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int32), np.array(self.cut), np.array(self.down, np.int32)

    def proba(self) -> np.ndarray:
        c = np.array(self.counts, float)
        return c / c.sum(1, keepdims=True)


def walk(packed: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The node in which each row of ``x`` ends."""
    feature, cut, down = packed
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while len(rows := rows[feature[at[rows]] >= 0]):
        here = at[rows]
        at[rows] = down[here, (x[rows, feature[here]] > cut[here]).astype(int)]
    return at


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _in_nodes(batches: Iterator[pa.RecordBatch], packed: list, slots: list[np.ndarray], rows: int) -> Iterator[tuple]:
    """(tree, x, y, each row's slot, slots that have rows here, where their rows begin), at most ``rows`` rows in the order of their open node."""
    for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
        x, y = matrix(batch["features"]), batch["y"].to_numpy(zero_copy_only=False).astype(np.int64)
        for t, (tree, slot) in enumerate(zip(packed, slots, strict=True)):
            if (slot >= 0).any():
                at = slot[walk(tree, x)]
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0):]
                if len(order):
                    own, starts = np.unique(at[order], return_index=True)
                    yield t, x[order], y[order], np.repeat(own, np.diff([*starts, len(order)])), own, starts


def _ranges(packed, slots, asked):
    """Least and greatest value by (tree, slot, j); asked[tree] has each slot's features, -1 beyond its last."""
    def out(low, high) -> Iterator[pa.RecordBatch]:
        for t, (a, b) in enumerate(zip(low, high, strict=True)):
            i, j = np.nonzero(a <= b)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), t, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(a[i, j]), pa.array(b[i, j])],
                                                 ["tree", "slot", "j", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = [np.full(a.shape, np.inf) for a in asked], [np.full(a.shape, -np.inf) for a in asked]
        for t, x, _, slot, own, starts in _in_nodes(batches, packed, slots, max(1, HELD // asked[0].shape[1])):
            values = x[np.arange(len(x))[:, None], np.maximum(asked[t][slot], 0)]
            low[t][own] = np.minimum(low[t][own], np.minimum.reduceat(values, starts, axis=0))
            high[t][own] = np.maximum(high[t][own], np.maximum.reduceat(values, starts, axis=0))
        for a, lo in zip(asked, low, strict=True):
            lo[a < 0] = np.inf
        for a, hi in zip(asked, high, strict=True):
            hi[a < 0] = -np.inf
        yield from out(low, high)

    return run


def _sides(packed, slots, features, cuts, classes):
    """Rows by class left and right of each candidate cut, by (tree, slot, j)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros((*f.shape, classes), np.int64) for f in features]
        right = [np.zeros((*f.shape, classes), np.int64) for f in features]
        hot = np.eye(classes, dtype=np.int64)
        for t, x, y, slot, own, starts in _in_nodes(batches, packed, slots, max(1, HELD // (features[0].shape[1] * classes))):
            low = x[np.arange(len(x))[:, None], np.maximum(features[t][slot], 0)] <= cuts[t][slot]
            here = np.add.reduceat(hot[y], starts, axis=0)[:, None, :]
            below = np.add.reduceat(low[:, :, None] * hot[y][:, None, :], starts, axis=0)
            left[t][own] += below
            right[t][own] += here - below
        for t, f in enumerate(features):
            seen = (left[t].sum(2) + right[t].sum(2) > 0) & (f >= 0)
            i, j = np.nonzero(seen)
            if len(i):
                columns = [pa.array(np.full(len(i), t, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))]
                columns += [pa.array(side[t][i, j, c]) for side in (left, right) for c in range(classes)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "slot", "j", *[f"{s}{c}" for s in "lr" for c in range(classes)]])

    return run


def _impurity(side: str, classes: int):
    """Rows times entropy of one side of a cut."""
    total = sum((F.col(f"{side}{c}") for c in range(1, classes)), F.col(f"{side}0"))
    terms = [F.when(F.col(f"{side}{c}") > 0, -F.col(f"{side}{c}") * F.log2(F.col(f"{side}{c}") / total)).otherwise(0.0) for c in range(classes)]
    return total, sum(terms[1:], terms[0])


def cost_of(counts: np.ndarray) -> np.ndarray:
    """Rows times entropy of the last axis' class counts."""
    total = counts.sum(-1, keepdims=True)
    return -(counts * np.log2(np.where(counts > 0, counts, total) / np.maximum(total, 1))).sum(-1, where=counts > 0)


def grown(x: np.ndarray, y: np.ndarray, classes: int, want: int, seed: int, number: int) -> Tree:
    """One tree on rows in memory: the nodes, draws and cuts of the distributed growth."""
    tree, hot = Tree(), np.eye(classes, dtype=np.int64)[y]
    level = [(tree.add(hot.sum(0).tolist()), np.arange(len(y)))]
    while level:
        after = []
        for n, rows in level:
            if np.count_nonzero(tree.counts[n]) < 2:
                continue
            order, place = drawn(seed, number, n, x.shape[1])
            low, high = x[rows].min(0), x[rows].max(0)
            features = order[high[order] > low[order]][:want]
            if not len(features):
                continue
            cuts = low[features] + place[features] * (high[features] - low[features])
            side = x[np.ix_(rows, features)] <= cuts
            left = side.T.astype(np.int64) @ hot[rows]
            right = hot[rows].sum(0) - left
            cost = np.round(cost_of(left) + cost_of(right), 9)
            cost[(left.sum(1) == 0) | (right.sum(1) == 0)] = np.inf
            j = int(cost.argmin())
            if np.isinf(cost[j]):
                continue
            tree.feature[n], tree.cut[n] = int(features[j]), float(cuts[j])
            tree.down[n] = (tree.add(left[j].tolist()), tree.add(right[j].tolist()))
            after += [(tree.down[n][0], rows[side[:, j]]), (tree.down[n][1], rows[~side[:, j]])]
        level = after
    return tree


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row's run of equal numbers among the runs, where the runs begin)."""
    new = np.append(True, at[1:] != at[:-1])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _candidates(x: np.ndarray, rows: np.ndarray, slot: np.ndarray, order: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, least, greatest values), a row a node: its first ``want`` features that are not constant in it, in drawn order, -1 beyond the last."""
    m, width = order.shape
    features, low, high, have = np.full((m, want), -1), np.zeros((m, want)), np.zeros((m, want)), np.zeros(m, np.int64)
    todo = np.arange(m)
    for at in range(0, width, want):
        own, starts = _runs(slot)
        asked = order[todo, at:at + want]
        values = x[rows[:, None], asked[own]]
        a, b = np.minimum.reduceat(values, starts, axis=0), np.maximum.reduceat(values, starts, axis=0)
        place = have[todo, None] + (b > a).cumsum(1) - 1
        i, j = np.nonzero((b > a) & (place < want))
        features[todo[i], place[i, j]], low[todo[i], place[i, j]], high[todo[i], place[i, j]] = asked[i, j], a[i, j], b[i, j]
        have[todo] += (b > a).sum(1)
        lacking = have[todo] < want
        if not lacking.any():
            break
        keep = lacking[own]
        todo, rows, slot = todo[lacking], rows[keep], slot[keep]
    return features, low, high


def _drawn_cuts(x, y, rows, slot, counts, features, low, high, place, terms):
    """The best of one cut drawn for each candidate: (cost, feature, cut, left counts) by node."""
    m, want = features.shape
    k = counts.shape[1]
    cuts = low + np.take_along_axis(place, np.maximum(features, 0), 1) * (high - low)
    side = x[rows[:, None], np.maximum(features, 0)[slot]] <= cuts[slot]
    at = (slot[:, None] * want + np.arange(want)) * k + y[rows][:, None]
    left = np.bincount(at[side], minlength=m * want * k).reshape(m, want, k)
    right = counts[:, None, :] - left
    a, b = left.sum(2), right.sum(2)
    cost = np.round(terms[a] - terms[left].sum(2) + terms[b] - terms[right].sum(2), 9)
    cost[(a == 0) | (b == 0) | (features < 0)] = np.inf
    n, j = np.arange(m), cost.argmin(1)
    return cost[n, j], features[n, j], cuts[n, j], left[n, j]


def _exact_cuts(x, ranks, values, y, rows, slot, counts, features, terms):
    """The best of all cuts between different values of each candidate, in its order: (cost, feature, cut, left counts) by node.

    Rows are in the order of their nodes. A row that goes left changes the terms of its own class only, so costs are running sums."""
    m, want = features.shape
    k, r = counts.shape[1], len(rows)
    by_class, by_rank = int(k - 1).bit_length(), int(len(ranks) - 1).bit_length()
    by_row = int(r - 1).bit_length()
    steps = np.diff(terms)
    size = counts.sum(1)
    begin = (np.cumsum(size) - size)[slot]
    total, whole = size[slot], terms[counts].sum(1)
    own, at, flat = slot.astype(np.int64) << by_rank, np.arange(r), counts.ravel()
    begins = np.cumsum(flat) - flat  # of a node's classes
    best, feature, cut = np.full(m, np.inf), np.full(m, -1), np.zeros(m)
    seen = np.empty(r, np.int64)
    for j in range(want):
        f = features[:, j][slot]
        key = np.where(f >= 0, ranks[rows, np.maximum(f, 0)], 0)
        key = np.sort((own | key) << by_class | y[rows])
        kind, place = slot * k + (key & ((1 << by_class) - 1)), key >> by_class
        turned = np.sort(kind << by_row | at) & ((1 << by_row) - 1)
        seen[turned] = at - begins[kind[turned]]  # rows of the same node and class to the left
        edge = np.flatnonzero((place[1:] != place[:-1]) & (slot[1:] == slot[:-1]))
        if not len(edge):
            continue
        gone, left = np.append(0.0, steps[seen].cumsum()), np.append(0.0, steps[flat[kind] - seen - 1].cumsum())
        n, b = slot[edge], begin[edge]
        below_ = edge + 1 - b
        cost = terms[below_] - (gone[edge + 1] - gone[b]) + terms[total[edge] - below_] - whole[n] + (left[edge + 1] - left[b])
        cost = np.round(cost, 6)
        run, starts = _runs(n)
        first = np.flatnonzero(cost == np.minimum.reduceat(cost, starts)[run])
        first = first[np.append(True, run[first][1:] != run[first][:-1])]
        first = first[cost[first] < best[n[first]]]
        to = n[first]
        a, b = (values[1][values[0][features[to, j]] + (place[edge[first] + i] & ((1 << by_rank) - 1))] for i in (0, 1))
        middle = a + (b - a) / 2
        cut[to], best[to], feature[to] = np.where(middle < b, middle, a), cost[first], features[to, j]
    side = x[rows, feature[slot]] <= cut[slot]
    return best, feature, cut, np.bincount(slot[side] * k + y[rows[side]], minlength=m * k).reshape(m, k)


def below(x: np.ndarray, y: np.ndarray, sample: np.ndarray, classes: int, want: int, key: tuple, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, children, class counts) of all nodes below rows ``sample`` of ``x``, grown level by level; ``exact`` looks for the best of all cuts."""
    width, total = x.shape[1], len(sample)
    terms = np.arange(total + 1) * np.log2(np.maximum(np.arange(total + 1), 1))
    ranks = values = None
    if exact:
        ranks, values = np.empty(x.shape, np.int32), []
        for f in range(width):
            own, ranks[:, f] = np.unique(x[:, f], return_inverse=True)
            values.append(own)
        values = np.cumsum([0, *map(len, values[:-1])]), np.concatenate(values)
    counts = np.bincount(y[sample], minlength=classes)[None]
    made = [(np.array([-1]), np.zeros(1), np.full((1, 2), -1), counts)]
    rows, slot, number, first = sample, np.zeros(total, np.int64), 1, 0
    level = 0
    while True:
        feature, cut, down, counts = made[-1]
        open_ = np.count_nonzero(counts, axis=1) > 1
        at = np.cumsum(open_) - 1
        keep = open_[slot]
        rows, slot = rows[keep], at[slot[keep]]
        nodes = np.flatnonzero(open_)
        if not len(nodes):
            break
        rng = np.random.default_rng((*key, level))
        ends = np.append(np.searchsorted(slot, np.arange(len(nodes))), len(slot))
        kept_rows, kept_slot, children = [], [], []
        begin = 0
        while begin < len(nodes):  # portions of nodes and of their rows
            end = min(len(nodes), begin + max(1, HELD // max(width, want * classes)))
            end = max(begin + 1, min(end, int(np.searchsorted(ends, ends[begin] + max(1, HELD // (4 * want)), "right")) - 1))
            own_rows, own_slot, own = rows[ends[begin]:ends[end]], slot[ends[begin]:ends[end]] - begin, counts[nodes[begin:end]]
            order = rng.random((end - begin, width)).argsort(1)
            place = rng.random((end - begin, width))
            f, low, high = _candidates(x, own_rows, own_slot, order, want)
            if exact:
                cost, f, c, left = _exact_cuts(x, ranks, values, y, own_rows, own_slot, own, f, terms)
            else:
                cost, f, c, left = _drawn_cuts(x, y, own_rows, own_slot, own, f, low, high, place, terms)
            cuts = np.isfinite(cost)
            n = nodes[begin:end][cuts]
            feature[n], cut[n] = f[cuts], c[cuts]
            child = sum(len(c) for c in children) + np.arange(2 * len(n)).reshape(-1, 2)
            down[n] = number + child
            children.append(np.stack([left[cuts], own[cuts] - left[cuts]], 1).reshape(-1, classes))
            go = cuts[own_slot]
            own_rows, own_slot = own_rows[go], own_slot[go]
            child_of = np.zeros((end - begin, 2), np.int64)
            child_of[cuts] = child
            to = child_of[own_slot, (x[own_rows, f[own_slot]] > c[own_slot]).astype(int)]
            turned = np.argsort(to, kind="stable")
            kept_rows.append(own_rows[turned])
            kept_slot.append(to[turned])
            begin = end
        counts = np.concatenate(children)
        if not len(counts):
            break
        made.append((np.full(len(counts), -1), np.zeros(len(counts)), np.full((len(counts), 2), -1), counts))
        number += len(counts)
        rows, slot = np.concatenate(kept_rows), np.concatenate(kept_slot)
        level += 1
    return tuple(np.concatenate([m[i] for m in made]) for i in range(4))


def _blocks(tree: int, at: np.ndarray, nodes: np.ndarray, x: np.ndarray, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows by the node that they are in (at >= 0: its place in ``nodes``), as blocks of BLOCK bytes."""
    order = np.argsort(at, kind="stable")
    order = order[np.searchsorted(at[order], 0):]
    some = max(1, BLOCK // (8 * x.shape[1]))
    if len(order):
        _, starts = _runs(at[order])
        parts = [run[i:i + some] for run in np.split(order, starts[1:]) for i in range(0, len(run), some)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(parts), tree, np.int32)), pa.array(nodes[at[[p[0] for p in parts]]].astype(np.int32)), pa.array([x[p].tobytes() for p in parts], pa.binary()),
             *(pa.array([c[p].tobytes() for p in parts], pa.binary()) for c in columns)], ["tree", "node", "x", *names])


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def copies_of(h: np.ndarray, n: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each of n equal rows of hash ``h`` is drawn for a tree, added up: a Poisson number of mean 1 a copy."""
    copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        z = np.repeat(h.astype(np.uint64), n) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1000003 + tree + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    chances = np.cumsum([np.exp(-1.0) / float(math.factorial(i)) for i in range(18)])
    return np.add.reduceat(np.searchsorted(chances, u, "right"), np.cumsum(n) - n)


def in_own_order(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in an order of their own contents, so that what is drawn by position does not depend on how they arrived."""
    order = sorted(range(len(y)), key=lambda i: (x[i].tobytes(), y[i]))
    return x[order], y[order]


def _best_cut(x: np.ndarray, hot: np.ndarray, features: np.ndarray) -> tuple[float, int, float]:
    """(cost, place in ``features``, cut) of least entropy over all cuts between different values; the first of equal ones."""
    best = (np.inf, -1, 0.0)
    some = max(1, HELD // (x.shape[0] * hot.shape[1]))
    for at in range(0, len(features), some):
        values = x[:, features[at:at + some]]
        order = np.argsort(values, axis=0, kind="stable")
        values = np.take_along_axis(values, order, 0)
        left = hot[order].cumsum(0)
        cost = np.round(cost_of(left[:-1]) + cost_of(left[-1] - left[:-1]), 9)
        cost[values[:-1] == values[1:]] = np.inf
        i = cost.argmin(0)
        j = int(cost[i, np.arange(len(i))].argmin())
        if cost[i[j], j] < best[0]:
            low, high = values[i[j], j], values[i[j] + 1, j]
            middle = low + (high - low) / 2
            best = float(cost[i[j], j]), at + j, float(middle if middle < high else low)
    return best


def bagged(x: np.ndarray, y: np.ndarray, classes: int, want: int, seed: int, number: int) -> Tree:
    """One tree of a random forest, on as many rows drawn with repetition from rows ``in_own_order``: the best cut of ``want`` drawn features that are not constant."""
    sample = np.repeat(np.arange(len(y)), np.random.default_rng((seed, number)).multinomial(len(y), np.full(len(y), 1 / len(y))))
    x, hot = x[sample], np.eye(classes, dtype=np.int64)[y[sample]]
    tree = Tree()
    level = [(tree.add(hot.sum(0).tolist()), np.arange(len(x)))]
    while level:
        after = []
        for n, rows in level:
            if np.count_nonzero(tree.counts[n]) < 2:
                continue
            order, _ = drawn(seed, number, n, x.shape[1])
            own = x[rows]
            features = order[own.max(0)[order] > own.min(0)[order]][:want]
            if not len(features):
                continue
            _, j, cut = _best_cut(own, hot[rows], features)
            side = own[:, features[j]] <= cut
            tree.feature[n], tree.cut[n] = int(features[j]), cut
            tree.down[n] = (tree.add(hot[rows[side]].sum(0).tolist()), tree.add(hot[rows[~side]].sum(0).tolist()))
            after += [(tree.down[n][0], rows[side]), (tree.down[n][1], rows[~side])]
        level = after
    return tree


class ExtraTrees:
    """``fit(train(y, features array<double>))``, then ``transform`` adds ``proba``, the mean of the trees' leaves.

    A node's candidates are the first ``share`` of the features, in its drawn order, that are not constant in it;
    the one of least entropy is taken (the first of equal ones). A node of one class, or where everything is
    constant, is a leaf. The training rows are written once to the shared folder and read twice a level.
    Of more than ``local_bytes``, ``model`` has the nodes above that bound, and ``parts`` all others."""

    one = staticmethod(grown)  # grows one tree of rows in memory
    parts: DataFrame | None = None

    def __init__(self, classes: int, trees: int = TREES, share: float = SHARE, seed: int = 0, local_bytes: int = LOCAL_BYTES):
        self.classes, self.trees, self.share, self.seed, self.local_bytes = classes, trees, share, seed, local_bytes

    def fit(self, train: DataFrame) -> ExtraTrees:
        data = written(train.select(F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features")))
        totals = {r.y: r["count"] for r in data.groupBy("y").count().collect()}
        if not totals:
            raise ValueError("no rows to learn from")
        width = data.agg(F.max(F.size("features"))).first()[0]
        want = max(1, int(self.share * width))
        if 8 * width * sum(totals.values()) <= min(self.local_bytes, WHOLE_BYTES):
            self.model = self._local(data, want)
            return self
        self.model = [Tree() for _ in range(self.trees)]
        for t in self.model:
            t.add([totals.get(c, 0) for c in range(self.classes)])
        return self._grow(data, width, want, 2 * want * self.classes)

    def _grow(self, data: DataFrame, width: int, want: int, held: int) -> ExtraTrees:
        """From the first nodes on: level by level above the bound, then the parts below it. ``held`` numbers of an open node are in a task."""
        frontier, small = [[0] for _ in self.model], [[] for _ in self.model]
        self.rows = max(sum(t.counts[0]) for t in self.model)
        while True:
            frontier = [[n for n in own if np.count_nonzero(t.counts[n]) > 1] for t, own in zip(self.model, frontier, strict=True)]
            for t, own, ready in zip(self.model, frontier, small, strict=True):
                ready += [n for n in own if 8 * width * sum(t.counts[n]) <= self.local_bytes]
            frontier = [[n for n in own if n not in set(ready)] for own, ready in zip(frontier, small, strict=True)]
            if not any(frontier):
                break
            nodes = [(t, n) for t, own in enumerate(frontier) for n in own]
            frontier = [[] for _ in self.model]
            some = max(1, HELD // held)
            for at in range(0, len(nodes), some):
                part = [[] for _ in self.model]
                for t, n in nodes[at:at + some]:
                    part[t].append(n)
                for own, new in zip(frontier, self._level(data, part, width, want), strict=True):
                    own += new
        if any(small):
            self.handed = [np.array(own, np.int64) for own in small]
            self.parts = self._parts(data, width, want)
        return self

    def _waves(self, data: DataFrame, rows: int, width: int) -> list[range]:
        """The trees, as many at a time as have WAVE_BYTES of ``rows`` rows for each core, one at least."""
        some = max(1, WAVE_BYTES * data.sparkSession.sparkContext.defaultParallelism // (8 * width * max(1, rows)))
        waves = [range(at, min(at + some, self.trees)) for at in range(0, self.trees, some)]
        return [w for w in waves if any(len(self.handed[t]) for t in w)]

    def _slots(self) -> list[np.ndarray]:
        slots = [np.full(len(t.feature), -1, np.int64) for t in self.model]
        for slot, own in zip(slots, self.handed, strict=True):
            slot[own] = np.arange(len(own))
        return slots

    def _drawn(self):
        """A function from a batch and a tree to the rows' weights in that tree."""
        return lambda batch, tree: np.ones(batch.num_rows, np.int32)

    def _parts(self, data: DataFrame, width: int, want: int) -> DataFrame:
        """What is below each open node of at most ``local_bytes``: its rows meet in one task."""
        classes, seed, weights, exact, spark = self.classes, self.seed, self._drawn(), type(self).one is bagged, data.sparkSession
        sent = spark.sparkContext.broadcast(([t.packed() for t in self.model], self._slots(), self.handed))

        def dealt(own):
            def deal(batches):
                packed, slots, handed = sent.value
                for b in batches:
                    x, y = matrix(b["features"]), b["y"].to_numpy(zero_copy_only=False).astype(np.int32)
                    for t in own:
                        if len(handed[t]) and len(x):
                            w = weights(b, t).astype(np.int32)
                            yield from _blocks(t, np.where(w > 0, slots[t][walk(packed[t], x)], -1), handed[t], x, [y, w], ["y", "w"])

            return deal

        def grow(key, table):
            tree, node = (v.as_py() for v in key)
            x, y = _joined(table, "x", float).reshape(-1, width), _joined(table, "y", np.int32).astype(np.int64)
            made = below(x, y, np.repeat(np.arange(len(y)), _joined(table, "w", np.int32)), classes, want, (seed, tree, node), exact)
            kinds = (np.int32, float, np.int32, np.int32)
            return pa.table([pa.array([tree], pa.int32()), pa.array([node], pa.int32()), *(pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(made, kinds, strict=True))],
                            names=["tree", "node", "feature", "cut", "down", "counts"])

        path = scratch(spark)
        with passing(spark):
            for own in self._waves(data, self.rows, width):
                parts = data.mapInArrow(dealt(own), "tree int, node int, x binary, y binary, w binary").groupBy("tree", "node").applyInArrow(grow, PART)
                parts.write.mode("append").option("compression", "zstd").parquet(path)
        return spark.read.schema(PART).parquet(path)

    def _local(self, data: DataFrame, want: int) -> list[Tree]:
        """Each task grows every ``tasks``-th tree; only nodes reach the driver."""
        tasks, classes, trees, seed, one = min(self.trees, LOCAL_TASKS), self.classes, self.trees, self.seed, type(self).one

        def grow(key, rows):
            whole = rows.combine_chunks()
            x, y = matrix(whole["features"].combine_chunks()), whole["y"].to_numpy().astype(np.int64)
            if one is bagged:
                x, y = in_own_order(x, y)
            own = range(key[0].as_py(), trees, tasks)
            made = [one(x, y, classes, want, seed, t) for t in own]
            return pa.table({"tree": pa.array(own, pa.int32()), "feature": pa.array([t.feature for t in made], pa.list_(pa.int32())), "cut": pa.array([t.cut for t in made], pa.list_(pa.float64())),
                             "down": pa.array([np.ravel(t.down).tolist() for t in made], pa.list_(pa.int32())), "counts": pa.array([np.ravel(t.counts).tolist() for t in made], pa.list_(pa.int64()))})

        copies = data.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
        nodes = copies.groupBy("task").applyInArrow(grow, "tree int, feature array<int>, cut array<double>, down array<int>, counts array<long>").collect()
        return [Tree(list(r.feature), list(r.cut), [(a, b) for a, b in zip(r.down[::2], r.down[1::2], strict=True)], np.reshape(r.counts, (-1, classes)).tolist())
                for r in sorted(nodes, key=lambda r: r.tree)]

    def _level(self, data: DataFrame, frontier: list[list[int]], width: int, want: int) -> list[list[int]]:
        context = data.sparkSession.sparkContext
        packed = [t.packed() for t in self.model]
        slots = [np.full(len(t.feature), -1, np.int64) for t in self.model]
        for slot, own in zip(slots, frontier, strict=True):
            slot[own] = np.arange(len(own))
        draws = [[drawn(self.seed, t, n, width) for n in own] for t, own in enumerate(frontier)]
        chosen = [[[] for _ in own] for own in frontier]  # (feature, cut) of each open node
        place = [np.zeros(len(own), np.int64) for own in frontier]  # how far its order has been asked about
        sent = context.broadcast((packed, slots))
        while True:
            asked = []
            for own, done, found in zip(draws, place, chosen, strict=True):
                a = np.full((len(own), want), -1, np.int64)
                for i, (order, _) in enumerate(own):
                    if len(found[i]) < want:
                        more = order[done[i]:done[i] + want]
                        a[i, :len(more)] = more
                asked.append(a)
            if not any((a >= 0).any() for a in asked):
                break
            ranges = context.broadcast(asked)
            run = lambda batches: _ranges(*sent.value, ranges.value)(batches)
            found = data.select("y", "features").mapInArrow(run, "tree int, slot int, j int, low double, high double").groupBy("tree", "slot", "j").agg(
                F.min("low").alias("low"), F.max("high").alias("high")).where("high > low").toArrow().sort_by([("tree", "ascending"), ("slot", "ascending"), ("j", "ascending")])
            for t, i, j, low, high in zip(*(found[c].to_pylist() for c in ("tree", "slot", "j", "low", "high")), strict=True):
                if len(chosen[t][i]) < want:
                    f = int(asked[t][i, j])
                    chosen[t][i].append((f, low + draws[t][i][1][f] * (high - low)))
            for p, a in zip(place, asked, strict=True):
                p += (a >= 0).sum(1)
            ranges.unpersist()
        features, cuts = [], []
        for own in chosen:
            f, c = np.full((len(own), want), -1, np.int64), np.full((len(own), want), np.nan)
            for i, pairs in enumerate(own):
                for j, (feature, cut) in enumerate(pairs):
                    f[i, j], c[i, j] = feature, cut
            features.append(f)
            cuts.append(c)
        best = self._best_cuts(data, sent, context.broadcast((features, cuts)))
        sent.unpersist()
        after = [[] for _ in frontier]
        for row in best:
            t, n = row.tree, frontier[row.tree][row.slot]
            tree = self.model[t]
            tree.feature[n], tree.cut[n] = int(features[t][row.slot, row.j]), float(cuts[t][row.slot, row.j])
            tree.down[n] = (tree.add(list(row.left)), tree.add(list(row.right)))
            after[t] += tree.down[n]
        return after

    def _best_cuts(self, data: DataFrame, sent, candidates) -> list:
        """One row (tree, slot, j, left, right) for each open node that has a cut, in order."""
        k = self.classes
        names = [f"{s}{c}" for s in "lr" for c in range(k)]
        run = lambda batches: _sides(*sent.value, *candidates.value, k)(batches)
        sides = data.select("y", "features").mapInArrow(run, "tree int, slot int, j int, " + ", ".join(f"{c} long" for c in names)).groupBy("tree", "slot", "j").agg(
            *[F.sum(c).alias(c) for c in names])
        (left, a), (right, b) = _impurity("l", k), _impurity("r", k)
        # rounded, so that equal cuts stay equal whatever the order of the sum
        ranked = sides.where((left > 0) & (right > 0)).withColumn("rank", F.struct(F.round(a + b, 9).alias("cost"), "j"))
        best = ranked.groupBy("tree", "slot").agg(F.min_by(F.struct(
            "j", F.array(*[f"l{c}" for c in range(k)]).alias("left"), F.array(*[f"r{c}" for c in range(k)]).alias("right")), "rank").alias("b"))
        rows = best.select("tree", "slot", "b.*").collect()  # a row a node
        return sorted(rows, key=lambda r: (r.tree, r.slot))

    def transform(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast([(t.packed(), t.proba()) for t in self.model])

        @F.pandas_udf("array<double>")
        def proba(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.stack(features.to_numpy())
            return pd.Series(list(sum(p[walk(t, x)] for t, p in sent.value) / len(sent.value)))

        if self.parts is None:
            return df.withColumn("proba", proba("features"))
        return self._through_parts(df)

    def _through_parts(self, df: DataFrame) -> DataFrame:
        """Each row of ``df`` meets the part that it falls into, in each tree; its shares by class are added up by row, of a few trees at a time."""
        classes, trees, spark = self.classes, self.trees, df.sparkSession
        sent = spark.sparkContext.broadcast(([(t.packed(), t.proba()) for t in self.model], self._slots(), self.handed))
        data = written(df.withColumn("__row", F.monotonically_increasing_id()))
        count, width = data.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(1))).first()
        # a part meets no more rows at a time than it was grown from, about
        times = max(1, -(-count // max(1, self.rows)))

        def dealt(own):
            def deal(batches):
                packed, slots, handed = sent.value
                for b in batches:
                    x, row = matrix(b["features"]), b["__row"].to_numpy(zero_copy_only=False)
                    for t in own:
                        if len(handed[t]) and len(x):
                            yield from _blocks(t, slots[t][walk(packed[t][0], x)], handed[t], x, [row], ["row"])

            return deal

        def predict(left, right):
            if not (left.num_rows and right.num_rows):
                return pa.table({"__row": pa.array([], pa.int64()), **{f"__p{c}": pa.array([], pa.float64()) for c in range(classes)}})
            part = {c: _joined(right, c, k) for c, k in (("feature", np.int32), ("cut", float), ("down", np.int32), ("counts", np.int32))}
            row, shares = _joined(left, "row", np.int64), part["counts"].reshape(-1, classes)
            x = _joined(left, "x", float).reshape(len(row), -1)
            own = shares[walk((part["feature"], part["cut"], part["down"].reshape(-1, 2)), x)].astype(float)
            own /= own.sum(1, keepdims=True)
            return pa.table({"__row": row, **{f"__p{c}": own[:, c] for c in range(classes)}})

        keys = ["tree", "node", "time"]
        names = [f"__p{c}" for c in range(classes)]
        shares, total, path = "__row long, " + ", ".join(f"{c} double" for c in names), [F.sum(c).alias(c) for c in names], scratch(spark)
        features = data.select("__row", F.col("features").cast("array<double>").alias("features"))
        with passing(spark):
            for own in self._waves(data, count, width):
                rows = features.mapInArrow(dealt(own), "tree int, node int, x binary, row binary").withColumn("time", F.pmod(F.xxhash64("row"), F.lit(times)).cast("int"))
                parts = self.parts.where(F.col("tree").between(own[0], own[-1])).withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
                met = rows.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(predict, shares)
                met.groupBy("__row").agg(*total).write.mode("append").option("compression", "zstd").parquet(path)
        added = spark.read.schema(shares).parquet(path).groupBy("__row").agg(*total)

        @F.pandas_udf("array<double>")
        def above(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            packed, slots, _ = sent.value
            x, out = np.stack(features.to_numpy()), np.zeros((len(features), classes))
            for (tree, shares), slot in zip(packed, slots, strict=True):
                at = walk(tree, x)
                out += np.where(slot[at] < 0, 1.0, 0.0)[:, None] * shares[at]
            return pd.Series(list(out))

        # rounded, so that equal shares stay equal whatever the order of the sum
        proba = F.array(*[F.round(F.get("__above", F.lit(c)) + F.coalesce(n, F.lit(0.0)), 9) / trees for c, n in enumerate(names)])
        return data.withColumn("__above", above("features")).join(added, "__row", "left").withColumn("proba", proba).drop("__row", "__above", *names)


class Forest(ExtraTrees):
    """A random forest: trees on rows drawn with repetition, the best cut of ``share`` of the features.

    Above ``local_bytes`` a row's copies are drawn by its contents (equal rows are counted first), so a forest does not depend on how its rows are dealt out.
    Nodes above the bound choose among CUTS cuts a feature, from counts of all their rows; all cuts are compared below it."""

    one = staticmethod(bagged)

    def fit(self, train: DataFrame) -> Forest:
        data = written(train.select(F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features")))
        n, width = data.agg(F.count("*"), F.max(F.size("features"))).first()
        if not n:
            raise ValueError("no rows to learn from")
        want = max(1, int(self.share * width))
        if 8 * n * width <= min(self.local_bytes, WHOLE_BYTES):
            self.model = self._local(data, want)
            return self
        with passing(data.sparkSession):
            data = written(data.groupBy("y", "features").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("y", "features")))
        weights, classes, trees = self._drawn(), self.classes, self.trees

        def totals(batches):
            out = np.zeros((trees, classes), np.int64)
            for b in batches:
                if b.num_rows:
                    y = b["y"].to_numpy()
                    for t in range(trees):
                        out[t] += np.bincount(y, weights(b, t), classes).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array(out.tolist(), pa.list_(pa.int64()))], ["tree", "c"])

        found = data.select("y", "n", "h").mapInArrow(totals, "tree int, c array<long>").groupBy("tree").agg(F.array(*[F.sum(F.get("c", F.lit(c))) for c in range(classes)]).alias("c"))
        self.model = [Tree() for _ in range(trees)]
        for r in found.collect():
            self.model[r.tree].add(list(r.c))
        some = matrix(data.orderBy(F.xxhash64("h"), "y", "features").limit(CUT_ROWS).select("features").toArrow()["features"].combine_chunks())
        self.cuts = np.quantile(some, np.arange(1, CUTS + 1) / (CUTS + 1), axis=0, method="lower").T  # a row a feature
        return self._grow(data, width, want, want * (CUTS + 1) * classes)

    def _drawn(self):
        seed = self.seed
        return lambda batch, tree: copies_of(batch["h"].to_numpy(), batch["n"].to_numpy(), tree, seed) if batch.num_rows else np.zeros(0, np.int64)

    def _level(self, data: DataFrame, frontier: list[list[int]], width: int, want: int) -> list[list[int]]:
        """Counts by class and bin of the drawn features, added up by node; the best bin's edge cuts it. A node whose drawn features cut nothing tries its next ones."""
        context, classes, weights, after = data.sparkSession.sparkContext, self.classes, self._drawn(), [[] for _ in frontier]
        sent = context.broadcast(([t.packed() for t in self.model], self.cuts))
        todo, at = [list(own) for own in frontier], 0
        while any(todo) and at < width:
            slots = [np.full(len(t.feature), -1, np.int64) for t in self.model]
            for slot, own in zip(slots, todo, strict=True):
                slot[own] = np.arange(len(own))
            j = min(want, width - at)
            asked = [np.array([drawn(self.seed, t, n, width)[0][at:at + j] for n in own], np.int64).reshape(len(own), j) for t, own in enumerate(todo)]
            part = context.broadcast((slots, asked))

            def count(batches):
                packed, cuts = sent.value
                slots, asked = part.value
                out = [np.zeros(len(a) * j * (CUTS + 1) * classes, np.int64) for a in asked]
                for b in batches:
                    if not b.num_rows:
                        continue
                    x, y = matrix(b["features"]), b["y"].to_numpy().astype(np.int64)
                    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)  # v <= cut i: bin i at most
                    for t, (tree, slot) in enumerate(zip(packed, slots, strict=True)):
                        if not len(asked[t]):
                            continue
                        node, w = slot[walk(tree, x)], weights(b, t)
                        own = np.flatnonzero((node >= 0) & (w > 0))
                        key = ((node[own, None] * j + np.arange(j)) * (CUTS + 1) + bins[own[:, None], asked[t][node[own]]]) * classes + y[own, None]
                        out[t] += np.bincount(key.ravel(), np.repeat(w[own], j), len(out[t])).astype(np.int64)
                for t, o in enumerate(out):
                    for i, own in enumerate(np.split(o, len(asked[t])) if len(o) else []):
                        if own.any():
                            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["tree", "slot", "c"])

            def choose(key, table):
                c = np.sum([np.frombuffer(v, np.int64) for v in table["c"].to_pylist()], axis=0).reshape(-1, CUTS + 1, classes)
                left = c.cumsum(1)[:, :-1]
                right = c.sum(1)[:, None] - left
                with np.errstate(divide="ignore", invalid="ignore"):  # of sides without rows
                    cost = np.round(cost_of(left) + cost_of(right), 9)
                cost[(left.sum(2) == 0) | (right.sum(2) == 0)] = np.inf
                f, i = np.unravel_index(cost.argmin(), cost.shape)
                return pa.table({"tree": [key[0].as_py()], "slot": [key[1].as_py()], "j": [int(f) if np.isfinite(cost[f, i]) else -1], "i": [int(i)], "l": [left[f, i].tolist()], "r": [right[f, i].tolist()]},
                                schema=pa.schema([("tree", pa.int32()), ("slot", pa.int32()), ("j", pa.int32()), ("i", pa.int32()), ("l", pa.list_(pa.int64())), ("r", pa.list_(pa.int64()))]))

            found = data.mapInArrow(count, "tree int, slot int, c binary").groupBy("tree", "slot").applyInArrow(
                choose, "tree int, slot int, j int, i int, l array<long>, r array<long>").where("j >= 0").collect()  # a row a node
            cut = [set() for _ in frontier]
            for r in sorted(found, key=lambda r: (r.tree, r.slot)):
                tree, n, f = self.model[r.tree], todo[r.tree][r.slot], int(asked[r.tree][r.slot, r.j])
                tree.feature[n], tree.cut[n] = f, float(self.cuts[f, r.i])
                tree.down[n] = (tree.add(list(r.l)), tree.add(list(r.r)))
                after[r.tree] += tree.down[n]
                cut[r.tree].add(n)
            todo = [[n for n in own if n not in done] for own, done in zip(todo, cut, strict=True)]
            part.unpersist()
            at += want
            if any(cut):  # those nodes are leaves no more
                sent = context.broadcast(([t.packed() for t in self.model], self.cuts))
        return after
