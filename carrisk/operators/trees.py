"""Classification trees on binned rows in NumPy: what one task of a forest's fit or scoring does.

The trees are those of Spark ML's ``RandomForestClassifier`` for two classes: candidate thresholds from
weighted counts of at most ``max_bins`` bins, Gini gain, ``mtry`` features drawn anew for every node, a lower
bound on a child's rows, and children of one predicted class merged again.  Given the same rows, weights and
features, the same tree comes out (tested).  What a Spark fit does in two stages a level for one forest is done
here for many trees at once, level by level over arrays.

A row's bag and a node's features are functions of (row key, tree, seed) and (seed, tree, path): no result hangs
on how trees, rows or nodes are dealt to tasks.  Nothing here knows Spark; the functions go to the workers by value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

LEAF = 0xFFFF  # a leaf's split: no bin is above it
CELLS = 1 << 16  # (node, bin) cells whose counts stand in memory at once
LARGE_RATE = 100.0
EPSILON = 2.0 ** -52


# ---------------------------------------------------------------- thresholds and bins
def split_points(values: np.ndarray, weights: np.ndarray, max_splits: int) -> np.ndarray:
    """Spark ML's candidate thresholds of one feature: midpoints of neighbouring distinct values, or, where these
    are too many, those next to equal steps of weight."""
    kept = ~np.isnan(values)
    found, place = np.unique(values[kept], return_inverse=True)
    if len(found) < 2:
        return np.empty(0)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= max_splits:
        return middles
    counts = np.bincount(place, weights[kept], len(found))
    stride = counts.sum() / (max_splits + 1)
    splits, current, target = [], counts[0], stride
    for middle, count in zip(middles.tolist(), counts[1:].tolist()):
        previous, current = current, current + count
        if abs(previous - target) < abs(current - target):
            splits.append(middle)
            target += stride
    return np.array(splits)


def binned(x: np.ndarray, splits: list[np.ndarray]) -> np.ndarray:
    """Bins of the rows ``x``: a value's bin is the number of thresholds below it; NaN stands above all."""
    out = np.empty(x.shape, np.uint8 if all(len(s) < 256 for s in splits) else np.uint16)
    for f, s in enumerate(splits):
        out[:, f] = np.searchsorted(s, x[:, f], side="left")
    return out


# ---------------------------------------------------------------- bags
def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def hash_int(seeds: np.ndarray, value: int) -> np.ndarray:
    """Spark's xxhash64 of an integer after ``seeds``."""
    h = seeds + _u64(0x27D4EB2F165667C5 + 4)
    h = h ^ _u64((value & 0xFFFFFFFF) * 0x9E3779B185EBCA87)
    h = ((h << _u64(23)) | (h >> _u64(41))) * _u64(0xC2B2AE3D27D4EB4F) + _u64(0x165667B19E3779F9)
    h = (h ^ (h >> _u64(33))) * _u64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> _u64(29))) * _u64(0x165667B19E3779F9)
    return h ^ (h >> _u64(32))


def hash_bytes(text: bytes, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a text under 32 bytes after ``seed``."""
    h, at = seed + _u64(0x27D4EB2F165667C5 + len(text)), 0
    for at in range(0, len(text) - 7, 8):
        k = np.array([int.from_bytes(text[at:at + 8], "little")], np.uint64) * _u64(0xC2B2AE3D27D4EB4F)
        h = h ^ (((k << _u64(31)) | (k >> _u64(33))) * _u64(0x9E3779B185EBCA87))
        h = ((h << _u64(27)) | (h >> _u64(37))) * _u64(0x9E3779B185EBCA87) + _u64(0x85EBCA77C2B2AE63)
    at = len(text) // 8 * 8
    if at + 4 <= len(text):
        h = h ^ _u64(int.from_bytes(text[at:at + 4], "little") * 0x9E3779B185EBCA87)
        h = ((h << _u64(23)) | (h >> _u64(41))) * _u64(0xC2B2AE3D27D4EB4F) + _u64(0x165667B19E3779F9)
        at += 4
    for b in text[at:]:
        h = h ^ _u64(b * 0x27D4EB2F165667C5)
        h = ((h << _u64(11)) | (h >> _u64(53))) * _u64(0x9E3779B185EBCA87)
    h = (h ^ (h >> _u64(33))) * _u64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> _u64(29))) * _u64(0x165667B19E3779F9)
    return h ^ (h >> _u64(32))


def uniform(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """``bagging.uniform`` of the rows whose keys hash to ``keys``."""
    return (hash_int(hash_int(keys, tree), seed) & _u64((1 << 53) - 1)).astype(np.float64) / float(1 << 53)


def cumulative(rate: float) -> np.ndarray:
    """P(count <= 0), P(count <= 1), ... of a Poisson(rate) count."""
    p = cdf = math.exp(-rate)
    below = []
    for k in range(1, math.ceil(rate + 10 * math.sqrt(rate) + 12) + 1):
        below.append(cdf)
        p = p * rate / k
        cdf += p
    return np.array(below)


@dataclass
class Bags:
    """The bags of rows with key hashes ``keys`` and expected counts ``rate``."""
    keys: np.ndarray
    rate: np.ndarray
    seed: int
    _groups: list | None = None

    def counts(self, tree: int) -> np.ndarray:
        """``bagging.bag_count`` of every row."""
        if self._groups is None:
            rates, code = np.unique(self.rate, return_inverse=True)
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(rates)))
            self._groups = [(r, order[e - n:e]) for r, e, n in zip(rates.tolist(), ends.tolist(), np.diff(ends, prepend=0).tolist())]
        u = uniform(self.keys, tree, self.seed)
        if len(self._groups) == 1 and self._groups[0][0] <= LARGE_RATE:
            return np.searchsorted(cumulative(self._groups[0][0]), u, side="right").astype(np.int32)
        out = np.zeros(len(u), np.int32)
        for rate, rows in self._groups:
            if rate > LARGE_RATE:
                v = (hash_bytes(b"normal", hash_int(hash_int(self.keys[rows], tree), self.seed)) & _u64((1 << 53) - 1)).astype(np.float64) / float(1 << 53)
                z = np.sqrt(-2 * np.log(1 - u[rows])) * np.cos(2 * math.pi * v)
                out[rows] = np.maximum(1, np.floor(rate + math.sqrt(rate) * z + 0.5)).astype(np.int32)
            elif rate > 0:
                out[rows] = np.searchsorted(cumulative(rate), u[rows], side="right")
        return out

    def left_out(self, tree: int) -> np.ndarray:
        """``bagging.is_out_of_bag`` of every row."""
        return (self.rate <= LARGE_RATE) & (uniform(self.keys, tree, self.seed) < np.exp(-np.minimum(self.rate, LARGE_RATE)))


# ---------------------------------------------------------------- a node's features
def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _u64(30))) * _u64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _u64(27))) * _u64(0x94D049BB133111EB)
    return z ^ (z >> _u64(31))


def roots(trees: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(np.asarray(trees, np.uint64) + _u64(0x9E3779B97F4A7C15 * (seed + 1))))


def subsets(paths: np.ndarray, features: int, mtry: int) -> np.ndarray:
    """``mtry`` features for each node, in ascending order: those of the least hashes."""
    if mtry >= features:
        return np.broadcast_to(np.arange(features), (len(paths), features))
    steps = np.arange(1, features + 1, dtype=np.uint64) * _u64(0x9E3779B97F4A7C15)
    return np.sort(np.argsort(mix(paths[:, None] + steps[None, :]), axis=1, kind="stable")[:, :mtry], axis=1)


# ---------------------------------------------------------------- growing
@dataclass(frozen=True)
class Rules:
    features: int
    mtry: int
    node_size: int
    bins: int
    max_depth: int
    seed: int


@dataclass
class Best:
    """The best split of each node: gain (0 where there is none), feature, bin, weights of both classes left of it and in the node."""
    gain: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    total: np.ndarray


def gini(w: np.ndarray, total: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = w[..., 0] / total, w[..., 1] / total
    return np.where(total > 0, 1.0 - a * a - b * b, 0.0)


def best_splits(cells: list[tuple[np.ndarray, np.ndarray]], subset: np.ndarray, node_size: int) -> Best:
    """``cells``: for each place of ``subset``, weights (node, bin, class) and rows (node, bin).  The first of equal gains is taken."""
    nodes = len(subset)
    best = Best(np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros((nodes, 2)), np.zeros((nodes, 2)))
    every = np.arange(nodes)
    for j, (weights, rows) in enumerate(cells):
        left = np.cumsum(weights, axis=1)
        n = np.cumsum(rows, axis=1)
        total = left[:, -1]
        right = total[:, None] - left
        lw, rw, tw = left[..., 0] + left[..., 1], right[..., 0] + right[..., 1], total[:, 0] + total[:, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gini(total, tw)[:, None] - lw / tw[:, None] * gini(left, lw) - rw / tw[:, None] * gini(right, rw)
        gain[(n < node_size) | (n[:, -1:] - n < max(node_size, 1))] = 0.0
        at = np.argmax(gain, axis=1)
        top = gain[every, at]
        if j == 0:
            best.total[:] = total
        better = top > best.gain
        best.gain[better], best.split[better] = top[better], at[better]
        best.feature[better], best.left[better] = subset[better, j], left[every, at][better]
    return best


@dataclass
class Growth:
    """Trees under way: the nodes of all finished levels, and those of the last level that may still split."""
    numbers: np.ndarray
    rules: Rules
    levels: list = field(default_factory=list)  # (tree, feature or -1, split, first child, weights, gain) of each level's nodes
    made: int = 0

    def __post_init__(self):
        k = len(self.numbers)
        self.tree, self.paths, self.depth = np.arange(k), roots(self.numbers, self.rules.seed), 0
        self._open(np.arange(k), np.zeros((k, 2)), np.ones(k, bool))

    def _open(self, tree, weights, active) -> None:
        n = len(tree)
        self.levels.append([tree, np.full(n, -1), np.full(n, LEAF), np.zeros(n, np.int64), weights, np.zeros(n)])
        self.active, self.at = np.flatnonzero(active), self.made
        self.made += n

    def subset(self) -> np.ndarray:
        return subsets(self.paths, self.rules.features, self.rules.mtry)

    def split(self, best: Best) -> tuple[np.ndarray, np.ndarray]:
        """Takes the best splits of the active nodes.  Returns which of them split, and the active nodes' places among all children."""
        level = self.levels[-1]
        does = best.gain > 0
        if self.depth == 0:
            level[4][self.active] = best.total
        nodes = self.active[does]
        level[1][nodes], level[2][nodes], level[5][nodes] = best.feature[does], best.split[does], best.gain[does]
        level[3][nodes] = self.made + 2 * np.arange(len(nodes))
        left = best.left[does]
        weights = np.stack([left, best.total[does] - left], axis=1).reshape(-1, 2)
        self.depth += 1
        active = (np.abs(gini(weights, weights.sum(axis=1))) >= EPSILON) & (self.depth < self.rules.max_depth)
        own = self.paths[does]
        paths = np.stack([mix(own + _u64(0xD1B54A32D192ED03)), mix(own + _u64(0x8CB92BA72F3D8DD7))], axis=1).reshape(-1)
        self._open(np.repeat(level[0][nodes], 2), weights, active)
        self.paths = paths[active]
        return does, np.flatnonzero(active)

    def trees(self, splits: list[np.ndarray]) -> list[Tree]:
        """The trees; pairs of leaves with one predicted class are merged, from the lowest level on."""
        tree, feature, split, child, weights, gain = (np.concatenate([lv[i] for lv in self.levels]) for i in range(6))
        says = weights[:, 1] > weights[:, 0]
        starts = np.cumsum([0, *[len(lv[0]) for lv in self.levels]])
        for a, b in zip(starts[-2::-1], starts[:0:-1]):
            nodes = a + np.flatnonzero(feature[a:b] >= 0)
            c = child[nodes]
            feature[nodes[(feature[c] < 0) & (feature[c + 1] < 0) & (says[c] == says[c + 1])]] = -1
        kept = np.zeros(len(tree), bool)
        kept[:starts[1]] = True
        for a, b in zip(starts[:-1], starts[1:]):
            c = child[a + np.flatnonzero(kept[a:b] & (feature[a:b] >= 0))]
            kept[c] = kept[c + 1] = True
        kept = np.flatnonzero(kept)
        kept = kept[np.argsort(tree[kept], kind="stable")]
        ends = np.cumsum(np.bincount(tree[kept], minlength=len(self.numbers)))
        place = np.zeros(len(tree), np.int64)
        place[kept] = np.arange(len(kept))
        out = []
        for first, end in zip([0, *ends[:-1]], ends):
            own = kept[first:end]
            inner, total = feature[own] >= 0, weights[own].sum(axis=1)
            code = np.where(inner, ((place[child[own]] - first) << 32) | (feature[own] << 16) | split[own], (np.arange(len(own)) << 32) | LEAF)
            with np.errstate(divide="ignore", invalid="ignore"):
                prob = np.where(total > 0, weights[own, 1] / total, 0.0)
            rise = np.bincount(feature[own][inner], (gain[own] * total)[inner], self.rules.features)
            out.append(Tree(code, prob, rise / rise.sum() if rise.sum() > 0 else rise, splits))
        return out


def partial_codes(growth: Growth) -> tuple[np.ndarray, np.ndarray]:
    """Nodes so far as ``Tree.code`` holds them (all trees in one array, a tree's root at its place), and each one's place among the active ones, or -1."""
    feature, split, child = (np.concatenate([lv[i] for lv in growth.levels]) for i in (1, 2, 3))
    code = np.where(feature >= 0, (child << 32) | (feature << 16) | split, (np.arange(len(feature)) << 32) | LEAF)
    open_at = np.full(len(feature), -1)
    open_at[growth.at + growth.active] = np.arange(len(growth.active))
    return code, open_at


def grow(numbers, bins: np.ndarray, label: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rules: Rules, splits: list[np.ndarray]) -> list[Tree]:
    """Trees ``numbers``, each on its bag (places in ``bins``, weights, numbers of rows), all on rows held in memory."""
    growth, flat, p = Growth(np.asarray(numbers), rules), bins.reshape(-1), bins.shape[1]
    row = np.concatenate([b[0] for b in bags]).astype(np.int64)
    weight = np.concatenate([b[1] for b in bags]).astype(np.float64)
    count = np.concatenate([b[2] for b in bags])
    count = None if (count == 1).all() else count.astype(np.float64)
    y = label[row].astype(np.int64)
    row *= p
    sizes = np.array([len(b[0]) for b in bags])  # rows stand node by node
    while len(growth.active):
        subset = growth.subset()
        parts, step, starts = [], max(1, CELLS // rules.bins), np.cumsum([0, *sizes])
        for a in range(0, len(sizes), step):
            b = min(a + step, len(sizes))
            rows = slice(starts[a], starts[b])
            base, r, w, c = np.repeat(np.arange(b - a) * rules.bins, sizes[a:b]), row[rows], weight[rows], None if count is None else count[rows]
            cells = []
            for j in range(subset.shape[1]):
                cell = base + flat[r + np.repeat(subset[a:b, j], sizes[a:b])]
                both = np.bincount(cell * 2 + y[rows], w, (b - a) * rules.bins * 2).reshape(b - a, rules.bins, 2)
                cells.append((both, np.bincount(cell, c, (b - a) * rules.bins).reshape(b - a, rules.bins)))
            parts.append(best_splits(cells, subset[a:b], rules.node_size))
        best = Best(*[np.concatenate([getattr(x, name) for x in parts]) for name in ("gain", "feature", "split", "left", "total")])
        does, opened = growth.split(best)
        # rows of nodes that split go to their children in order: left ones first, each by a running count
        in_split = np.repeat(does, sizes)
        row, weight, y = row[in_split], weight[in_split], y[in_split]
        count = None if count is None else count[in_split]
        sizes, feature, split = sizes[does], best.feature[does], best.split[does]
        right = flat[row + np.repeat(feature, sizes)] > np.repeat(split, sizes)
        ends = np.cumsum(sizes)
        rights = np.cumsum(right)
        in_right = np.diff(rights[ends - 1], prepend=0) if len(ends) else np.zeros(0, np.int64)
        starts = ends - sizes
        before = np.repeat(rights[ends - 1] - in_right, sizes) if len(ends) else rights
        own = np.arange(len(row)) - np.repeat(starts, sizes)
        seen = rights - before  # rows to the right up to this one
        to = np.repeat(starts, sizes) + np.where(right, np.repeat(sizes - in_right, sizes) + seen - 1, own - seen)
        order = np.empty(len(row), np.int64)
        order[to] = np.arange(len(row))
        sizes = np.stack([sizes - in_right, in_right], axis=1).reshape(-1)
        stays = np.zeros(len(sizes), bool)
        stays[opened] = True
        order = order[np.repeat(stays, sizes)]
        sizes = sizes[stays]
        row, weight, y = row[order], weight[order], y[order]
        count = None if count is None else count[order]
    return growth.trees(splits)


# ---------------------------------------------------------------- a grown tree
@dataclass
class Tree:
    """A node is one number: first child << 32 | feature << 16 | split; a leaf is its own child.  Rows whose bin is
    above the split go to the second child."""
    code: np.ndarray
    prob: np.ndarray
    importance: np.ndarray
    splits: list[np.ndarray]

    def is_leaf(self) -> np.ndarray:
        return (self.code & 0xFFFF) == LEAF

    @property
    def numNodes(self) -> int:  # noqa: N802 - as Spark's models name it
        return len(self.code)

    @property
    def toDebugString(self) -> str:  # noqa: N802
        lines, leaf = [f"Tree with {self.numNodes} nodes"], self.is_leaf()
        todo = [(0, 1)]
        while todo:
            at, depth = todo.pop()
            child, feature, split = int(self.code[at]) >> 32, int(self.code[at]) >> 16 & 0xFFFF, int(self.code[at]) & 0xFFFF
            if leaf[at]:
                lines.append(f"{' ' * depth}P: {float(self.prob[at])!r}")
            else:
                lines.append(f"{' ' * depth}feature {feature} <= {float(self.splits[feature][split])!r}")
                todo += [(child + 1, depth + 1), (child, depth + 1)]
        return "\n".join(lines)


def leaves(code: np.ndarray, bins: np.ndarray, root: int = 0) -> np.ndarray:
    """The node each row of ``bins`` ends in."""
    flat, offset = bins.reshape(-1), np.arange(len(bins)) * bins.shape[1]
    at = np.full(len(bins), root)
    while True:
        node = code[at]
        to = (node >> 32) + (flat[offset + ((node >> 16) & 0xFFFF)] > (node & 0xFFFF))
        if np.array_equal(to, at):
            return at
        at = to


def probabilities(tree: Tree, bins: np.ndarray) -> np.ndarray:
    return tree.prob[leaves(tree.code, bins)]
