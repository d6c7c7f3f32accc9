"""Learners that a task fits on one bounded shard of labelled rows (see ``bounded``), in numpy.

Every learner is a function (X, y, w, params, seed, n) -> arrays and has a scorer (arrays, X) ->
probability of class 1. ``n`` is the number of equal rows that a row stands for (1 by default); ``w`` weighs
each of these. What a learner draws, it draws for each of the equal rows. Trees of all kinds
share one layout and one walk.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

#: Intervals of a feature's values, numbers of a histogram block that is held at once, and rows
#: under which a histogram takes all features together.
BINS, HELD, FEW = 256, 1 << 22, 2048
#: Combinations of their intervals up to which features are counted together, and draws that are made at once.
JOINT, DRAWN = 512, 1 << 20
#: Rows whose kernel features are held; of more rows, some are made at a time.
KERNEL_ROWS = 1 << 16
#: Rows that walk through trees together, and different questions up to which they are asked beforehand.
WALK, QUESTIONS = 4096, 4096
#: Kernel features, rows of a gradient step, epochs without progress that end the layers' training.
KERNEL, STEP_ROWS, PATIENCE = 256, 200, 10


# ---------------------------------------------------------------- trees


class Copies:
    """Rows that stand for ``n`` equal ones each, and draws for every one of these, some rows at a time."""

    def __init__(self, n: np.ndarray | None, rows: int):
        self.n = np.ones(rows, np.int64) if n is None else np.asarray(n).astype(np.int64)
        self.single, self.total = bool((self.n == 1).all()), int(self.n.sum())
        ends = np.cumsum(self.n)
        self.blocks, low = [], 0
        while low < rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + DRAWN, "right")))
            self.blocks.append((low, high, None if self.single else np.repeat(np.arange(high - low, dtype=np.int32), self.n[low:high])))
            low = high

    def sums(self, draw) -> np.ndarray:
        """Sum over each row's equal rows of ``draw(number of draws, low, high)``, made for the equal rows of the rows low to high."""
        if self.single:
            return draw(len(self.n), 0, len(self.n)).astype(np.float64)
        return np.concatenate([np.bincount(owner, draw(len(owner), a, b), b - a) for a, b, owner in self.blocks])

    def taken(self, rng: np.random.Generator, chance) -> np.ndarray:
        """How many of each row's equal rows are taken, each with the row's chance."""
        if self.total > 8 * len(self.n):
            return rng.binomial(self.n, chance).astype(np.float64)
        if self.single or np.ndim(chance) == 0:
            return self.sums(lambda m, *_: rng.random(m) < chance)
        return self.sums(lambda m, a, b: rng.random(m) < np.repeat(chance[a:b], self.n[a:b]))

    def bootstrap(self, rng: np.random.Generator) -> np.ndarray:
        """How often each row comes among as many rows as there are, drawn with replacement."""
        if self.single:
            return np.bincount(rng.integers(0, self.total, self.total), minlength=self.total)
        return rng.multinomial(self.total, self.n / self.total)


def quantiles(x: np.ndarray, q, n: np.ndarray | None = None) -> np.ndarray:
    """Quantiles of a column whose values stand for ``n`` equal ones each."""
    if n is None or len(x) == 0:
        return np.quantile(x, q)
    order = np.argsort(x, kind="stable")
    x, ends = x[order], np.cumsum(n[order])
    at = np.asarray(q) * (ends[-1] - 1)
    low, high = (x[np.minimum(np.searchsorted(ends, k, "right"), len(x) - 1)] for k in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


def cut_points(x: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Midpoints between the different values of a feature, or between BINS quantiles of many."""
    there = ~np.isnan(x)
    values = np.unique(x[there])
    if len(values) > BINS:
        values = np.unique(quantiles(x[there], np.linspace(0, 1, BINS), None if n is None else n[there]))
    return (values[1:] + values[:-1]) / 2


class Binned:
    """Interval of every value; intervals of all features are numbered through."""

    def __init__(self, x: np.ndarray, n: np.ndarray | None = None):
        self.cuts = [cut_points(c, n) for c in x.T]
        self.ends = np.cumsum([len(c) + 1 for c in self.cuts])
        self.starts = self.ends - [len(c) + 1 for c in self.cuts]
        self.size = int(self.ends[-1])
        self.feature = np.repeat(np.arange(len(self.cuts)), self.ends - self.starts)
        self.cut = np.concatenate([np.append(c, np.inf) for c in self.cuts])
        self.codes = np.stack([np.searchsorted(c, v) + s for c, v, s in zip(self.cuts, x.T, self.starts, strict=True)], axis=1)
        # of one feature, and from 0: counted one at a time, a feature's sums stay in the cache
        self.columns = np.ascontiguousarray((self.codes - self.starts).T)
        # row by row, small: what a row's walk asks
        self.local = np.ascontiguousarray(self.columns.T.astype(np.uint8)).ravel()
        self.joints = self._joints()
        self.cells = sum(len(parts) for _, parts, *_ in self.joints)

    def _joints(self) -> list[tuple]:
        """Neighbouring features of few combinations: every row's combination, which intervals (0 or 1) each one has, the first interval and the end."""
        out, first, width, codes = [], 0, len(self.cuts), self.columns[0]
        for f in range(1, width + 1):
            if f < width:
                used, both = np.unique(codes * (self.ends[f] - self.starts[f]) + self.columns[f], return_inverse=True)
                if len(used) <= JOINT:
                    codes = both
                    continue
            parts = np.zeros((int(codes.max(initial=0)) + 1, int(self.ends[f - 1] - self.starts[first])))
            parts[codes[:, None], self.codes[:, first:f] - self.starts[first]] = 1
            out.append((codes, parts, int(self.starts[first]), int(self.ends[f - 1])))
            first, codes = f, self.columns[min(f, width - 1)]
        return out

    def sums(self, rows: np.ndarray, slot: np.ndarray, slots: int, *values: np.ndarray) -> list[np.ndarray]:
        """What ``histograms`` has, but for rounding: combinations are counted once for all their features, unless those are many for the rows."""
        if len(rows) < FEW or len(self.joints) == len(self.cuts) or slots * self.cells > 8 * len(rows):
            return self.histograms(rows, slot, slots, *values)
        whole = len(rows) == self.codes.shape[0]  # rows are different and rising
        values = values if whole else [v.take(rows) for v in values]
        out = [np.empty((slots, self.size)) for _ in values]
        for codes, parts, start, end in self.joints:
            key = codes if whole else codes.take(rows)
            if slots > 1:
                key = slot * len(parts) + key
            for sums, v in zip(out, values, strict=True):
                sums[:, start:end] = np.bincount(key, v, slots * len(parts)).reshape(slots, len(parts)) @ parts
        return out

    def histograms(self, rows: np.ndarray, slot: np.ndarray, slots: int, *values: np.ndarray) -> list[np.ndarray]:
        """Sums of the values by slot (of each row) and interval; each adds up in the order of ``rows``."""
        width = self.codes.shape[1]
        if len(rows) < FEW:
            key = (slot[:, None] * self.size + self.codes[rows]).ravel()
            return [np.bincount(key, np.repeat(v[rows], width), slots * self.size).reshape(slots, self.size) for v in values]
        whole = len(rows) == self.codes.shape[0]  # rows are different and rising
        values = values if whole else [v[rows] for v in values]
        out = [np.empty((slots, self.size)) for _ in values]
        for column, start, end in zip(self.columns, self.starts.tolist(), self.ends.tolist(), strict=True):
            key = slot * (end - start) + (column if whole else column[rows])
            for sums, v in zip(out, values, strict=True):
                sums[:, start:end] = np.bincount(key, v, slots * (end - start)).reshape(slots, end - start)
        return out


class Rule:
    """What makes a split: penalties, least weight on each side, which features are asked."""

    def __init__(self, p: dict, width: int, rng: np.random.Generator, least: float):
        self.l1, self.l2, self.gamma, self.least = float(p.get("l1", 0)), float(p.get("l2", 0)), float(p.get("gamma", 0)), least
        self.rng, self.width, self.each = rng, width, p.get("columnsPerNode")
        self.used = np.ones(width, bool)
        if float(p.get("columns", 1)) < 1:
            self.used[rng.permutation(width)[max(1, int(round(p["columns"] * width))) :]] = False

    def strength(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g) - self.l1, 0) ** 2 / np.maximum(h + self.l2, 1e-12)

    def value(self, g, h):
        return -np.sign(g) * np.maximum(np.abs(g) - self.l1, 0) / np.maximum(h + self.l2, 1e-12)

    def gains(self, b: Binned, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gain of a cut after every interval (-inf where none is allowed), sums to its left, and sums in all."""
        left = []
        for x in (g, h):
            c = np.cumsum(x, axis=1)
            before = np.concatenate((np.zeros((len(x), 1)), c[:, b.ends[:-1] - 1]), axis=1)
            left.append(c - before[:, b.feature])
        total = [x[:, b.starts[0] : b.ends[0]].sum(axis=1, keepdims=True) for x in (g, h)]
        (gl, hl), (gt, ht) = left, total
        gain = self.strength(gl, hl) + self.strength(gt - gl, ht - hl) - self.strength(gt, ht)
        allowed = (hl >= self.least) & (ht - hl >= self.least) & (hl > 0) & (ht - hl > 1e-12) & self.used[b.feature]
        allowed[:, b.ends - 1] = False
        return np.where(allowed, gain / 2 - self.gamma, -np.inf), gl, hl, gt[:, 0], ht[:, 0]


class Trees:
    """Nodes of many trees: feature, cut (right if above), left child (right is the next; a leaf's is itself), value."""

    def __init__(self):
        self.feature, self.cut, self.child, self.value, self.roots, self.depths = [], [], [], [], [], []

    def leaf(self, value: float) -> int:
        n = len(self.child)
        self.feature.append(0)
        self.cut.append(np.inf)
        self.child.append(n)
        self.value.append(value)
        return n

    def split(self, node: int, feature: int, cut: float, values: tuple[float, float]) -> int:
        left = self.leaf(values[0])
        self.leaf(values[1])
        self.feature[node], self.cut[node], self.child[node] = feature, cut, left
        return left

    def split_level(self, first: int, split: np.ndarray, feature: np.ndarray, cut: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Splits those nodes of a level, numbered from ``first`` on, that ``split`` marks; their left children, -1 for others."""
        n, at, lefts = len(self.child), np.arange(first, first + len(split)), np.full(len(split), -1)
        new = int(np.count_nonzero(split))
        lefts[split] = n + 2 * np.arange(new)
        self.feature[first : first + len(split)] = np.where(split, feature, 0).tolist()
        self.cut[first : first + len(split)] = np.where(split, cut, np.inf).tolist()
        self.child[first : first + len(split)] = np.where(split, lefts, at).tolist()
        self.feature += [0] * (2 * new)
        self.cut += [np.inf] * (2 * new)
        self.child += range(n, n + 2 * new)
        self.value += values[split].ravel().tolist()
        return lefts

    def arrays(self, **more) -> dict:
        kinds = {"feature": np.int32, "cut": np.float64, "child": np.int32, "value": np.float64, "roots": np.int32, "depths": np.int32}
        return {k: np.array(getattr(self, k), t) for k, t in kinds.items()} | {k: np.array(v) for k, v in more.items()}


def ready(m: dict) -> dict:
    """A model to score with. Where its trees share few enough cuts, what they ask is numbered, for all rows to be asked once:
    ``ask`` has the node's question, ``level`` those of every level of a tree that asks one a level and has all its nodes."""
    if "roots" not in m or "level" in m:
        return m
    m = m | {"level": {}}
    inner = m["child"] != np.arange(len(m["child"]))
    cuts, at = np.unique(m["cut"][inner], return_inverse=True)
    size = max(1, len(cuts))
    asked, number = np.unique(m["feature"][inner].astype(np.int64) * size + at, return_inverse=True)
    if len(asked) > QUESTIONS:
        return m
    m["ask"] = np.full(len(inner), len(asked), np.int32)
    m["ask"][inner] = number
    m["of"], m["above"] = asked // size, cuts[asked % size] if len(cuts) else cuts
    del m["feature"], m["cut"]
    for root, depth, end in zip(m["roots"].tolist(), m["depths"].tolist(), [*m["roots"][1:].tolist(), len(inner)], strict=True):
        if 0 < depth and end - root == (2 << depth) - 1:
            levels = [m["ask"][root + (1 << k) - 1 : root + (2 << k) - 1] for k in range(depth)]
            children = m["child"][root : root + (1 << depth) - 1]
            if all((x == x[0]).all() for x in levels) and (children == root + 1 + 2 * np.arange(len(children))).all():
                m["level"][root] = [int(x[0]) for x in levels]
    return m


def tree_sums(m: dict, x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the value of each row's leaf; some rows walk together."""
    m = ready(m)
    out, width, trees = np.zeros(len(x)), x.shape[1], len(m["roots"])
    child, value, few = m["child"], m["value"], "ask" in m
    roots, depths = m["roots"].tolist(), m["depths"].tolist()
    for low in range(0, len(x), WALK):
        some = np.ascontiguousarray(x[low : low + WALK])
        n = len(some)
        if few:
            said = np.zeros((n, len(m["of"]) + 1), bool)  # what nobody asks is the leaves' question
            for k, (f, c) in enumerate(zip(m["of"].tolist(), m["above"].tolist(), strict=True)):
                np.greater(some[:, f], c, out=said[:, k])
            flat, row = said.ravel(), np.arange(n) * said.shape[1]
            answers = {k: said[:, k].astype(np.int64) for k in {k for ks in m["level"].values() for k in ks}}
        else:
            flat, row = some.ravel(), np.arange(n) * width
        for at in range(0, trees, 16):
            leaves = np.empty((n, min(16, trees - at)))
            for k, (root, depth) in enumerate(zip(roots[at : at + 16], depths[at : at + 16], strict=True)):
                if root in m["level"]:
                    node = np.zeros(n, np.int64)
                    for ask in m["level"][root]:
                        node += node
                        node += answers[ask]
                    node += root + (1 << depth) - 1
                else:
                    node = np.full(n, root)
                    for _ in range(depth):
                        asked = (m["ask"] if few else m["feature"]).take(node)
                        asked += row
                        above = flat.take(asked)
                        if not few:
                            above = above > m["cut"].take(node)
                        node = child.take(node)
                        node += above
                leaves[:, k] = value.take(node)
            out[low : low + WALK] += leaves.sum(axis=1)
    return out


def by_levels(trees: Trees, b: Binned, g, h, rows, rule: Rule, depth: int, together: bool = False, won: list | None = None) -> np.ndarray:
    """One tree, all nodes of a level at a time (``together``: one cut for the whole level); the leaf of every one of ``rows``.
    Where the sums of a level fit, those of the larger of two siblings are the parent's less the smaller one's.
    ``won`` takes a gain for every node of the levels, 0 where it isn't split."""
    leaf = np.full(len(g), trees.leaf(float(rule.value(g[rows].sum(), h[rows].sum()))))
    trees.roots.append(int(leaf[0]))
    # rows of the level's nodes, rising, and the place of their node
    active, of = rows, np.zeros(len(rows), np.int64)
    nodes, made, above = leaf[:1].copy(), 0, None
    while made < depth and len(nodes):
        slots, held = len(nodes), None
        if above is not None:
            size = np.bincount(of, minlength=slots)
            less = (size[::2] <= size[1::2])[:, None]
            small = np.flatnonzero(np.stack((less[:, 0], ~less[:, 0]), axis=1).ravel().take(of))
            held = []
            for few, both in zip(b.sums(active.take(small), of.take(small) >> 1, slots // 2, g, h), above, strict=True):
                many = both - few
                held.append(np.stack((np.where(less, few, many), np.where(less, many, few)), axis=1).reshape(slots, b.size))
        elif slots * b.size <= HELD or together:
            held = b.sums(active, of, slots, g, h)
        some = slots if held else max(1, HELD // b.size)
        best = []
        for low in range(0, slots, some):
            high = min(low + some, slots)
            if held:
                sums = held
            else:
                part, at = (x[(of >= low) & (of < high)] for x in (active, of))
                sums = b.sums(part, at - low, high - low, g, h)
            gain, gl, hl, gt, ht = rule.gains(b, *sums)
            if together:
                level = np.where(np.isfinite(gain), gain, 0).sum(axis=0)
                at = np.full(high - low, int(level.argmax()))
                most = np.full(high - low, level.max())
            else:
                at = gain.argmax(axis=1)
                most = gain[np.arange(high - low), at]
            k = np.arange(high - low)
            best.append((most, at, gl[k, at], hl[k, at], gt, ht))
        most, at, gl, hl, gt, ht = (np.concatenate(x) for x in zip(*best, strict=True))
        split = most > 1e-9
        if won is not None:
            won += np.where(split, most, 0.0).tolist()
        above = [x if split.all() else x[split] for x in held] if held and 2 * np.count_nonzero(split) * b.size <= HELD else None
        values = np.stack((rule.value(gl, hl), rule.value(gt - gl, ht - hl)), axis=1)
        lefts = trees.split_level(int(nodes[0]), split, b.feature[at], b.cut[at], values)
        if not split.all():
            stay = split.take(of)
            gone = np.flatnonzero(~stay)
            leaf[active.take(gone)] = nodes.take(of.take(gone))
            stay = np.flatnonzero(stay)
            active, of = active.take(stay), of.take(stay)
        if together:
            asked = int(b.feature[at[0]])
            right = b.columns[asked].take(active) > at[0] - b.starts[asked]
        else:
            feature = b.feature[at]
            right = b.local.take(active * rule.width + feature.take(of)) > (at - b.starts[feature]).astype(np.uint8).take(of)
        of = (2 * (np.cumsum(split) - 1)).take(of) + right
        nodes = np.stack((lefts[split], lefts[split] + 1), axis=1).ravel()
        made += 1
    leaf[active] = nodes.take(of)
    trees.depths.append(made)
    return leaf


def by_some(trees: Trees, b: Binned, g, h, rows, rule: Rule, depth: int) -> None:
    """One tree, a level at a time, where every node asks features of its own drawing: only intervals of those are counted."""
    size, local = b.ends - b.starts, b.local
    root = trees.leaf(float(rule.value(g[rows].sum(), h[rows].sum())))
    trees.roots.append(root)
    active, of, nodes, made = rows, np.zeros(len(rows), np.int64), np.array([root]), 0
    some = max(1, HELD // int(rule.each * size.max()))
    while made < depth and len(nodes):
        best = []
        for low in range(0, len(nodes), some):
            slots = min(some, len(nodes) - low)
            part, at = (active, of) if slots == len(nodes) else (x[(of >= low) & (of < low + slots)] for x in (active, of))
            at = at - low if low else at
            asked = np.argsort(rule.rng.random((slots, rule.width)), axis=1)[:, : rule.each]
            cells = size[asked]
            ends = np.cumsum(cells.ravel())
            starts = ends - cells.ravel()
            place, row = starts.reshape(cells.shape), part * rule.width
            key = np.concatenate([place[:, j].take(at) + local.take(row + asked[:, j].take(at)) for j in range(rule.each)])
            sums = []
            for v in (g, h):
                c = np.cumsum(np.bincount(key, np.tile(v[part], rule.each), int(ends[-1])))
                before = np.concatenate(([0.0], c[ends[:-1] - 1]))
                total = np.repeat((c[ends - 1] - before)[:: rule.each], cells.sum(axis=1))
                sums.append((c - np.repeat(before, cells.ravel()), total))
            (gl, gt), (hl, ht) = sums
            gain = rule.strength(gl, hl) + rule.strength(gt - gl, ht - hl) - rule.strength(gt, ht)
            allowed = (hl >= rule.least) & (ht - hl >= rule.least) & (hl > 0) & (ht - hl > 1e-12)
            allowed[ends - 1] = False
            gain = np.where(allowed, gain / 2 - rule.gamma, -np.inf)
            first = starts[:: rule.each]
            most = np.maximum.reduceat(gain, first)
            tops = np.flatnonzero(gain == np.repeat(most, cells.sum(axis=1)))
            k = tops[np.searchsorted(tops, first)]
            field = np.searchsorted(ends, k, "right")
            feature = asked.ravel()[field]
            best.append((most, feature, k - starts[field], gl[k], hl[k], gt[k], ht[k]))
        most, feature, cut, gl, hl, gt, ht = (np.concatenate(x) for x in zip(*best, strict=True))
        split = most > 1e-9
        values = np.stack((rule.value(gl, hl), rule.value(gt - gl, ht - hl)), axis=1)
        lefts = trees.split_level(int(nodes[0]), split, feature, b.cut[b.starts[feature] + cut], values)
        stay = np.flatnonzero(split.take(of))
        active, of = active.take(stay), of.take(stay)
        right = local.take(active * rule.width + feature.take(of)) > cut.astype(np.uint8).take(of)
        of = (2 * (np.cumsum(split) - 1)).take(of) + right
        nodes = np.stack((lefts[split], lefts[split] + 1), axis=1).ravel()
        made += 1
    trees.depths.append(made)


def by_best(trees: Trees, b: Binned, g, h, rows, rule: Rule, depth: int, leaves: int) -> np.ndarray:
    """The tree of ``by_gain`` where ``depth`` alone bounds its leaves: grown by levels, then those splits are kept that
    would come first, always the open one of the largest gain."""
    won: list[float] = []
    leaf = by_levels(trees, b, g, h, rows, rule, depth, won=won)
    root, size = trees.roots[-1], len(trees.child) - trees.roots[-1]
    if size // 2 < leaves:
        return leaf
    feature, cut, child, value = (x[root:] for x in (trees.feature, trees.cut, trees.child, trees.value))
    queue, kept = [(-won[0], 0)], set()
    while queue and len(kept) < leaves - 1:
        node = heappop(queue)[1]
        kept.add(node)
        for k in (child[node] - root, child[node] - root + 1):
            if child[k] != k + root:
                heappush(queue, (-won[k], k))
    for x in (trees.feature, trees.cut, trees.child, trees.value):
        del x[root:]
    new, level = np.empty(size, np.int64), np.zeros(size, np.int64)
    new[0] = trees.leaf(value[0])
    for node in range(size):  # parents come first
        left = child[node] - root
        if left == node:
            continue
        if node in kept:
            new[left] = trees.split(int(new[node]), feature[node], cut[node], (value[left], value[left + 1]))
            new[left + 1], level[left : left + 2] = new[left] + 1, level[node] + 1
        else:
            new[left : left + 2] = new[node]
    trees.depths[-1] = int(level.max())
    return new.take(leaf - root)


def by_gain(trees: Trees, b: Binned, g, h, rows, rule: Rule, depth: int, leaves: int) -> np.ndarray:
    """One tree whose leaf of the largest gain is split next, up to ``leaves``; a sibling's histogram is the difference."""
    hist = lambda r: np.stack(b.sums(r, np.zeros(len(r), np.int64), 1, g, h))
    leaf, deepest, queue, made = np.zeros(len(g), np.int64), 0, [], 0
    ends: dict[int, np.ndarray] = {}

    def offer(first: int, held: list[np.ndarray], sums: list[np.ndarray], at_depth: int) -> None:
        """The nodes numbered from ``first`` on, one or two siblings, at once."""
        if 0 < depth <= at_depth:
            return
        gain, gl, hl, gt, ht = rule.gains(b, *(x[0] if len(sums) == 1 else np.concatenate(x) for x in zip(*sums, strict=True)))
        for j, k in enumerate(gain.argmax(axis=1).tolist()):
            if gain[j, k] > 1e-9:
                heappush(queue, (-gain[j, k], first + j, k, (gl[j, k], hl[j, k], gt[j], ht[j]), held[j], sums[j], at_depth))

    root = trees.leaf(float(rule.value(g[rows].sum(), h[rows].sum())))
    trees.roots.append(root)
    ends[root] = rows
    offer(root, [rows], [hist(rows)], 0)
    while queue and made < leaves - 1:
        _, node, k, (gl, hl, gt, ht), held, sums, at_depth = heappop(queue)
        left = trees.split(node, int(b.feature[k]), float(b.cut[k]), (float(rule.value(gl, hl)), float(rule.value(gt - gl, ht - hl))))
        asked = int(b.feature[k])
        right = b.columns[asked][held] > k - b.starts[asked]
        parts = [held[~right], held[right]]
        del ends[node]
        ends[left], ends[left + 1] = parts
        less = int(len(parts[1]) < len(parts[0]))
        few = hist(parts[less])
        of = {less: few, 1 - less: sums - few}
        made, deepest = made + 1, max(deepest, at_depth + 1)
        offer(left, parts, [of[0], of[1]], at_depth + 1)
    for node, held in ends.items():
        leaf[held] = node
    trees.depths.append(deepest)
    return leaf


def boosted(x, y, w, p, seed, n=None) -> dict:
    """Gradient-boosted trees for log loss, grown by levels, by gain or with one cut a level."""
    rng, b, trees, copies = np.random.default_rng(seed), Binned(x, n), Trees(), Copies(n, len(y))
    rows, rate, depth, leaves = np.arange(len(y)), float(p["stepSize"]), int(p["maxDepth"]), int(p.get("leaves", 31))
    every, temperature, taking = copies.n * w, float(p.get("temperature", 1)), float(p.get("subsamplingRate", 1))
    share = np.clip((every * y).sum() / every.sum(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    for _ in range(int(p["maxIter"])):
        at = 1 / (1 + np.exp(-margin))
        # of one row, and how many count
        g, h, times = w * (at - y), w * at * (1 - at), copies.n
        number = copies.total
        if p.get("bootstrap") == "bayesian":
            times = copies.sums(lambda m, *_: rng.standard_exponential(m) ** temperature)
        elif taking < 1:
            chance = taking
            if p.get("bootstrap") == "gradient":  # rows of large gradients more often, weighted back
                size = np.sqrt(g * g + 1e-6)
                chance = np.clip(size * chance * copies.total / (copies.n * size).sum(), 1e-3, 1)
                g, h = g / chance, h / chance
            times = copies.taken(rng, chance)
            number = times.sum()
        if not number:
            continue
        g, h = g * times, h * times
        # a least number of rows is that part of the second derivatives
        least = max(float(p.get("minWeight", 0)), float(p.get("minInstancesPerNode", 0)) * h.sum() / number)
        rule, growth = Rule(p, x.shape[1], rng, least), p.get("growth", "depthwise")
        if growth == "leafwise":
            grow = by_best if 0 < depth and 1 << depth <= 4 * leaves else by_gain
            leaf = grow(trees, b, g, h, rows, rule, depth, leaves)
        else:
            leaf = by_levels(trees, b, g, h, rows, rule, depth, growth == "symmetric")
        margin += rate * np.array(trees.value[trees.roots[-1] :])[leaf - trees.roots[-1]]
    return trees.arrays(start=start, rate=rate)


def boosted_score(m, x):
    return 1 / (1 + np.exp(-(m["start"] + m["rate"] * tree_sums(m, x))))


def _columns(kind, width: int) -> int:
    share = {"sqrt": width**0.5, "log2": np.log2(width), "all": width}
    return max(1, int(share[kind]))


def forest(x, y, w, p, seed, n=None) -> dict:
    """Trees on bootstrap samples with the best cut of some features at every node (Gini)."""
    rng, b, trees, copies = np.random.default_rng(seed), Binned(x, n), Trees(), Copies(n, len(y))
    q = {"columnsPerNode": _columns(p["featureSubsetStrategy"], x.shape[1])}
    for _ in range(int(p["numTrees"])):
        times = copies.bootstrap(rng) * w
        rule = Rule(q, x.shape[1], rng, float(p["minInstancesPerNode"]))
        # with -g as the weight of class 1 and h as the weight, the gain is the fall of Gini impurity and a value a share
        by_some(trees, b, -times * y, times, np.flatnonzero(times), rule, int(p["maxDepth"]))
    return trees.arrays()


class Spans:
    """Least and largest value of every feature in runs of rows. Values are numbered; the sets of those of features with few
    are unions of bits, some features in one word."""

    def __init__(self, x: np.ndarray):
        found = [np.unique(c, return_inverse=True) for c in x.T]
        self.values, self.first = np.concatenate([v for v, _ in found]), np.cumsum([0, *(len(v) for v, _ in found)])
        self.codes = np.ascontiguousarray(np.stack([c for _, c in found], axis=1).astype(np.int32))
        self.words, self.many, room = [], [], 0
        for f, (v, c) in enumerate(found):
            if len(v) > 32:
                self.many.append(f)
                continue
            if len(v) > room:
                self.words.append((np.zeros(len(x), np.int64), []))
                room = 62
            word, fields = self.words[-1]
            word |= np.left_shift(np.int64(1), c + (62 - room))
            fields.append((f, 62 - room, (1 << len(v)) - 1))
            room -= len(v)

    def of(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = (np.empty((len(first), len(self.first) - 1), np.int64) for _ in range(2))
        for word, fields in self.words:
            there = np.bitwise_or.reduceat(word.take(rows), first)
            for f, shift, mask in fields:
                bits = (there >> shift) & mask
                low[:, f], high[:, f] = np.frexp((bits & -bits).astype(np.float64))[1] - 1, np.frexp(bits.astype(np.float64))[1] - 1
        for f in self.many:
            v = self.codes[:, f].take(rows)
            low[:, f], high[:, f] = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
        return low, high


def extra(x, y, w, p, seed, n=None) -> dict:
    """Extremely randomised trees: at every node one random cut between the least and the largest value of some features."""
    rng, trees, width, spans = np.random.default_rng(seed), Trees(), x.shape[1], Spans(x)
    w = w if n is None else w * n
    some, least, wy = _columns(p["featureSubsetStrategy"], width), float(p["minInstancesPerNode"]), w * y
    flat = np.ascontiguousarray(x).ravel()
    for _ in range(int(p["numTrees"])):
        root = trees.leaf(float(wy.sum() / w.sum()))
        trees.roots.append(root)
        # a level's nodes, which of them have rows of both classes, and their rows, sorted by the place among these
        nodes, mixed, made = np.array([root]), np.array([0 < wy.sum() < w.sum()]), 0
        order = np.arange(len(y)) if mixed[0] else np.arange(0)
        of = np.zeros(len(order), np.int64)
        while made < int(p["maxDepth"]) and len(order):
            k = np.arange(np.count_nonzero(mixed))
            first = np.searchsorted(of, k)
            row, own, ownc = order * width, w.take(order), wy.take(order)
            n, c = np.add.reduceat(own, first), np.add.reduceat(ownc, first)
            low, high = spans.of(order, first)
            turn = np.where(high > low, rng.random(low.shape), 2.0)  # constant features last
            best, values = np.full(len(k), -np.inf), np.zeros((len(k), 2))
            feature, cuts, pure = np.zeros(len(k), np.int64), np.full(len(k), np.inf), np.zeros((len(k), 2), bool)
            for _ in range(some):
                f = turn.argmin(axis=1)
                apart = turn[k, f] < 2
                turn[k, f] = 3.0
                least_, largest = (spans.values[spans.first[f] + v[k, f]] for v in (low, high))
                cut = least_ + rng.random(len(k)) * (largest - least_)
                above = flat.take(row + f.take(of)) > cut.take(of)
                nr, cr = np.add.reduceat(own * above, first), np.add.reduceat(ownc * above, first)
                nl, cl = n - nr, c - cr
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = cl**2 / nl + cr**2 / nr - c**2 / n
                    both = np.stack((cl / nl, cr / nr), axis=1)
                won = apart & (nl >= least) & (nr >= least) & (c > 0) & (c < n) & (gain > best)
                best[won], feature[won], cuts[won], values[won] = gain[won], f[won], cut[won], both[won]
                pure[won] = np.stack(((cl <= 0) | (cl >= nl), (cr <= 0) | (cr >= nr)), axis=1)[won]
            split = np.zeros(len(nodes), bool)
            ok = np.isfinite(best)
            split[mixed] = ok
            level = [np.zeros((len(nodes), *v.shape[1:]), v.dtype) for v in (feature, cuts, values)]
            for whole, v in zip(level, (feature, cuts, values), strict=True):
                whole[mixed] = v
            lefts = trees.split_level(int(nodes[0]), split, *level)
            mixed = ~pure[ok].ravel()
            place = np.full((len(k), 2), -1)
            place[ok] = np.where(mixed, np.cumsum(mixed) - 1, -1).reshape(-1, 2)
            right = flat.take(row + feature.take(of)) > cuts.take(of)
            of = place.ravel().take(2 * of + right)
            stay = np.flatnonzero(of >= 0)
            order, of = order.take(stay), of.take(stay)
            # places of few nodes sort by their digits
            sort = np.argsort(of.astype(np.uint16) if len(mixed) <= 1 << 16 else of, kind="stable")
            order, of = order.take(sort), of.take(sort)
            nodes = np.stack((lefts[split], lefts[split] + 1), axis=1).ravel()
            made += 1
        trees.depths.append(made)
    return trees.arrays()


def forest_score(m, x):
    return np.clip(tree_sums(m, x) / max(1, len(m["roots"])), 0, 1)


# ---------------------------------------------------------------- scaled learners


def _scaled(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    low, middle, high = np.array([quantiles(c, [0.25, 0.5, 0.75], n) for c in x.T]).T
    spread = np.where(high > low, high - low, 1.0)
    return (x - middle) / spread, {"middle": middle, "spread": spread}


def layers(x, y, w, p, seed, n=None) -> dict:
    """Rectified layers and a logistic output, by Adam on small batches; ends when a held-out tenth has stopped gaining."""
    rng, number = np.random.default_rng(seed), Copies(n, len(y)).n
    x, scale = _scaled(x, n)
    sizes = [x.shape[1], *(int(p[k]) for k in ("first", "second", "third") if k in p), 1]
    net = [a for i, o in zip(sizes, sizes[1:], strict=False) for a in (rng.uniform(-1, 1, (i, o)) * (6 / (i + o)) ** 0.5, np.zeros(o))]
    moments, step = [(np.zeros_like(a), np.zeros_like(a)) for a in net], 0
    order = rng.permutation(np.repeat(np.arange(len(y), dtype=np.int32), number))
    held, rows = order[: len(order) // 10], order[len(order) // 10 :]
    held, times = np.unique(held, return_counts=True)  # scored once each
    best, waited, kept = -1.0, 0, [a.copy() for a in net]
    for _ in range(int(p["maxIter"])):
        rng.shuffle(rows)
        for at in range(0, len(rows), STEP_ROWS):
            some = rows[at : at + STEP_ROWS]
            outs = [x[some]]
            for k in range(0, len(net), 2):
                z = outs[-1] @ net[k] + net[k + 1]
                outs.append(np.maximum(z, 0) if k + 2 < len(net) else 1 / (1 + np.exp(-np.clip(z, -40, 40))))
            back = (outs[-1] - y[some, None]) * w[some, None] / len(some)
            step += 1
            for k in range(len(net) - 2, -1, -2):
                grads = (outs[k // 2].T @ back + float(p["penalty"]) / len(some) * net[k], back.sum(axis=0))
                if k:
                    back = (back @ net[k].T) * (outs[k // 2] > 0)
                for j, grad in zip((k, k + 1), grads, strict=True):
                    m, v = moments[j]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    net[j] -= float(p["stepSize"]) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model = {f"net{k}": a for k, a in enumerate(net)}
        right = float(np.average((_forward(model, x[held]) >= 0.5) == y[held], weights=times)) if len(held) else 0.0
        waited = 0 if right > best + 1e-4 else waited + 1
        if right > best:
            best, kept = right, [a.copy() for a in net]
        if waited >= PATIENCE:
            break
    return {f"net{k}": a for k, a in enumerate(kept)} | scale


def _forward(m: dict, x: np.ndarray) -> np.ndarray:
    count = sum(k.startswith("net") for k in m)
    for k in range(0, count, 2):
        x = x @ m[f"net{k}"] + m[f"net{k + 1}"]
        x = np.maximum(x, 0) if k + 2 < count else 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    return x[:, 0]


def layers_score(m, x):
    return _forward(m, (x - m["middle"]) / m["spread"])


def kernel_features(m: dict, x: np.ndarray) -> np.ndarray:
    """Random Fourier features (rbf) or a tensor sketch of degree 3 (poly): inner products approximate the kernel's."""
    x = (x - m["middle"]) / m["spread"]
    if "phase" in m:
        z = (2 / KERNEL) ** 0.5 * np.cos(x @ m["draw"] + m["phase"])
    else:
        z = 1.0
        for to, sign in zip(m["to"], m["sign"], strict=True):
            sketch = np.zeros((len(x), KERNEL))
            np.add.at(sketch.T, to, (x * sign).T)
            z = z * np.fft.rfft(sketch, axis=1)
        z = np.fft.irfft(z, KERNEL, axis=1) * float(m["gamma"]) ** 1.5
    return np.column_stack((z, np.ones(len(x))))


def _squared_hinge(blocks, side, c) -> np.ndarray:
    """Least |u|^2 / 2 + C * sum of squared hinge losses, by Newton steps on the rows inside the margin. ``blocks`` makes
    (rows, their kernel features) anew for every step."""
    u = np.zeros(KERNEL + 1)
    for _ in range(30):
        square, to = np.eye(len(u)), np.zeros(len(u))
        for some, z in blocks():
            inside = (side[some] * (z @ u) < 1) & (c[some] > 0)
            z = z[inside]
            zi = z * c[some][inside, None]
            square += 2 * zi.T @ z
            to += 2 * zi.T @ side[some][inside]
        new = np.linalg.solve(square, to)
        done = np.abs(new - u).max() < 1e-6 * (1 + np.abs(u).max())
        u = u + (new - u)
        if done:
            break
    return u


def _logistic(f, y, n) -> tuple[float, float]:
    """Slope and offset of a logistic model on one feature, by Newton steps (targets a little inside 0 and 1)."""
    ones, every = (n * y).sum(), n.sum()
    y = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (every - ones + 2))
    z, u = np.column_stack((f, np.ones(len(f)))), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ u, -40, 40)))
        move = np.linalg.solve((z * (n * (q * (1 - q) + 1e-9))[:, None]).T @ z + 1e-9 * np.eye(2), z.T @ (n * (y - q)))
        u = u + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(u[0]), float(u[1])


def margin(x, y, w, p, seed, n=None) -> dict:
    """Linear margin over kernel features; its probability is fitted on out-of-fold margins."""
    rng, copies = np.random.default_rng(seed), Copies(n, len(y))
    number = copies.n.astype(np.float64)
    scaled, m = _scaled(x, n)
    middle = (number[:, None] * scaled).sum() / (number.sum() * x.shape[1])
    spread = (number[:, None] * (scaled - middle) ** 2).sum() / (number.sum() * x.shape[1])
    gamma = 1 / (x.shape[1] * (spread if p.get("gamma", "scale") == "scale" and spread > 0 else 1.0))
    if p.get("kernel", "rbf") == "rbf":
        m |= {"draw": rng.normal(0, (2 * gamma) ** 0.5, (x.shape[1], KERNEL)), "phase": rng.uniform(0, 2 * np.pi, KERNEL)}
    else:
        m |= {"to": rng.integers(0, KERNEL, (3, x.shape[1])), "sign": rng.choice([-1.0, 1.0], (3, x.shape[1])), "gamma": np.array(gamma)}
    held = [(slice(None), kernel_features(m, x))] if len(x) <= KERNEL_ROWS else None

    def blocks():
        return held or ((slice(k, k + KERNEL_ROWS), kernel_features(m, x[k : k + KERNEL_ROWS])) for k in range(0, len(x), KERNEL_ROWS))

    side, c = 2 * y - 1, float(p["C"]) * w
    # every one of a row's equal rows is in a fold of its own drawing
    fold = rng.permutation(copies.total) % 3
    owner = np.repeat(np.arange(len(y), dtype=np.int32), copies.n)
    out, own = np.empty((3, len(y))), [np.bincount(owner[fold == k], minlength=len(y)).astype(np.float64) for k in range(3)]
    for k in range(3):
        u = _squared_hinge(blocks, side, c * (number - own[k]))
        for some, z in blocks():
            out[k, some] = z @ u
    slope, offset = _logistic(out.ravel(), np.tile(y, 3), np.concatenate(own))
    return m | {"u": _squared_hinge(blocks, side, c * number), "slope": np.array(slope), "offset": np.array(offset)}


def margin_score(m, x):
    return 1 / (1 + np.exp(-np.clip(m["slope"] * (kernel_features(m, x) @ m["u"]) + m["offset"], -40, 40)))


def bayes(x, y, w, p, seed, n=None) -> dict:
    """Gaussian naive Bayes; a share of the largest variance is added to every variance."""
    number = Copies(n, len(y)).n
    widest = np.average((x - np.average(x, axis=0, weights=number)) ** 2, axis=0, weights=number).max()
    floor, w = float(p.get("smoothing", 1e-9)) * max(float(widest), 1e-12), w * number
    sides = [(x[y == k], w[y == k]) for k in (0, 1)]
    mean = [np.average(v, axis=0, weights=u) if len(v) else np.zeros(x.shape[1]) for v, u in sides]
    spread = [np.average((v - a) ** 2, axis=0, weights=u) if len(v) else np.ones(x.shape[1]) for (v, u), a in zip(sides, mean, strict=True)]
    prior = np.array([u.sum() for _, u in sides]) + 1e-12
    return {"mean": np.array(mean), "var": np.array(spread) + floor, "prior": prior / prior.sum()}


def bayes_score(m, x):
    logs = [np.log(q) - 0.5 * (np.log(v) + (x - a) ** 2 / v).sum(axis=1) for a, v, q in zip(m["mean"], m["var"], m["prior"], strict=True)]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


LEARNERS = {
    "boosted": (boosted, boosted_score),
    "forest": (forest, forest_score),
    "extra": (extra, forest_score),
    "layers": (layers, layers_score),
    "margin": (margin, margin_score),
    "bayes": (bayes, bayes_score),
}
