"""Boosted trees on second-order histograms, many trials in common jobs.

Features are cut once into at most 256 bins and kept as bytes, in blocks of rows. A tree is grown level by
level: tasks sum gradients and Hessians by (trial, node, feature, bin), the sums meet in a shuffle, and the
best split of a node is chosen where its sums are. Nodes that have become small move their rows instead, and
one job finishes all of their subtrees. If even all rows are few, one task a trial grows all of its trees; columns of few bins are summed
together, and of two children only the one of fewer rows. All ways use the same sums and the same choice, so the size at which a node counts as small changes no tree.
All trials share these jobs: a round costs one job and one more for each level that has large nodes.

Sums are of whole numbers (multiples of 2^-24), so neither partitions nor retried tasks change a tree.
Nothing is kept in workers: a job reads the blocks with the margins of some rounds ago, in reliable storage,
and applies the few trees grown since.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable

_UNIT = float(1 << 24)
_BLOCKS = "block long, n int, bins binary, label binary, weight binary, key binary, valid binary, margin binary"


@dataclass(frozen=True)
class TreeParams:
    """``gamma`` is the least gain of a split, as the sum of squared gradients over Hessians that it adds; ``alpha`` and
    ``lambda_`` are the L1 and L2 terms of leaf weights; a child needs a Hessian sum of ``min_child_weight``. Rows are drawn
    anew for each tree, and so are columns."""

    max_depth: int = 6
    learning_rate: float = 0.3
    n_estimators: int = 100
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    lambda_: float = 1.0


_KINDS = {"feature": "i4", "cut": "i4", "left": "i4", "value": "f8", "gain": "f8"}


@dataclass
class Tree:
    """Nodes in arrays: a feature of -1 is a leaf, others send bins up to ``cut`` to ``left`` and the rest to ``left`` + 1."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float, low: float, high: float) -> int:
        """Turns a leaf into a split with two new leaves; returns the left one."""
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, len(self.feature), gain
        for value in (low, high):
            for column, cell in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, value), (self.gain, 0.0)):
                column.append(cell)
        return self.left[node]

    def graft(self, node: int, other: "Tree") -> None:
        """Puts another tree in the place of a leaf."""
        shift = len(self.feature) - 1
        for name in ("feature", "cut", "value", "gain"):
            own, new = getattr(self, name), getattr(other, name)
            new = np.asarray(new).tolist()
            own[node] = new[0]
            own += new[1:]
        moved = [int(x) + shift for x in other.left]
        self.left[node] = moved[0]
        self.left += moved[1:]

    def packed(self) -> dict[str, bytes]:
        return {c: np.array(getattr(self, c), kind).tobytes() for c, kind in _KINDS.items()}

    @classmethod
    def unpacked(cls, row) -> "Tree":
        """A tree that is complete: arrays take a fraction of the room of lists."""
        return cls(**{c: np.frombuffer(row[c], kind) for c, kind in _KINDS.items()})

    def reached(self, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf of every row, or of those at ``rows``; quickest where each column of bins is one piece of memory."""
        flat, n = np.ascontiguousarray(bins.T).ravel(), len(bins)
        feature, cut, left = np.array(self.feature), np.array(self.cut, np.int16), np.array(self.left, np.int64)
        inner, start = feature >= 0, feature.astype(np.int64) * n
        out = np.zeros(n if rows is None else len(rows), np.int64)
        for first in range(0, len(out) if inner[0] else 0, 1 << 15):
            node = out[first : first + (1 << 15)]
            own = np.arange(first, first + len(node)) if rows is None else rows[first : first + len(node)]
            ahead = np.arange(len(node))
            while len(ahead):
                at = node[ahead]
                at = left[at] + (flat[start[at] + own[ahead]] > cut[at])
                node[ahead] = at
                ahead = ahead[inner[at]]
        return out

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.reached(bins)]


@dataclass
class Ensemble:
    """Trees over binned features, with the cut points that make the bins."""

    trees: list[Tree]
    cuts: list[np.ndarray]
    losses: list[float] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.margins_of(binned(x, self.cuts))

    def margins_of(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.values(bins) for t in self.trees), np.zeros(len(bins)))

    def importances(self) -> np.ndarray:
        """Share of each feature in the mean gain of its splits."""
        total, uses = np.zeros(len(self.cuts)), np.zeros(len(self.cuts))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
                    uses[f] += 1
        mean = np.divide(total, uses, out=np.zeros_like(total), where=uses > 0)
        return mean / mean.sum() if mean.sum() else mean


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The number of cut points below each value, column by column in memory."""
    out = np.empty(x.shape, np.uint8, order="F")
    for f, points in enumerate(cuts):
        out[:, f] = np.searchsorted(points, x[:, f], side="left")
    return out


def cut_points(df: DataFrame, features: str = "features", bins: int = 256, accuracy: int = 10_000) -> list[np.ndarray]:
    """At most bins - 1 distinct quantiles of every vector component, in one aggregate; the last bin is open."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    # Outer: from an inner one the optimizer derives a filter on the vector and makes the vector once more for it.
    cells = df.select(F.posexplode_outer(vector_to_array(features)).alias("f", "x")).where(F.col("f").isNotNull())
    rows = cells.groupBy("f").agg(F.percentile_approx("x", shares, accuracy).alias("c")).collect()
    return [np.unique(np.array(r["c"])) for r in sorted(rows, key=lambda r: r["f"])]


def _blocked(cuts: list[np.ndarray], size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for part in parts:
            for first in range(0, part.num_rows, size):
                rows = part.slice(first, size)
                x = np.asarray(rows.column("x").flatten()).reshape(rows.num_rows, -1)
                row = {
                    "block": (int(rows.column("part")[0].as_py()) << 33) + number, "n": rows.num_rows, "bins": binned(x, cuts).tobytes(),
                    "label": np.asarray(rows.column("label")).astype("f8").tobytes(), "weight": np.asarray(rows.column("weight")).astype("f8").tobytes(),
                    "key": np.asarray(rows.column("key")).astype("i8").tobytes(),
                    "valid": np.array(rows.column("valid").to_pylist(), bool).tobytes(), "margin": b"",
                }
                yield pa.RecordBatch.from_pylist([row])
                number += 1

    return run


def blocks_of(train: DataFrame, validation: DataFrame | None, cuts: list[np.ndarray], key: str = "email_id", size: int = 4096) -> DataFrame:
    """Rows as bytes in blocks of at most ``size``, kept in reliable storage; validation rows take no part in sums."""

    def side(df: DataFrame, valid: bool) -> DataFrame:
        weight = F.lit(1.0) if valid else F.col("weight").cast("double")
        return df.select(
            vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), weight.alias("weight"),
            F.xxhash64(F.col(key)).alias("key"), F.lit(valid).alias("valid"),
        )

    rows = side(train, False) if validation is None else side(train, False).unionByName(side(validation, True))
    rows = reliable(rows)
    # Every job reads every block: few full blocks, not one for each task that made features.
    parts = min(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // size))
    if parts < rows.rdd.getNumPartitions():
        rows = rows.repartition(max(1, parts))
    schema = _BLOCKS.replace("n int", "n long")
    return reliable(rows.withColumn("part", F.spark_partition_id()).mapInArrow(_blocked(cuts, size), schema))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_rows(key: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Whether a tree learns from each row."""
    salt = np.uint64((seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (_mixed(key.view(np.uint64) ^ salt) >> np.uint64(11)).astype("f8") * 2.0**-53 < share


def drawn_columns(width: int, share: float, seed: int, tree: int) -> np.ndarray:
    """The columns that a tree may split, at least one."""
    n = max(1, int(share * width))
    return np.sort(np.random.default_rng([seed, tree]).permutation(width)[:n])


class Layout:
    """Bins of some columns side by side."""

    def __init__(self, sizes: np.ndarray, columns: np.ndarray):
        self.columns, self.sizes = columns, sizes[columns]
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.total = int(self.first[-1])
        self.column = np.repeat(np.arange(len(columns)), self.sizes)
        #: The last bin of a column is no cut: nothing is above it.
        self.last = np.zeros(self.total, bool)
        self.last[self.first[1:] - 1] = True


class Bundles:
    """Columns of a layout taken together while their bins have at most 256 joint values: one sum by joint value gives those of all of them."""

    def __init__(self, layout: Layout):
        self.layout, self.members, self.sizes = layout, [], []
        for i in np.argsort(layout.sizes, kind="stable").tolist():
            size = int(layout.sizes[i])
            if self.members and self.sizes[-1] * size <= 256:
                self.members[-1].append(i)
                self.sizes[-1] *= size
            else:
                self.members.append([i])
                self.sizes.append(size)

    def codes(self, bins: np.ndarray, rows: np.ndarray | None = None) -> list[np.ndarray]:
        """The joint value of each row in each bundle."""
        out = []
        for members in self.members:
            code = None
            for i in members:
                column = bins[:, self.layout.columns[i]]
                column = column if rows is None else column[rows]
                code = column if code is None else code * np.uint8(self.layout.sizes[i]) + column
            out.append(code)
        return out

    def sums(self, codes: list[np.ndarray], node: np.ndarray, nodes: int, weights: list[np.ndarray | None], rows: np.ndarray | None = None) -> list[np.ndarray]:
        """For each weight (None counts), its sums by (node, bin), exact while they stay below 2^53; codes are read at ``rows``, the rest lies as they do."""
        out = [np.zeros((nodes, self.layout.total)) for _ in weights]
        for code, size, members in zip(codes, self.sizes, self.members):
            joint = [np.zeros(nodes * size) for _ in weights]
            for first in range(0, len(node), 1 << 18):
                some = slice(first, first + (1 << 18))
                at = node[some] * size
                at += code[some] if rows is None else code[rows[some]]
                for total, w in zip(joint, weights):
                    total += np.bincount(at, None if w is None else w[some], nodes * size)
            shape = [int(self.layout.sizes[i]) for i in members]
            for sums, total in zip(out, joint):
                total = total.reshape(nodes, *shape)
                for k, i in enumerate(members):
                    others = tuple(j + 1 for j in range(len(members)) if j != k)
                    sums[:, self.layout.first[i] : self.layout.first[i + 1]] = total.sum(axis=others) if others else total
        return out


def choose(g: np.ndarray, h: np.ndarray, n: np.ndarray | None, layout: Layout, p: TreeParams):
    """Best split of each node from its sums by bin (nodes x all bins): (gain, column, cut, sums of both sides).

    The gain is the growth of T(G)^2 / (H + lambda), with T shrinking G by alpha; ties go to the first column and cut.
    Numbers of rows may be left out where a child needs a Hessian sum above 0: a side that has one has rows.
    """

    def below(x: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
        upto = np.cumsum(x, axis=1)
        starts = np.concatenate([np.zeros((len(x), 1), upto.dtype), upto[:, layout.first[1:-1] - 1]], axis=1)
        return (upto - starts[:, layout.column]) / unit, upto[:, layout.first[1] - 1] / unit

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(a) - p.alpha, 0) ** 2 / np.maximum(b + p.lambda_, 1e-300)

    both = [below(g, _UNIT), below(h, _UNIT)] + ([] if n is None else [below(n, 1.0)])
    low = [x for x, _ in both]
    high = [t[:, None] - x for x, t in both]
    gain = score(*low[:2]) + score(*high[:2]) - score(both[0][1], both[1][1])[:, None]
    ok = ~layout.last & (low[1] >= p.min_child_weight) & (high[1] >= p.min_child_weight)
    if n is not None:
        ok &= (low[2] > 0) & (high[2] > 0)
    gain[~ok] = -np.inf
    at, rows = gain.argmax(axis=1), np.arange(len(g))
    best = gain[rows, at]
    fine = (best > 1e-6) & (best >= p.gamma)
    sides = [tuple(x[rows, at] for x in side) for side in (low, high)]
    return np.where(fine, best, -np.inf), layout.columns[layout.column[at]], at - layout.first[layout.column[at]], *sides


def leaf(g, h, p: TreeParams):
    return -p.learning_rate * np.sign(g) * np.maximum(np.abs(g) - p.alpha, 0) / np.maximum(h + p.lambda_, 1e-300)


def subtree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, layout: Layout, p: TreeParams) -> Tree:
    """The tree over some rows, whose gradients and Hessians are whole numbers of units, with ``depth`` levels at most."""
    return grow(bins, None, g, h, depth, layout, p)[0]


def grow(
    bins: np.ndarray, learn: np.ndarray | None, g: np.ndarray, h: np.ndarray, depth: int, layout: Layout, p: TreeParams, cells: int = 1 << 21
) -> tuple[Tree, np.ndarray]:
    """The tree over the rows at ``learn`` (all if None), to which g and h belong, and their leaves.

    Of two children the one of fewer rows is summed, and the other one is what is left of their parent: sums are of whole
    numbers, so that is exact. Parents are kept while they have at most ``cells`` bins in all.
    """
    bundles, tree = Bundles(layout), Tree()
    tree.value[0] = float(leaf(g.sum() / _UNIT, h.sum() / _UNIT, p))
    flat, n = np.ascontiguousarray(bins.T).ravel(), len(bins)
    codes, weights = bundles.codes(bins, learn), [g.astype("f8"), h.astype("f8")]
    weights += [None] if p.min_child_weight <= 0 else []
    node = np.zeros(len(g), np.int64)
    sizes = np.array([len(g)])
    opened = {0: (h.sum() / _UNIT, None)}  # by open node: its Hessian sum, and its parent if that has sums
    kept: dict[int, list[np.ndarray]] = {}
    step = max(2, (1 << 20) // layout.total)
    for _ in range(depth):
        some_open = [k for k, (weight, _) in opened.items() if weight >= 2 * p.min_child_weight]
        keeping, next_kept, next_opened, done = len(some_open) * layout.total <= cells, {}, {}, 0
        while done < len(some_open):
            some = some_open[done : done + step]
            if len(some) == step and opened[some[-1]][1] is not None and done + step < len(some_open) and some_open[done + step] == some[-1] + 1:
                some.pop()  # two children of a parent stay together
            done += len(some)
            # Children of a kept parent are side by side, a left one first.
            rest = {}
            for a, b in zip(some, some[1:]):
                if opened[a][1] is not None and opened[a][1] == opened[b][1]:
                    rest[b if sizes[a] <= sizes[b] else a] = a if sizes[a] <= sizes[b] else b
            summed = [k for k in some if k not in rest]
            place = np.full(len(tree.feature), -1)
            place[summed] = np.arange(len(summed))
            if len(tree.feature) == 1:
                found = bundles.sums(codes, node, 1, weights)
            else:
                at = place[node]
                rows = np.flatnonzero(at >= 0)
                found = bundles.sums(codes, at[rows], len(summed), [w if w is None else w[rows] for w in weights], rows)
            sums = [np.empty((len(some), layout.total)) for _ in weights]
            for i, k in enumerate(some):
                for x, part, j in zip(sums, found, range(len(weights))):
                    x[i] = part[place[k]] if k not in rest else kept[opened[k][1]][j] - part[place[rest[k]]]
            gain, column, cut, low, high = choose(sums[0], sums[1], sums[2] if len(sums) > 2 else None, layout, p)
            values = leaf(low[0], low[1], p).tolist(), leaf(high[0], high[1], p).tolist()
            for i in np.flatnonzero(np.isfinite(gain)).tolist():
                new = tree.split(some[i], int(column[i]), int(cut[i]), float(gain[i]), values[0][i], values[1][i])
                if keeping:
                    next_kept[some[i]] = [x[i] for x in sums]
                parent = some[i] if keeping else None
                next_opened |= {new: (low[1][i], parent), new + 1: (high[1][i], parent)}
        if not next_opened:
            break
        feature, cuts, left = np.array(tree.feature), np.array(tree.cut, np.int16), np.array(tree.left, np.int64)
        start = feature.astype(np.int64) * n
        inner = feature >= 0
        for first in range(0, len(node), 1 << 15):
            own = node[first : first + (1 << 15)]
            rows = np.flatnonzero(inner[own])
            at = own[rows]
            place = first + rows if learn is None else learn[first + rows]
            own[rows] = left[at] + (flat[start[at] + place] > cuts[at])
        sizes = np.bincount(node, minlength=len(tree.feature))
        opened, kept = next_opened, next_kept
    return tree, node


@dataclass
class _Trial:
    """A trial while it is grown: the trees whose margins are not stored yet, and the tree in progress."""

    number: int
    params: TreeParams
    recent: list[Tree] = field(default_factory=list)
    tree: Tree = field(default_factory=Tree)
    trees: int = 0
    grown: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    ended: bool = False
    #: Open nodes of the tree in progress, by node: (level, rows).
    large: dict[int, int] = field(default_factory=dict)
    small: dict[int, int] = field(default_factory=dict)

    def add(self, tree: Tree) -> None:
        self.recent.append(tree)
        self.grown.append(tree)
        self.trees += 1

    def sent(self) -> "_Trial":
        """What tasks need of it."""
        return replace(self, grown=[])


def layout_of(sizes: np.ndarray, t: _Trial, seed: int) -> Layout:
    """The bins of the columns drawn for the trial's tree in progress."""
    return Layout(sizes, drawn_columns(len(sizes), t.params.colsample, seed + t.number, t.trees))


def _columns_of(block: dict, width: int) -> dict:
    out = {c: np.frombuffer(block[c], "f8") for c in ("label", "weight")}
    out["key"], out["valid"] = np.frombuffer(block["key"], "i8"), np.frombuffer(block["valid"], bool)
    out["bins"] = np.asfortranarray(np.frombuffer(block["bins"], np.uint8).reshape(block["n"], width))
    out["margin"] = np.frombuffer(block["margin"], "f8").reshape(-1, block["n"]) if block["margin"] else None
    return out


def _margin(rows: dict, t: _Trial) -> np.ndarray:
    base = rows["margin"][t.number] if rows["margin"] is not None else np.zeros(len(rows["label"]))
    return sum((x.values(rows["bins"]) for x in t.recent), base)


def _slopes(rows: dict, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    g, h = rows["weight"] * (p - rows["label"]), rows["weight"] * np.maximum(p * (1 - p), 1e-16)
    return np.rint(g * _UNIT).astype(np.int64), np.rint(h * _UNIT).astype(np.int64)


def _level(sent, sizes: np.ndarray, seed: int):
    """Sums of the large nodes of all trials, by (trial, node, bin), of one task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trials: list[_Trial] = sent.value
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for part in parts:
            for block in part.to_pylist():
                rows = _columns_of(block, len(sizes))
                for t in trials:
                    if not t.large:
                        continue
                    learn = ~rows["valid"] & drawn_rows(rows["key"], t.params.subsample, seed + t.number, t.trees)
                    node = t.tree.reached(rows["bins"])
                    g, h = _slopes(rows, _margin(rows, t))
                    layout = layout_of(sizes, t, seed)
                    bundles = Bundles(layout)
                    for k in t.large:
                        own = np.flatnonzero(learn & (node == k))
                        if len(own):
                            sums = bundles.sums(bundles.codes(rows["bins"], own), np.zeros(len(own), np.int64), 1, [g[own], h[own], None])
                            have = held.setdefault((t.number, k), [np.zeros(layout.total, np.int64) for _ in range(3)])
                            for a, b in zip(have, sums):
                                a += b[0].astype(np.int64)
        for (trial, k), sums in held.items():
            at = np.flatnonzero(sums[2])
            yield pa.record_batch(
                {
                    "trial": pa.array(np.full(len(at), trial)), "node": pa.array(np.full(len(at), k)), "bin": pa.array(at),
                    "g": pa.array(sums[0][at]), "h": pa.array(sums[1][at]), "n": pa.array(sums[2][at]),
                }
            )

    return run


def _splits(sent, sizes: np.ndarray, seed: int):
    """The best split of one node from its sums over all tasks."""

    def run(table: pa.Table) -> pa.Table:
        number, node = table.column("trial")[0].as_py(), table.column("node")[0].as_py()
        t = next(t for t in sent.value if t.number == number)
        layout = layout_of(sizes, t, seed)
        sums = [np.zeros((1, layout.total), np.int64) for _ in range(3)]
        for s, c in zip(sums, ("g", "h", "n")):
            s[0, np.asarray(table.column("bin"))] = np.asarray(table.column(c))
        gain, column, cut, low, high = choose(*sums, layout, t.params)
        one = slice(layout.first[0], layout.first[1])
        value = leaf(sums[0][0, one].sum() / _UNIT, sums[1][0, one].sum() / _UNIT, t.params)
        row = {
            "trial": number, "node": node, "gain": float(gain[0]), "column": int(column[0]), "cut": int(cut[0]), "value": float(value),
            "low": float(leaf(low[0][0], low[1][0], t.params)), "high": float(leaf(high[0][0], high[1][0], t.params)),
            "n_low": int(low[2][0]), "n_high": int(high[2][0]),
        }
        return pa.Table.from_pylist([row])

    return run


_SPLIT = "trial long, node long, gain double, column long, cut long, value double, low double, high double, n_low long, n_high long"


def _moved(sent, sizes: np.ndarray, seed: int):
    """Rows of the small nodes of all trials; and, under node -1, the validation loss of the trees so far."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trials: list[_Trial] = sent.value
        for part in parts:
            for block in part.to_pylist():
                rows = _columns_of(block, len(sizes))
                out = []
                for t in trials:
                    margin = _margin(rows, t)
                    v = rows["valid"]
                    if v.any():
                        out.append((t.number, -1, b"", _loss(rows["label"][v], margin[v]).tobytes(), b""))
                    if not t.small:
                        continue
                    learn = ~v & drawn_rows(rows["key"], t.params.subsample, seed + t.number, t.trees)
                    node = t.tree.reached(rows["bins"])
                    g, h = _slopes(rows, margin)
                    for k in t.small:
                        own = np.flatnonzero(learn & (node == k))
                        if len(own):
                            out.append((t.number, k, rows["bins"][own].tobytes(), g[own].tobytes(), h[own].tobytes()))
                if out:
                    names = ("trial", "node", "bins", "g", "h")
                    yield pa.record_batch([pa.array(c, x) for c, x in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=names)

    return run


def _loss(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Sum of the log losses in units, and their number."""
    loss = np.logaddexp(0, np.where(label == 1, -margin, margin))
    return np.array([np.rint(loss * _UNIT).sum(), len(loss)], np.int64)


_GROWN = "trial long, node long, feature binary, cut binary, left binary, value binary, gain binary, loss double"


def _grown(sent, sizes: np.ndarray, seed: int):
    """The subtree of one small node, or the mean validation loss."""

    def run(table: pa.Table) -> pa.Table:
        number, node = table.column("trial")[0].as_py(), table.column("node")[0].as_py()
        read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        row = {"trial": number, "node": node, "feature": b"", "cut": b"", "left": b"", "value": b"", "gain": b"", "loss": 0.0}
        if node < 0:
            total = read("g", "i8").reshape(-1, 2).sum(axis=0)
            row["loss"] = float(total[0] / _UNIT / total[1])
        else:
            t = next(t for t in sent.value if t.number == number)
            bins = read("bins", np.uint8).reshape(-1, len(sizes))
            tree = subtree(bins, read("g", "i8"), read("h", "i8"), t.params.max_depth - t.small[node], layout_of(sizes, t, seed), t.params)
            row |= tree.packed()
        return pa.Table.from_pylist([row])

    return run


def _stored(sent, trials: int, sizes: np.ndarray):
    """Blocks with the margins of all trees so far."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block in part.to_pylist():
                rows = _columns_of(block, len(sizes))
                margin = np.zeros((trials, block["n"])) if rows["margin"] is None else rows["margin"].copy()
                for t in sent.value:
                    margin[t.number] = _margin(rows, t)
                yield pa.RecordBatch.from_pylist([{**block, "margin": margin.tobytes()}])

    return run


_CELLS = {"bins": np.uint8, "label": "f8", "weight": "f8", "key": "i8", "valid": bool, "margin": "f8"}


def _all_rows(sent, sizes: np.ndarray):
    """All rows for every trial, with the margin of its trees so far if it has any; place is the number of the task that gets them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block in part.to_pylist():
                rows = _columns_of(block, len(sizes))
                for place, t in enumerate(sent.value):
                    margin = _margin(rows, t).tobytes() if t.recent or rows["margin"] is not None else b""
                    yield pa.RecordBatch.from_pylist([{"place": place, **{c: block[c] for c in _CELLS}, "margin": margin}])

    return run


def _held(parts: Iterator[pa.RecordBatch], width: int) -> dict[str, np.ndarray] | None:
    """The rows of all blocks together, column by column; None without any. No margin is a margin of 0."""
    found: dict[str, list[np.ndarray]] = {c: [] for c in _CELLS}
    for part in parts:
        for c, kind in _CELLS.items():
            for cell in part.column(c):
                cell = np.frombuffer(cell.as_buffer(), kind)
                found[c].append(np.ascontiguousarray(cell.reshape(-1, width).T) if c == "bins" else cell.copy())
    if not found["label"]:
        return None
    rows = {c: np.concatenate(found.pop(c), axis=int(c == "bins")) for c in _CELLS}
    rows["bins"] = rows["bins"].T
    if not len(rows["margin"]):
        rows["margin"] = np.zeros(len(rows["label"]))
    return rows


def _rounds(sent, sizes: np.ndarray, seed: int, patience: int | None, rounds: int):
    """The next trees of one trial, whose rows are all here; node is the tree's number, or -1 for a loss."""

    def run(number: int, rows: dict[str, np.ndarray]) -> Iterator[dict]:
        t = sent.value[number]
        margin, v, losses = rows["margin"], np.flatnonzero(rows["valid"]), list(t.losses)
        for n in range(t.trees, min(t.trees + rounds, t.params.n_estimators)):
            if len(v):
                total = _loss(rows["label"][v], margin[v])
                losses.append(float(total[0] / _UNIT / total[1]))
                yield {"node": -1, "loss": losses[-1], **{c: b"" for c in _KINDS}}
                if _least(losses, patience) is not None:
                    return
            now = replace(t, trees=n)
            drawn = ~rows["valid"] & drawn_rows(rows["key"], t.params.subsample, seed + t.number, n)
            learn, others = np.flatnonzero(drawn), np.flatnonzero(~drawn)
            g, h = _slopes({c: rows[c][learn] for c in ("label", "weight")}, margin[learn])
            tree, leaves = grow(rows["bins"], learn, g, h, t.params.max_depth, layout_of(sizes, now, seed), t.params)
            value = np.array(tree.value)
            margin[learn] += value[leaves]
            margin[others] += value[tree.reached(rows["bins"], others)]
            yield {"node": n, "loss": 0.0, **tree.packed()}

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("trial", pa.int64()), ("node", pa.int64()), *((c, pa.binary()) for c in _KINDS), ("loss", pa.float64())])
        number = None

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for part in parts:
                if part.num_rows:
                    number = part.column("place")[0].as_py()
                    yield part

        rows = _held(noted(), len(sizes))
        if rows is not None:
            for r in run(number, rows):
                yield pa.RecordBatch.from_pylist([{"trial": sent.value[number].number, **r}], schema=schema)

    return task


def _least(losses: list[float], patience: int | None) -> int | None:
    """The number of trees with the least loss, once ``patience`` further trees have not lowered it; the first loss is that of none."""
    if patience is None or len(losses) < 2:
        return None
    least = 1 + int(np.argmin(losses[1:]))
    return least if len(losses) - 1 - least >= patience else None


def boost(
    blocks: DataFrame, cuts: list[np.ndarray], trials: Sequence[TreeParams], patience: int | None = None, seed: int = 42,
    small: int = 1 << 21, kept: int = 8, rounds: int = 512, sums: int = 1 << 24,
) -> list[Ensemble]:
    """Grows the ensembles of all trials over the blocks of :func:`blocks_of`.

    With ``patience``, a trial ends when the validation loss has not become less for so many trees, and keeps those up to its
    least loss. Nodes of up to ``small`` rows, or fewer with over 64 MB of bins, are finished in one task each; so few rows in all go on for
    ``rounds`` trees in a job.
    Margins are stored every ``kept`` rounds of larger data. A job sums at most ``sums`` bins of nodes.
    """
    spark = blocks.sparkSession
    sizes = np.array([len(c) + 1 for c in cuts])
    small = min(small, (1 << 26) // max(1, len(sizes)))
    size = blocks.agg(F.coalesce(F.sum(F.col("n")), F.lit(0))).first()[0]
    state = [_Trial(i, p) for i, p in enumerate(trials)]
    done: list[Ensemble] = [Ensemble([], cuts, t.losses) for t in state]
    active = [t for t in state if t.params.n_estimators > 0]
    spread = spark.sparkContext.defaultParallelism
    at = blocks
    while active and size and len(sizes):
        if size <= small:
            _grow_rounds(at, sizes, active, seed, patience, rounds)
        else:
            for t in active:
                t.tree, t.large, t.small = Tree(), {0: 0}, {}
            while any(t.large for t in active):
                _grow_level(spark, at, sizes, active, seed, small, sums)
            _grow_rest(at, sizes, active, seed, min(spread, sum(len(t.small) + 1 for t in active)))
            for t in active:
                t.add(t.tree)
        for t in active:
            least = _least(t.losses, patience)
            t.ended = least is not None or t.trees >= t.params.n_estimators
            done[t.number].trees = t.grown if least is None else t.grown[:least]
        active = [t for t in active if not t.ended]
        if active and max(len(t.recent) for t in active) >= (rounds if size <= small else kept):
            sent = spark.sparkContext.broadcast([t.sent() for t in active])
            at = reliable(at.mapInArrow(_stored(sent, len(trials), sizes), blocks.schema))
            for t in state:
                t.recent = []
    return done


def _grow_rounds(at: DataFrame, sizes: np.ndarray, active: list[_Trial], seed: int, patience: int | None, rounds: int) -> None:
    """The next trees of every trial, each in the task that gets all rows for it; those of most work begin first."""
    spark = at.sparkSession
    work = lambda t: -t.params.max_depth * t.params.subsample * min(rounds, t.params.n_estimators - t.trees)
    sent = spark.sparkContext.broadcast([t.sent() for t in sorted(active, key=work)])
    rows = at.mapInArrow(_all_rows(sent, sizes), "place long, bins binary, label binary, weight binary, key binary, valid binary, margin binary")
    placed = rows.repartitionById(len(active), F.col("place").cast("int"))
    found = placed.mapInArrow(_rounds(sent, sizes, seed, patience, rounds), _GROWN).collect()
    sent.destroy()
    by_number = {t.number: t for t in active}
    for r in sorted((r for r in found if r["node"] >= 0), key=lambda r: r["node"]):
        by_number[r["trial"]].add(Tree.unpacked(r))
    for r in found:  # in the order of their trees within a trial
        if r["node"] < 0:
            by_number[r["trial"]].losses.append(r["loss"])


def _grow_rest(at: DataFrame, sizes: np.ndarray, active: list[_Trial], seed: int, spread: int) -> None:
    """Finishes the trees in progress, each small node in a task of its own, and measures those before."""
    spark = at.sparkSession
    sent = spark.sparkContext.broadcast([t.sent() for t in active])
    moved = at.mapInArrow(_moved(sent, sizes, seed), "trial long, node long, bins binary, g binary, h binary")
    found = moved.repartition(spread, "trial", "node").groupBy("trial", "node").applyInArrow(_grown(sent, sizes, seed), _GROWN).collect()
    sent.destroy()
    by_number = {t.number: t for t in active}
    for r in found:
        t = by_number[r["trial"]]
        if r["node"] < 0:
            t.losses.append(r["loss"])
        else:
            t.tree.graft(r["node"], Tree.unpacked(r))


def _grow_level(spark: SparkSession, at: DataFrame, sizes: np.ndarray, active: list[_Trial], seed: int, small: int, sums: int) -> None:
    """Splits the large nodes of all trials once, as many at a time as a task can hold sums of."""
    nodes = [(t, k) for t in active for k in t.large]
    step = max(1, sums // int(sizes.sum()))
    levels = {(t.number, k): t.large[k] for t, k in nodes}
    for first in range(0, len(nodes), step):
        some = nodes[first : first + step]
        now = [replace(t, grown=[], large={k: t.large[k] for x, k in some if x is t}, small={}) for t in active if any(x is t for x, _ in some)]
        sent = spark.sparkContext.broadcast(now)
        parts = at.mapInArrow(_level(sent, sizes, seed), "trial long, node long, bin long, g long, h long, n long")
        total = parts.groupBy("trial", "node", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
        found = total.groupBy("trial", "node").applyInArrow(_splits(sent, sizes, seed), _SPLIT).collect()
        sent.destroy()
        by_number = {t.number: t for t in active}
        for r in found:
            t, k = by_number[r["trial"]], r["node"]
            level = levels[t.number, k] + 1
            if k == 0:
                t.tree.value[0] = r["value"]
            if np.isfinite(r["gain"]):
                left = t.tree.split(k, r["column"], r["cut"], r["gain"], r["low"], r["high"])
                if level < t.params.max_depth:
                    for new, n in ((left, r["n_low"]), (left + 1, r["n_high"])):
                        (t.large if n > small else t.small)[new] = level
        for t, k in some:
            t.large.pop(k, None)


def _larger(parts: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """The rows of small batches together: a tree takes as long for a few rows as for some hundreds."""
    held = []
    for part in parts:
        held += [part] if part.num_rows else []
        if sum(p.num_rows for p in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def scored(df: DataFrame, models: Sequence[Ensemble], keep: Sequence[str] = ("label",)) -> DataFrame:
    """(model, keep…, prediction, score): every row scored by every model; the score is the probability of class 1."""
    sent = df.sparkSession.sparkContext.broadcast(list(models))
    rows = df.select(*keep, vector_to_array("features").alias("_x"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_x").schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _larger(parts):
            x = np.asarray(part.column("_x").flatten()).reshape(part.num_rows, -1)
            kept = part.select([n for n in part.schema.names if n != "_x"])
            bins, cuts = None, None
            for number, model in enumerate(sent.value):
                if model.cuts is not cuts:  # models of a search share theirs
                    bins, cuts = binned(x, model.cuts), model.cuts
                p = 1 / (1 + np.exp(-model.margins_of(bins)))
                yield pa.record_batch(
                    [pa.array(np.full(part.num_rows, number, "i4")), *kept.columns, pa.array((p > 0.5).astype("i4")), pa.array(p)],
                    names=["model", *kept.schema.names, "prediction", "score"],
                )

    return rows.mapInArrow(run, f"model int, {fields}, prediction int, score double")
