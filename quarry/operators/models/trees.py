"""Trees grown level by level on Spark aggregates.

One pass over the rows serves a level of all trees of an ensemble: a task walks
its rows down the trees known so far and adds what a criterion needs (its
parts) up per node, feature and threshold; the sums of all tasks meet in a
``groupBy`` and the driver, which holds nodes x features x thresholds, never
rows, chooses the splits.  A wide level is done in several passes, so that no
task holds more than ``MAX_CELLS`` sums.

Where the thresholds leave far fewer kinds of rows than there are rows, equal
kinds are first added up in a ``groupBy`` (for each tree of a bootstrap) and the
levels, and the rounds of boosting, pass over the sums.

*Thresholds.* Midpoints between a feature's values where a bounded, hash-drawn
sample has up to ``maxBins`` of them (all of a table smaller than the sample),
else the sample's quantiles.  Extremely random trees draw one threshold for each
node and feature, uniform between the least and the greatest value there, as a
hash of (seed, tree, node, feature): any partitioning draws the same.

*Criteria.* Squared error, Friedman's improvement and absolute error (from
mergeable histograms of the target by node), gini and entropy, and the
second-order gain of boosting with L1 and L2 penalties.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from .base import BaseClassifierModel, BaseEstimator, BaseModel, features_array

MAX_CELLS = 1 << 21
GROUPING = 4                    # rows for each possible group from which on trees grow over groups
GROUP_TASK = 1 << 14            # groups that a task passes over
PLAIN_CUTS = 512                # thresholds of all features that are compared in the query itself
SAMPLE_ROWS = 20_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def uniform(*parts) -> np.ndarray:
    """A number in [0, 1) for each combination of whole numbers, the same everywhere."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = h ^ (np.asarray(p, dtype=np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) + (h << np.uint64(6)))
            h = (h ^ (h >> np.uint64(30))) * _M1
            h = (h ^ (h >> np.uint64(27))) * _M2
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def bootstrap_counts(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1), a function of row, tree and seed."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    return np.searchsorted(steps, uniform(rows, np.int64(tree), np.int64(seed)), side="right").astype(np.float64)


# --- criteria -------------------------------------------------------------------------------

def _safe(a, b):
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


class SquaredError:
    """Weighted squared error around the mean; ``friedman`` ranks by the squared difference of the sides' means."""

    def __init__(self, friedman: bool = False):
        self.friedman, self.size = friedman, 4

    def parts(self, y, w):
        return [(0, w), (1, w * y), (2, w * y * y), (3, (w > 0).astype(float))]

    def grouped(self, y, w, n):
        """As :meth:`parts`, for groups of rows with sums ``w`` (w, w y, w y y) and ``n`` weighted rows."""
        return [(0, w[:, 0]), (1, w[:, 1]), (2, w[:, 2]), (3, n)]

    def impurity(self, s):
        return np.maximum(s[..., 2] - _safe(s[..., 1] ** 2, s[..., 0]), 0)

    def gain(self, whole, left, right):
        apart = _safe(left[..., 1], left[..., 0]) - _safe(right[..., 1], right[..., 0])
        weight = left[..., 0] * right[..., 0]
        return weight * apart ** 2 if self.friedman else _safe(weight, left[..., 0] + right[..., 0]) * apart ** 2

    def value(self, s):
        return [float(_safe(s[1], s[0]))]


class AbsoluteError:
    """Weighted absolute error around the median, from a histogram of the target; exact where a bin holds one value."""

    def __init__(self, edges: np.ndarray):
        self.edges, self.bins = edges, len(edges) + 1
        self.size = 2 * self.bins + 1

    def parts(self, y, w):
        at = np.searchsorted(self.edges, y)
        return [(at, w), (self.bins + at, w * y), (self.size - 1, (w > 0).astype(float))]

    def grouped(self, y, w, n):
        at = y.astype(np.int64)
        return [(at, w[:, 0]), (self.bins + at, w[:, 1]), (self.size - 1, n)]

    def _median(self, s):
        w, y = s[..., :self.bins], _safe(s[..., self.bins:2 * self.bins], s[..., :self.bins])
        upto, total = np.cumsum(w, axis=-1), w.sum(axis=-1, keepdims=True)
        low = np.argmax(upto >= total / 2 * (1 - 1e-12), axis=-1)[..., None]
        high = np.argmax(upto > total / 2 * (1 + 1e-12), axis=-1)[..., None]
        return (np.take_along_axis(y, low, -1) + np.take_along_axis(y, high, -1)) / 2, w, y

    def impurity(self, s):
        m, w, y = self._median(s)
        return (w * np.abs(y - m)).sum(axis=-1)

    def gain(self, whole, left, right):
        return self.impurity(whole) - self.impurity(left) - self.impurity(right)

    def value(self, s):
        return [float(self._median(s)[0][0])]


class Classes:
    """Gini or entropy of weighted class shares."""

    def __init__(self, classes: int, entropy: bool = False):
        self.classes, self.entropy, self.size = classes, entropy, classes + 1

    def parts(self, y, w):
        return [(y.astype(np.int64), w), (self.size - 1, (w > 0).astype(float))]

    def grouped(self, y, w, n):
        return [(y.astype(np.int64), w[:, 0]), (self.size - 1, n)]

    def impurity(self, s):
        w = s[..., :-1]
        total = w.sum(axis=-1)
        p = _safe(w, total[..., None])
        if self.entropy:
            return -total * (p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1)
        return total * (1 - (p * p).sum(axis=-1))

    def gain(self, whole, left, right):
        return self.impurity(whole) - self.impurity(left) - self.impurity(right)

    def value(self, s):
        return _safe(s[:-1], s[:-1].sum()).tolist()


class SecondOrder:
    """Gain and leaf values of a second-order step with L1 penalty ``alpha`` and L2 penalty ``lam``."""

    def __init__(self, alpha: float, lam: float):
        self.alpha, self.lam, self.size = alpha, lam, 3

    def parts(self, rows, w):
        return [(c, rows[:, c]) for c in range(3)]

    def _shrunk(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0)

    def impurity(self, s):
        # what no split can make better: no gradient left
        return np.abs(s[..., 0]) + s[..., 1]

    def _score(self, s):
        return _safe(self._shrunk(s[..., 0]) ** 2, s[..., 1] + self.lam)

    def gain(self, whole, left, right):
        return 0.5 * (self._score(left) + self._score(right) - self._score(whole))

    def value(self, s):
        return [float(-_safe(self._shrunk(s[0]), s[1] + self.lam))]


# --- one tree -------------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes as parallel lists; ``name`` is a node's place in the full binary tree (root 1)."""

    feature: list
    threshold: list
    left: list
    right: list
    value: list
    name: list

    @staticmethod
    def root() -> "Tree":
        return Tree([-1], [0.0], [0], [0], [[0.0]], [1])

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = int(feature), float(threshold), a, a + 1
        for side in (0, 1):
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(0)
            self.right.append(0)
            self.value.append([0.0])
            self.name.append(2 * self.name[node] + side)
        return a, a + 1

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; a value up to the threshold goes left."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), dtype=np.int64)
        live = np.flatnonzero(feature[at] >= 0)
        while len(live):
            n = at[live]
            at[live] = np.where(x[live, feature[n]] <= threshold[n], left[n], right[n])
            live = live[feature[at[live]] >= 0]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.walk(x)]

    def column(self, x: Column) -> Column:
        """The first number of the leaf that an array ``x`` falls into."""
        def below(node: int) -> Column:
            if self.feature[node] < 0:
                return F.lit(float(self.value[node][0]))
            return F.when(x[int(self.feature[node])] <= float(self.threshold[node]), below(self.left[node])).otherwise(below(self.right[node]))

        return below(0)

    @property
    def toDebugString(self) -> str:
        """The number of nodes, then the splits and leaves from the root on, as in Spark's trees."""
        def below(node: int, indent: str) -> list[str]:
            if self.feature[node] < 0:
                return [f"{indent}Predict: {self.value[node]}"]
            j, t = self.feature[node], self.threshold[node]
            return [f"{indent}If (feature {j} <= {t})", *below(self.left[node], indent + " "),
                    f"{indent}Else (feature {j} > {t})", *below(self.right[node], indent + " ")]

        return "\n".join([f"Tree with {len(self.feature)} nodes", *below(0, " ")])

    def listed(self) -> list:
        return [self.feature, self.threshold, self.left, self.right, self.value, [float(n) for n in self.name]]


class Grown(list):
    """A model's trees: a list, as of Spark's tree models, that may be called as well."""

    def __call__(self) -> "Grown":
        return self


# --- growing --------------------------------------------------------------------------------

#: (trees' index, y, w) of a batch: what a tree is fitted to
Target = Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray]]


@dataclass
class Rules:
    """When and where nodes split."""

    depth: int
    min_split: int = 2
    min_leaf: int = 1
    features: int | None = None     # looked at in each node; all if None
    random: bool = False            # one random threshold a feature instead of ``cuts``
    min_weight: float = 0.0         # least sum of the second channel on each side (second order only)
    seed: int = 42


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _reduced(data: DataFrame, size: int, fill, how: str = "sum") -> np.ndarray:
    """One vector of ``size`` numbers from all tasks; each task sends what it has, the sums meet on the executors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = {"sum": 0.0, "min": np.inf, "max": -np.inf}[how]
        out, any_ = np.full(size, start), False
        for batch in batches:
            if len(batch):
                any_ = True
                fill(batch, out)
        keep = np.flatnonzero(out != start) if any_ else np.zeros(0, dtype=np.int64)
        for a in range(0, len(keep), 100_000):
            k = keep[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(out[k])], names=["k", "v"])

    rows = data.mapInArrow(run, "k bigint, v double").groupBy("k").agg(getattr(F, how)("v").alias("v"))
    t = rows.toArrow()
    out = np.full(size, {"sum": 0.0, "min": np.inf, "max": -np.inf}[how])
    out[t.column("k").to_numpy()] = t.column("v").to_numpy()
    return out


def grow(data: DataFrame, trees: int, dim: int, target: Target, criterion, rules: Rules,
         cuts: list[np.ndarray] | None, grouped: Callable | None = None) -> tuple[list[Tree], np.ndarray]:
    """(trees, gain by feature) over rows with a column ``x``; ``target`` gives each tree's numbers and weights.

    ``cuts`` are each feature's thresholds, unless ``rules.random``.  ``grouped``
    gives the parts of a batch whose rows stand for groups of rows.
    """
    out = [Tree.root() for _ in range(trees)]
    gains = np.zeros(dim)
    frontier = [(t, 0) for t in range(trees)]
    bins = 1 if rules.random else max([len(c) for c in cuts] + [0]) + 1
    C = criterion.size
    room = max(1, MAX_CELLS // (dim * bins * C + C))
    for depth in range(max(1, rules.depth)):
        nxt = []
        for a in range(0, len(frontier), room):
            some = frontier[a:a + room]
            found = _level(data, out, some, dim, target, criterion, rules, cuts, last=rules.depth == 0, grouped=grouped)
            for (t, node), (s, best) in zip(some, found):
                out[t].value[node] = criterion.value(s)
                if best is not None:
                    feature, threshold, gain, sides = best
                    gains[feature] += gain
                    for child, sums in zip(out[t].split(node, feature, threshold), sides):
                        # the sums of both sides are known: the lowest level needs no pass
                        out[t].value[child] = criterion.value(sums)
                        nxt.append((t, child))
        frontier = nxt
        if not frontier:
            break
    return out, gains


def _level(data, trees, frontier, dim, target, criterion, rules, cuts, last, grouped=None):
    """For each node of the frontier its sums and its best split (feature, threshold, gain, sums of both sides), or None for a leaf."""
    slots = {}
    for i, (t, node) in enumerate(frontier):
        slots.setdefault(t, np.full(len(trees[t].feature), -1))[node] = i
    n, C = len(frontier), criterion.size

    def visit(batch):
        x = _matrix(batch.column("x"))
        for t, slot in slots.items():
            y, w = target(batch, t)
            here = np.flatnonzero(w != 0)
            at = slot[trees[t].walk(x[here])]
            here, at = here[at >= 0], at[at >= 0]
            if len(here):
                yield x[here], at, (criterion.parts(y[here], w[here]) if grouped is None else grouped(batch, here))

    def add(out, key, parts):
        """Each row adds a number to few channels: its cost doesn't grow with their count."""
        for channel, numbers in parts:
            np.add.at(out, key * C + channel, numbers)

    if last:
        def fill(batch, out):
            for _, at, parts in visit(batch):
                add(out, at, parts)
        whole = _reduced(data, n * C, fill).reshape(n, C)
        return [(s, None) for s in whole]
    if rules.random:
        # the range of each node and feature, then one threshold in it
        def low(batch, out):
            for x, at, _ in visit(batch):
                np.minimum.at(out.reshape(n, dim), at, x)

        def high(batch, out):
            for x, at, _ in visit(batch):
                np.maximum.at(out.reshape(n, dim), at, x)

        lo, hi = (_reduced(data, n * dim, f, how).reshape(n, dim) for f, how in ((low, "min"), (high, "max")))
        names = np.array([[trees[t].name[node]] for t, node in frontier], dtype=np.int64)
        of = np.array([[t] for t, _ in frontier], dtype=np.int64)
        u = uniform(np.int64(rules.seed), of, names, np.arange(dim))
        with np.errstate(invalid="ignore"):
            drawn = lo + u * (hi - lo)
        # the greatest value itself would leave the right side empty
        drawn = np.where(drawn >= hi, lo, drawn)
        possible = hi > lo
        left_bins, total_bins = 1, 2

        def bin_of(x, at, j):
            return (x[:, j] > drawn[at, j]).astype(np.int64)
    else:
        total_bins = max([len(c) for c in cuts] + [0]) + 1
        left_bins = total_bins - 1

        def bin_of(x, at, j):
            return np.searchsorted(cuts[j], x[:, j])

    def fill(batch, out):
        for x, at, parts in visit(batch):
            for j in range(dim):
                add(out, (at * dim + j) * total_bins + bin_of(x, at, j), parts)

    sums = _reduced(data, n * dim * total_bins * C, fill).reshape(n, dim, total_bins, C)
    whole = sums[:, 0].sum(axis=1)
    result = []
    for i, (t, node) in enumerate(frontier):
        s = whole[i]
        if s[-1] < max(rules.min_split, 2 * rules.min_leaf) or criterion.impurity(s) <= 1e-12 or not left_bins:
            result.append((s, None))
            continue
        left = np.cumsum(sums[i], axis=1)[:, :left_bins]
        right = s - left
        ok = (left[..., -1] >= rules.min_leaf) & (right[..., -1] >= rules.min_leaf) & (left[..., -1] > 0) & (right[..., -1] > 0)
        if rules.min_weight:
            ok &= (left[..., 1] >= rules.min_weight) & (right[..., 1] >= rules.min_weight)
        if rules.random:
            ok &= possible[i][:, None]
        else:
            ok &= np.arange(left_bins) < np.array([len(c) for c in cuts])[:, None]
        if rules.features is not None and rules.features < dim:
            order = np.argsort(uniform(np.int64(rules.seed + 1), np.int64(t), np.int64(trees[t].name[node]), np.arange(dim)))
            # features that can't split here don't use up a place
            usable = order[ok.any(axis=1)[order]][:rules.features]
            chosen = np.zeros(dim, dtype=bool)
            chosen[usable] = True
            ok &= chosen[:, None]
        gain = np.where(ok, criterion.gain(s, left, right), -np.inf)
        # of equal gains, but for rounding, the first feature's first threshold
        top = gain.max(initial=-np.inf)
        if not top > 1e-12 * max(1.0, float(criterion.impurity(s))):
            result.append((s, None))
            continue
        j, b = np.unravel_index(int(np.argmax(gain >= top * (1 - 1e-12))), gain.shape)
        threshold = drawn[i, j] if rules.random else cuts[j][b]
        result.append((s, (int(j), float(threshold), float(gain[j, b]), (left[j, b], right[j, b]))))
    return result


def cut_points(values: np.ndarray, most: int) -> np.ndarray:
    """Midpoints between up to ``most`` different values, else as many quantiles."""
    kinds = np.unique(values)
    if len(kinds) <= most:
        return (kinds[:-1] + kinds[1:]) / 2
    edges = np.unique(np.quantile(values, np.arange(1, most) / most, method="lower"))
    return edges[edges < kinds[-1]]


class _TreeParams(Params):
    criterion = Param(Params._dummy(), "criterion", "split criterion", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    minSplit = Param(Params._dummy(), "minSplit", "rows that a node needs to split", TypeConverters.toInt)
    minLeaf = Param(Params._dummy(), "minLeaf", "rows on each side of a split", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "values of a feature that are all candidates", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    bootstrap = Param(Params._dummy(), "bootstrap", "whether each tree draws its rows", TypeConverters.toBoolean)
    randomThresholds = Param(Params._dummy(), "randomThresholds", "one random threshold a feature", TypeConverters.toBoolean)
    featureSubset = Param(Params._dummy(), "featureSubset", "all | sqrt", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "classes; 0 for regression", TypeConverters.toInt)
    keyCols = Param(Params._dummy(), "keyCols", "columns that tell rows apart for the bootstrap", TypeConverters.toListString)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)


REGRESSION_CRITERIA = ("mse", "friedman_mse", "mae")
CLASS_CRITERIA = ("gini", "entropy")


def _sampled(data: DataFrame, rows: int, columns: list[str]) -> tuple[int, pa.Table]:
    """The number of rows and a bounded sample that a hash of the row draws; the whole of a smaller table."""
    n = data.count()
    if n > rows:
        share = int(rows / n * (1 << 30))
        data = data.where(F.pmod(F.xxhash64(F.lit(3), "rid"), F.lit(1 << 30)) < share)
    return n, data.select(*columns).toArrow()


def _kinds(cuts: list[np.ndarray], criterion, classes: int) -> int:
    """Most groups of rows that neither a threshold nor the criterion tells apart."""
    return math.prod(len(c) + 1 for c in cuts) * (classes or getattr(criterion, "bins", 1))


def _summed_groups(rows: DataFrame, *by: str) -> DataFrame:
    w, y = F.col("w"), F.col("y")
    return rows.where(w != 0).groupBy(*by).agg(F.sum(w).alias("s0"), F.sum(w * y).alias("s1"), F.sum(w * y * y).alias("s2"),
                                               F.sum((w > 0).cast("double")).alias("n"))


def _bin(value: Column, cuts: np.ndarray) -> Column:
    """How many of the sorted ``cuts`` lie below a value, by halves; NaN is above all."""
    def count(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a).cast("long")
        m = (a + b) // 2
        return F.when(value > float(cuts[m]), count(m + 1, b)).otherwise(count(a, m))

    return count(0, len(cuts))


def _groups(data: DataFrame, dim: int, cuts: list[np.ndarray], edges: np.ndarray | None = None, by_class: bool = False,
            draws: Callable | None = None, trees: int = 1) -> DataFrame:
    """Sums of the rows between the same thresholds: (tree, x, kind, s0, s1, s2, n), x being bins, kind a class or a bin of the target.

    With ``draws(rid, tree)``, how often each tree draws a row, every tree has groups of its own; else all are tree 0's.
    """
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, (y, w) = _matrix(batch.column("x")), (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            code = np.zeros(len(y), dtype=np.int64)
            for j in range(dim):
                code = code * (len(cuts[j]) + 1) + np.searchsorted(cuts[j], x[:, j])
            kind = y if by_class else np.zeros(len(y)) if edges is None else np.searchsorted(edges, y).astype(float)
            for t in range(trees if draws else 1):
                wt = w * draws(batch.column("rid").to_numpy(zero_copy_only=False), t) if draws else w
                at = np.flatnonzero(wt)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), *[pa.array(v[at]) for v in (code, kind, wt, y)]],
                                                 names=["tree", "code", "kind", "w", "y"])

    if draws is None and sum(len(c) for c in [*cuts, () if edges is None else edges]) <= PLAIN_CUTS:
        # few thresholds are compared in the query itself: no row goes to Python
        code = F.lit(0).cast("long")
        for j in range(dim):
            code = code * (len(cuts[j]) + 1) + _bin(F.col("x")[j], cuts[j])
        kind = F.col("y") if by_class else F.lit(0.0) if edges is None else _bin(F.col("y"), edges).cast("double")
        rows = data.select(F.lit(0).cast("long").alias("tree"), code.alias("code"), kind.alias("kind"), "w", "y")
    else:
        rows = data.mapInArrow(binned, "tree bigint, code bigint, kind double, w double, y double")
    sums = _summed_groups(rows, "tree", "code", "kind")
    # the bins of a group, from its code
    place, digits = 1, []
    for c in reversed(cuts):
        digits.append(F.pmod(F.floor(F.col("code") / F.lit(place)) if place > 1 else F.col("code"), F.lit(len(c) + 1)).cast("double"))
        place *= len(c) + 1
    return sums.select("tree", F.array(*reversed(digits)).alias("x"), "kind", "s0", "s1", "s2", "n")


def _kept(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups persisted, and the same in as many tasks as their count is worth: they are passed over many times."""
    held = groups.persist(StorageLevel.MEMORY_AND_DISK)
    return held, held.coalesce(max(1, -(-held.count() // GROUP_TASK)))


def _restore(trees: list[Tree], cuts: list[np.ndarray]) -> None:
    """Thresholds between bins become those between values."""
    for t in trees:
        t.threshold = [float(cuts[f][int(v)]) if f >= 0 else v for f, v in zip(t.feature, t.threshold)]


class _TreeEstimator(BaseEstimator, _TreeParams):
    def _rows(self, df: DataFrame) -> DataFrame:
        """(x, y, w, rid) of the training rows."""
        keys = [F.col(f"`{c}`") for c in self.getOrDefault(self.keyCols)]
        rows = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], features_array(df, self.getFeaturesCol()).alias("x"),
                         F.col(self.getLabelCol()).cast("double").alias("y"), self._weight().alias("w"))
        rid = F.xxhash64(*[f"k{i}" for i in range(len(keys))]) if keys else F.xxhash64("x", "y")
        return rows.select("x", "y", "w", rid.alias("rid")).where("y IS NOT NULL")


class TreeEnsemble(_TreeEstimator):
    """One tree, a bootstrapped forest, or extremely random trees."""

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None,
                 criterion="mse", maxDepth=5, minSplit=2, minLeaf=1, maxBins=64, numTrees=1, bootstrap=False,
                 randomThresholds=False, featureSubset="all", numClasses=0, keyCols=(), seed=42):
        super().__init__()
        if criterion not in (CLASS_CRITERIA if numClasses else REGRESSION_CRITERIA):
            raise ValueError(f"unknown criterion {criterion!r}")
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, criterion=criterion,
                  maxDepth=maxDepth, minSplit=minSplit, minLeaf=minLeaf, maxBins=maxBins, numTrees=numTrees,
                  bootstrap=bootstrap, randomThresholds=randomThresholds, featureSubset=featureSubset,
                  numClasses=numClasses, keyCols=list(keyCols), seed=seed)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        get = self.getOrDefault
        data = self._rows(df)
        rows, some = _sampled(data, SAMPLE_ROWS, ["x", "y"])
        x = _matrix(some.column("x").combine_chunks()) if len(some) else np.zeros((0, 1))
        dim, classes, seed = x.shape[1], get(self.numClasses), get(self.seed)
        cuts = None if get(self.randomThresholds) else [cut_points(x[:, j], get(self.maxBins)) for j in range(dim)]
        name = get(self.criterion)
        if classes:
            criterion = Classes(classes, name == "entropy")
        elif name == "mae":
            criterion = AbsoluteError(cut_points(some.column("y").to_numpy(), get(self.maxBins)))
        else:
            criterion = SquaredError(name == "friedman_mse")
        drawn = get(self.bootstrap)

        def target(batch, tree):
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            if drawn:
                w = w * bootstrap_counts(batch.column("rid").to_numpy(zero_copy_only=False), tree, seed)
            return y, w

        rules = Rules(get(self.maxDepth), get(self.minSplit), get(self.minLeaf),
                      max(1, int(math.sqrt(dim))) if get(self.featureSubset) == "sqrt" else None, cuts is None, seed=seed)
        bounds = cuts if cuts is not None else [cut_points(x[:, j], get(self.maxBins)) for j in range(dim)]
        few = GROUPING * _kinds(bounds, criterion, classes) <= rows
        # random thresholds lie anywhere: groups are of equal values, and few only where all values are thresholds' sides
        alike = cuts is None and name != "mae" and not drawn and all(
            len(c) + 1 == len(np.unique(x[:, j])) for j, c in enumerate(bounds))
        if few and (cuts is not None or alike):
            draws = (lambda rid, tree: bootstrap_counts(rid, tree, seed)) if drawn else None
            trees, gains = self._grow_grouped(data, dim, criterion, rules, cuts, classes, draws)
        else:
            data = data.persist(StorageLevel.MEMORY_AND_DISK)
            trees, gains = grow(data, get(self.numTrees), dim, target, criterion, rules, cuts)
            data.unpersist()
        made = TreeClassificationModel if classes else TreeRegressionModel
        return made(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                    modelData=[[t.listed() for t in trees], gains.tolist(), classes])


    def _grow_grouped(self, data: DataFrame, dim: int, criterion, rules: Rules, cuts, classes: int, draws: Callable | None):
        """The trees of all rows, grown over the sums of those that fall between the same thresholds.

        A value is replaced by the number of its feature's thresholds below it,
        which says as much about any split; without thresholds (``cuts`` None)
        rows of equal values are a group.  The levels then pass over groups,
        whose count the thresholds or values bound, whatever the number of rows.
        """
        count = self.getOrDefault(self.numTrees)
        if cuts is None:
            kinds = data.select("x", "y", "w", (F.col("y") if classes else F.lit(0.0)).alias("kind"))
            groups = _summed_groups(kinds, "x", "kind").withColumn("tree", F.lit(0).cast("long"))
        else:
            groups = _groups(data, dim, cuts, getattr(criterion, "edges", None), classes > 0, draws, count)
        held, groups = _kept(groups)

        def target(batch, tree):
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            if draws is None:
                return kind, np.ones(len(batch))
            return kind, (batch.column("tree").to_numpy(zero_copy_only=False) == tree).astype(float)

        def parts(batch, here):
            kind, s0, s1, s2, n = (batch.column(c).to_numpy(zero_copy_only=False)[here] for c in ("kind", "s0", "s1", "s2", "n"))
            return criterion.grouped(kind, np.stack([s0, s1, s2], axis=1), n)

        trees, gains = grow(groups, count, dim, target, criterion, rules,
                            None if cuts is None else [np.arange(len(c), dtype=float) for c in cuts], parts)
        held.unpersist()
        if cuts is not None:
            _restore(trees, cuts)
        return trees, gains


class _Trees:
    """Trees kept as lists in the model's data."""

    @property
    def featureImportances(self):
        gains = np.array(self.getModelData()[1])
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    @property
    def trees(self) -> "Grown":
        return Grown(Tree(*lists) for lists in self.getModelData()[0])

    def _summed(self, groups: int = 1) -> Column:
        """Sum of the trees' values; tree i belongs to group i modulo ``groups``."""
        trees = self.trees
        bw = self.sparkContext().broadcast([(t.feature, t.threshold, t.left, t.right, t.value) for t in trees])

        @F.pandas_udf("array<double>")
        def run(x):
            import pandas as pd
            X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            parts = [0.0] * groups
            for i, lists in enumerate(bw.value):
                parts[i % groups] = parts[i % groups] + Tree(*lists, name=[]).predict(X)
            return pd.Series(list(np.concatenate([np.broadcast_to(p, (len(X), 1)) if np.isscalar(p) else p for p in parts], axis=1)))

        return run(self._features())

    @staticmethod
    def sparkContext():
        from pyspark import SparkContext
        return SparkContext.getOrCreate()


class TreeRegressionModel(_Trees, BaseModel):
    """Mean of the trees' leaf values."""

    def _transform(self, df: DataFrame) -> DataFrame:
        n = float(len(self.getModelData()[0]))
        return df.withColumn(self.getPredictionCol(), self._summed()[0] / n)


class TreeClassificationModel(_Trees, BaseClassifierModel):
    """Mean of the trees' class shares."""

    def _transform(self, df: DataFrame) -> DataFrame:
        n, classes = float(len(self.getModelData()[0])), self.getModelData()[2]
        out = df.withColumn("__shares", self._summed())
        return self._emit(out, F.transform("__shares", lambda v: v / n), list(range(classes)), log_space=False).drop("__shares")


# --- second-order boosting --------------------------------------------------------------------

class SecondOrderBoosting(_TreeEstimator):
    """Boosted trees on gradients and Hessians, leaf values shrunk by L1 (alpha) and L2 (lambda) penalties.

    Squared loss from the mean of the target (``numClasses`` 0), logistic loss
    for two classes, softmax with a tree for each class beyond.
    """
    learningRate = Param(Params._dummy(), "learningRate", "share of each step", TypeConverters.toFloat)
    nEstimators = Param(Params._dummy(), "nEstimators", "rounds", TypeConverters.toInt)
    regAlpha = Param(Params._dummy(), "regAlpha", "L1 penalty on leaf values", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty on leaf values", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least Hessian on each side", TypeConverters.toFloat)

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None, maxDepth=6,
                 learningRate=0.3, nEstimators=100, regAlpha=0.0, regLambda=1.0, minChildWeight=1.0, maxBins=64,
                 numClasses=0, keyCols=(), seed=42):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, maxDepth=maxDepth,
                  learningRate=learningRate, nEstimators=nEstimators, regAlpha=regAlpha, regLambda=regLambda,
                  minChildWeight=minChildWeight, maxBins=maxBins, numClasses=numClasses, keyCols=list(keyCols), seed=seed)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        get = self.getOrDefault
        data = self._rows(df).persist(StorageLevel.MEMORY_AND_DISK)
        classes, rate = get(self.numClasses), get(self.learningRate)
        groups = classes if classes > 2 else 1
        base = 0.0
        if not classes:
            base = data.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0]
        rows, some = _sampled(data, SAMPLE_ROWS, ["x"])
        x = _matrix(some.column("x").combine_chunks())
        dim = x.shape[1]
        cuts = [cut_points(x[:, j], get(self.maxBins)) for j in range(dim)]
        steps = cuts
        criterion = SecondOrder(get(self.regAlpha), get(self.regLambda))
        rules = Rules(get(self.maxDepth), min_weight=get(self.minChildWeight), seed=get(self.seed))

        # rows between the same thresholds have the same margin in every round: their gradients add up
        if GROUPING * _kinds(cuts, criterion, classes) <= rows:
            start = _groups(data, dim, cuts, by_class=classes > 0).select(
                "x", (F.col("kind") if classes else F.col("s1") / F.col("s0")).alias("y"), F.col("s0").alias("w"), "n")
            steps = [np.arange(len(c), dtype=float) for c in cuts]
            grouped, start = _kept(start)
        else:
            start = grouped = data.select("x", "y", "w", (F.col("w") > 0).cast("double").alias("n"))

        def gradient(batch, tree):
            y, w, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "n"))
            m = _matrix(batch.column("m"))
            if not classes:
                g, h = m[:, 0] - y, np.ones(len(y))
            elif groups == 1:
                p = 1 / (1 + np.exp(-m[:, 0]))
                g, h = p - y, p * (1 - p)
            else:
                e = np.exp(m - m.max(axis=1, keepdims=True))
                p = e[:, tree] / e.sum(axis=1)
                g, h = p - (y == tree), 2 * p * (1 - p)
            return np.stack([w * g, np.maximum(w * h, 1e-16), n], axis=1), w

        state = start.withColumn("m", F.array(*[F.lit(float(base))] * groups))
        trees, gains, held = [], np.zeros(dim), grouped
        for i in range(get(self.nEstimators)):
            made, gain = grow(state, groups, dim, gradient, criterion, rules, steps)
            for t in made:
                t.value = [[rate * v for v in value] for value in t.value]
            trees += made
            gains += gain
            stepped = state.mapInArrow(_stepped(made), "x array<double>, y double, w double, n double, m array<double>")
            stepped = (cut_lineage(stepped) if i % 10 == 9 else stepped).persist(StorageLevel.MEMORY_AND_DISK)
            stepped.count()
            held.unpersist()
            state = held = stepped
        held.unpersist()
        data.unpersist()
        if steps is not cuts:
            _restore(trees, cuts)
        made = BoostedClassificationModel if classes else BoostedRegressionModel
        return made(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                    modelData=[[t.listed() for t in trees], gains.tolist(), classes, float(base)])


def _stepped(trees: list[Tree]):
    """The rows with each group's margin moved by its new tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, m = _matrix(batch.column("x")), _matrix(batch.column("m")).copy()
            for g, t in enumerate(trees):
                m[:, g] += t.predict(x)[:, 0]
            margins = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("x", "y", "w", "n")], margins],
                                             names=["x", "y", "w", "n", "m"])
    return run


class BoostedRegressionModel(_Trees, BaseModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getPredictionCol(), self._summed()[0] + self.getModelData()[3])


class BoostedClassificationModel(_Trees, BaseClassifierModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        classes = self.getModelData()[2]
        if classes > 2:
            out = df.withColumn("__margins", self._summed(classes))
            return self._emit(out, F.col("__margins"), list(range(classes))).drop("__margins")
        out = df.withColumn("__margins", self._summed())
        return self._emit(out, F.array(F.lit(0.0), F.col("__margins")[0]), [0, 1]).drop("__margins")
