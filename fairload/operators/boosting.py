"""Second-order boosted trees on binned inputs, and the Shapley values of their scores.

Inputs are cut once, at quantiles from one distributed aggregate, and kept as a byte each. A level of a tree
needs only the sums of gradient and curvature by (node, input, bin): each task adds up its own rows, one
aggregate adds up the tasks, and the splits are chosen from at most ``2 ** depth * inputs * 64`` sums. A missing
input goes the way that lowers the loss more, which each split learns.

Gradients are whole multiples of ``1 / UNIT``, so sums do not depend on how rows are spread: the same rows and
cuts give the same trees under any partitioning and after lost executors. Up to ``LOCAL_ROWS`` rows, all levels of all rounds
run in one task on the binned rows; beyond, each level is a Spark job over all partitions. Both give the same trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import factorial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairload.session import staged

#: Bins of an input; the last place of a bin table is for missing inputs.
BINS = 63
MISSING = 63
PLACES = 64
UNIT = float(1 << 24)
#: Rows that one task holds in memory at most, about 60 bytes each.
LOCAL_ROWS = 6_000_000
#: Rows that are looked at together, and numbers that stand for the bins of a few inputs.
CHUNK = 1 << 17
GROUP_PLACES = 1024
#: Rounds after which the scores of all rows are written, where levels are Spark jobs.
ROUNDS_A_TABLE = 16
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Boosting:
    rounds: int = 400
    depth: int = 6
    rate: float = 0.08
    subsample: float = 0.9
    columns: float = 0.9  # share of the inputs that a tree may use
    seed: int = 7
    penalty: float = 1.0  # on the squares of leaf values
    least_curvature: float = 1.0  # of a child

    def shortened(self, rounds: int | None) -> Boosting:
        """The same with at most ``rounds`` rounds; unchanged without a number."""
        return self if rounds is None else replace(self, rounds=min(rounds, self.rounds))


class Tree(NamedTuple):
    """Nodes in heap order: the children of node i are 2 i + 1 and 2 i + 2; ``feature`` is -1 at leaves."""

    feature: np.ndarray
    cut: np.ndarray  # bins up to this one go left
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # sum of curvature


def _stump(depth: int) -> Tree:
    n = (1 << (depth + 1)) - 1
    return Tree(np.full(n, -1), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), np.zeros(n), np.zeros(n))


def _children(tree: Tree) -> np.ndarray:
    """(node, bin), flat: where a row goes from a node, which is the node itself at a leaf."""
    node, bins = np.arange(len(tree.feature))[:, None], np.arange(PLACES)
    left = np.where(bins == MISSING, tree.missing_left[:, None], bins <= tree.cut[:, None])
    return np.where(tree.feature[:, None] < 0, node, 2 * node + 2 - left).reshape(-1)


def _step(tree: Tree, child: np.ndarray, at: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """From each row's node to the next; the row's bins begin at its offset in ``flat``."""
    return child.take((at << 6) + flat.take(np.maximum(tree.feature, 0).take(at) + offsets))


def descend(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node where each row ends."""
    child, flat = _children(tree), np.ascontiguousarray(bins).reshape(-1)
    at, offsets = np.zeros(len(bins), dtype=np.intp), np.arange(len(bins)) * bins.shape[1]
    while (tree.feature[at] >= 0).any():
        at = _step(tree, child, at, flat, offsets)
    return at


# ---------------------------------------------------------------- fitting


def _coins(hashes: np.ndarray, seed: int, k: int) -> np.ndarray:
    """A number in [0, 1) for each row and round, from the row's own hash."""
    x = hashes.view(np.uint64) ^ np.uint64((seed * 1_000_003 + k * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _columns(p: Boosting, n: int, k: int) -> np.ndarray:
    """Inputs that tree ``k`` may use."""
    order = np.argsort(_coins(np.arange(1, n + 1, dtype=np.int64), p.seed + 77, k), kind="stable")
    chosen = np.zeros(n, dtype=bool)
    chosen[order[: max(1, int(p.columns * n))]] = True
    return chosen


def _slopes(y: np.ndarray, score: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss, in whole units."""
    if not logistic:
        return np.rint((score - y) * UNIT), np.full(len(y), UNIT)
    p = 1.0 / (1.0 + np.exp(-score))
    return np.rint((p - y) * UNIT), np.rint(p * (1.0 - p) * UNIT)


class Rows(NamedTuple):
    bins: np.ndarray
    y: np.ndarray
    hashes: np.ndarray


def _drawn(rows: Rows, p: Boosting, k: int) -> np.ndarray:
    """Places of the rows that tree ``k`` is grown on."""
    return np.flatnonzero(_coins(rows.hashes, p.seed, k) < p.subsample) if p.subsample < 1 else np.arange(len(rows.y))


def _level_sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """(node of the level, input, bin, 2): sums of gradient and curvature of the rows at nodes ``at``."""
    nodes, n = 1 << level, bins.shape[1]
    base = at - (nodes - 1)
    if (base < 0).any():  # rows in leaves higher up are done
        kept = base >= 0
        bins, g, h, base = bins[kept], g[kept], h[kept], base[kept]
    base, out = base * PLACES, np.empty((nodes, n, PLACES, 2))
    for f in range(n):
        place = base + bins[:, f]
        out[:, f, :, 0] = np.bincount(place, g, nodes * PLACES).reshape(nodes, PLACES)
        out[:, f, :, 1] = np.bincount(place, h, nodes * PLACES).reshape(nodes, PLACES)
    return out


def _split_level(tree: Tree, sums: np.ndarray, level: int, p: Boosting, allowed: np.ndarray) -> bool:
    """Choose the splits of a level by their gain; False if no node splits. Ties go to the first input and bin."""
    first, sums = (1 << level) - 1, sums / UNIT
    total = sums[:, 0].sum(axis=1)
    below = np.cumsum(sums[:, :, :BINS], axis=2)
    missing = sums[:, :, MISSING][:, :, None]
    sides = [below, below + missing] if missing.any() else [below]  # missing inputs right, missing inputs left
    left = np.stack(sides, axis=3)
    right = total[:, None, None, None] - left
    if level == 0:
        _leaf(tree, 0, total[0], p)
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + p.penalty)
    gain = worth(left) + worth(right) - worth(total)[:, None, None, None]
    possible = (left[..., 1] >= p.least_curvature) & (right[..., 1] >= p.least_curvature) & allowed[None, :, None, None]
    gain = np.where(possible, gain, -np.inf)
    best = gain.reshape(len(gain), -1).argmax(axis=1)
    any_split = False
    for j, at in enumerate(best):
        f, b, side = np.unravel_index(at, gain.shape[1:])
        if not gain[j, f, b, side] > LEAST_GAIN:
            continue
        node, any_split = first + j, True
        tree.feature[node], tree.cut[node], tree.missing_left[node] = f, b, bool(side)
        _leaf(tree, 2 * node + 1, left[j, f, b, side], p)
        _leaf(tree, 2 * node + 2, right[j, f, b, side], p)
    return any_split


def _leaf(tree: Tree, node: int, sums: np.ndarray, p: Boosting) -> None:
    tree.value[node] = -p.rate * sums[0] / (sums[1] + p.penalty)
    tree.cover[node] = sums[1]


Sums = Callable[[Tree, int], np.ndarray]


def _grow(p: Boosting, k: int, inputs: int, sums: Sums) -> Tree:
    tree, allowed = _stump(p.depth), _columns(p, inputs, k)
    for level in range(p.depth):
        if not _split_level(tree, sums(tree, level), level, p, allowed):
            break
    return tree


class _Places:
    """The bins of rows in memory, a few inputs in one number: as many as ``GROUP_PLACES`` can tell apart."""

    def __init__(self, bins: np.ndarray):
        self.rows, self.inputs = bins.shape
        seen = np.zeros((self.inputs, PLACES), dtype=bool)
        for c in _chunks(self.rows):
            for f in range(self.inputs):
                seen[f] |= np.bincount(bins[c, f], minlength=PLACES) > 0
        self.codes = [np.flatnonzero(s) for s in seen]  # only bins that occur have a place
        self.groups: list[list[int]] = []
        for f in sorted(range(self.inputs), key=lambda f: -len(self.codes[f])):
            group = next((g for g in self.groups if self.size([*g, f]) <= GROUP_PLACES), None)
            if group is None:
                self.groups.append([f])
            else:
                group.append(f)
        self.places = [np.zeros(self.rows, dtype=np.uint16) for _ in self.groups]
        for place, group in zip(self.places, self.groups):
            for f in group:
                code = np.zeros(PLACES, dtype=np.uint16)
                code[self.codes[f]] = np.arange(len(self.codes[f]))
                for c in _chunks(self.rows):
                    place[c] = place[c] * max(1, len(self.codes[f])) + code[bins[c, f]]

    def size(self, group: list[int]) -> int:
        return int(np.prod([max(1, len(self.codes[f])) for f in group]))

    def by_input(self, sums: list[np.ndarray], nodes: int) -> np.ndarray:
        """(node, input, bin, 2) from the sums of each group by (which, node, place)."""
        out = np.zeros((nodes, self.inputs, PLACES, 2))
        for total, group in zip(sums, self.groups):
            total = total.reshape(2, nodes, *(max(1, len(self.codes[f])) for f in group))
            for k, f in enumerate(group):
                others = tuple(2 + j for j in range(len(group)) if j != k)
                out[:, f, self.codes[f]] = total.sum(axis=others).transpose(1, 2, 0)[:, : len(self.codes[f])]
        return out


def _chunks(n: int) -> list[slice]:
    return [slice(at, min(n, at + CHUNK)) for at in range(0, n, CHUNK)]


def _fit_here(rows: Rows, start: float, p: Boosting, logistic: bool) -> list[Tree]:
    """All rounds on rows in memory.

    A level counts the child with fewer rows of each split; the other child is what is left of the parent. Sums are
    whole numbers, so this is exact. Rows that a tree is not grown on have no slope.
    """
    n, inputs = rows.bins.shape
    flat, held, chunks = np.ascontiguousarray(rows.bins).reshape(-1), _Places(rows.bins), _chunks(n)
    offsets = np.arange(min(n, CHUNK)) * inputs
    score, g, h = np.full(n, start), np.empty(n), np.empty(n)
    at, trees = np.zeros(n, dtype=np.min_scalar_type(2 << p.depth)), []

    def moved(tree: Tree, child: np.ndarray, c: slice) -> np.ndarray:
        """Takes the rows of a chunk to their next nodes, and returns these."""
        now = _step(tree, child, at[c].astype(np.intp), flat[c.start * inputs : c.stop * inputs], offsets[: c.stop - c.start])
        at[c] = now
        return now

    def counted(slot: np.ndarray, nodes: int) -> np.ndarray:
        """Sums of the rows at nodes that have a slot."""
        sums = [np.zeros((2, nodes * held.size(group))) for group in held.groups]
        for c in chunks:
            which = slot.take(at[c])
            some = np.flatnonzero(which >= 0)
            if not len(some):
                continue
            alike = len(some) == len(which)
            which, slopes = (which, (g[c], h[c])) if alike else (which[some], (g[c][some], h[c][some]))
            for total, place, group in zip(sums, held.places, held.groups):
                place = place[c] if alike else place[c][some]
                place = which * held.size(group) + place if nodes > 1 else place.astype(np.intp)
                for one, slope in zip(total, slopes):
                    one += np.bincount(place, slope, len(one))
        return held.by_input(sums, nodes)

    for k in range(p.rounds):
        at[:] = 0
        for c in chunks:
            g[c], h[c] = _slopes(rows.y[c], score[c], logistic)
            if p.subsample < 1:
                drawn = _coins(rows.hashes[c], p.seed, k) < p.subsample
                g[c] *= drawn
                h[c] *= drawn
        above = np.zeros(0)

        def sums(tree: Tree, level: int) -> np.ndarray:
            nonlocal above
            slot, first = np.full(len(tree.feature), -1), (1 << level) - 1
            if level == 0:
                slot[0] = 0
                above = counted(slot, 1)
                return above
            child, most = _children(tree), np.zeros(len(tree.feature), dtype=np.int64)
            for c in chunks:
                most += np.bincount(moved(tree, child, c), minlength=len(most))
            split = np.flatnonzero(tree.feature[first >> 1 : first] >= 0)
            left = first + 2 * split
            fewer = left + (most[left + 1] < most[left])
            slot[fewer] = np.arange(len(fewer))
            part = counted(slot, len(fewer))
            found = np.zeros((1 << level, *part.shape[1:]))
            found[fewer - first], found[2 * left + 1 - fewer - first] = part, above[split] - part
            above = found
            return found

        tree = _grow(p, k, inputs, sums)
        trees.append(tree)
        child = _children(tree)
        for c in chunks:
            score[c] += tree.value.take(moved(tree, child, c))
    return trees


def _unpacked(batch: pd.DataFrame, inputs: int) -> Rows:
    bins = np.frombuffer(b"".join(batch["bins"]), dtype=np.uint8).reshape(-1, inputs)
    return Rows(bins, batch["y"].to_numpy(dtype=float), batch["hash"].to_numpy(dtype=np.int64))


def _fit_in_one_task(binned: DataFrame, inputs: int, start: float, p: Boosting, logistic: bool) -> list[Tree]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [_unpacked(b, inputs) for b in batches if len(b)]
        if parts:
            rows = Rows(*(np.concatenate(x) for x in zip(*parts)))
            trees = _fit_here(rows, start, p, logistic)
            yield pd.DataFrame({"k": range(len(trees))} | {f: [list(getattr(t, f)) for t in trees] for f in Tree._fields})

    schema = "k int, feature array<long>, cut array<long>, missing_left array<boolean>, value array<double>, cover array<double>"
    found = binned.coalesce(1).mapInPandas(run, schema).toPandas().sort_values("k")
    return [Tree(*(np.array(r[f]) for f in Tree._fields)) for _, r in found.iterrows()]


def _fit_by_jobs(binned: DataFrame, inputs: int, start: float, p: Boosting, logistic: bool) -> list[Tree]:
    """A level a job. Scores are written now and then; the trees since then are added up in the task."""
    trees: list[Tree] = []
    scored, done = binned.withColumn("score", F.lit(start)), 0

    def score_of(batch: pd.DataFrame, rows: Rows, later: list[Tree]) -> np.ndarray:
        score = batch["score"].to_numpy(dtype=float)
        for t in later:
            score = score + t.value[descend(t, rows.bins)]
        return score

    def sums(tree: Tree, level: int) -> np.ndarray:
        k, later, shape = len(trees), trees[done:], (1 << level, inputs, PLACES, 2)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(shape)
            for batch in batches:
                rows = _unpacked(batch, inputs)
                drawn = _drawn(rows, p, k)
                g, h = _slopes(rows.y[drawn], score_of(batch, rows, later)[drawn], logistic)
                total += _level_sums(rows.bins[drawn], g, h, descend(tree, rows.bins[drawn]), level)
            flat = total.reshape(-1, 2)
            at = np.flatnonzero(flat.any(axis=1))
            yield pd.DataFrame({"at": at, "g": flat[at, 0].astype(np.int64), "h": flat[at, 1].astype(np.int64)})

        found = scored.mapInPandas(run, "at long, g long, h long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        out = np.zeros((int(np.prod(shape[:3])), 2))
        out[found["at"].to_numpy()] = found[["g", "h"]].to_numpy()
        return out.reshape(shape)

    for k in range(p.rounds):
        trees.append(_grow(p, k, inputs, sums))
        if len(trees) - done == ROUNDS_A_TABLE and len(trees) < p.rounds:
            later = trees[done:]

            def add(batches: Iterator[pd.DataFrame], later: list[Tree] = later) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    yield batch.assign(score=score_of(batch, _unpacked(batch, inputs), later))

            scored, done = staged(scored.mapInPandas(add, scored.schema), "boosting-scores"), len(trees)
    return trees


def quantile_cuts(rows: DataFrame, features: tuple[str, ...]) -> list[np.ndarray]:
    """At most 62 cuts an input, at equal shares of the rows; one aggregate for all inputs."""
    shares = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f) for f in features]).first()
    return [np.unique(np.array(found[f] or [], dtype=float)) for f in features]


def even_cuts(rows: DataFrame, features: tuple[str, ...], n: int) -> list[np.ndarray]:
    """``n`` cuts an input, at equal widths between its least and its greatest value."""
    ends = rows.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.min, F.max)]).first()
    out = []
    for low, high in zip(ends[::2], ends[1::2]):
        out.append(np.array([]) if low is None else np.unique(low + (high - low) * np.arange(1, n + 1) / (n + 1)))
    return out


def _bins_of(inputs: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(inputs[0]), len(inputs)), dtype=np.uint8)
    for f, (x, c) in enumerate(zip(inputs, cuts)):
        out[:, f] = np.where(np.isnan(x), MISSING, np.searchsorted(c, x))
    return out


def fit(
    rows: DataFrame, features: tuple[str, ...], label: str, p: Boosting, logistic: bool, key: Column,
    cuts: list[np.ndarray] | None = None, local_rows: int = LOCAL_ROWS,
) -> Ensemble | None:
    """Fit on the rows that have a label; None without any. ``key`` tells rows apart for their sampling coins."""
    labelled = rows.where(F.col(label).isNotNull())
    y = F.col(label).cast("double")
    seen = labelled.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("spread")).first()
    if not seen.n:
        return None
    cuts = quantile_cuts(labelled, features) if cuts is None else cuts
    if logistic:
        rate = min(max(seen.mean, 1e-6), 1 - 1e-6)
        start, centre, scale = float(np.log(rate / (1 - rate))), 0.0, 1.0
    else:
        start, centre, scale = 0.0, float(seen.mean), float(seen.spread or 1.0)

    def bins(*inputs: pd.Series) -> pd.Series:
        found = _bins_of([c.to_numpy(dtype=float) for c in inputs], cuts)
        return pd.Series([r.tobytes() for r in found])

    coded = F.pandas_udf(bins, "binary")(*[F.col(f).cast("double") for f in features])
    binned = labelled.select(coded.alias("bins"), ((y - centre) / scale).alias("y"), F.xxhash64(key).alias("hash"))
    binned = staged(binned, "boosting-bins")
    way = _fit_in_one_task if seen.n <= local_rows else _fit_by_jobs
    return Ensemble(features, cuts, way(binned, len(features), start, p, logistic), start, centre, scale, logistic)


# ---------------------------------------------------------------- the fitted ensemble


@dataclass(frozen=True)
class Ensemble:
    """Trees over binned inputs. The raw score is ``start`` and the leaf values; of a classifier, log-odds."""

    features: tuple[str, ...]
    cuts: list[np.ndarray]
    trees: list[Tree]
    start: float
    centre: float = 0.0
    scale: float = 1.0
    logistic: bool = True

    def raw(self, inputs: list[np.ndarray]) -> np.ndarray:
        bins = _bins_of(inputs, self.cuts)
        score = np.full(len(bins), self.start)
        for t in self.trees:
            score = score + t.value[descend(t, bins)]
        return score

    def predictor(self) -> Callable[[list[np.ndarray]], np.ndarray]:
        """Predictions of a list of input arrays, for use inside a task."""
        return lambda inputs: self.centre + self.scale * self.raw(inputs)

    def _inputs(self) -> list[Column]:
        return [F.col(f).cast("double") for f in self.features]

    def raw_column(self) -> Column:
        def run(*inputs: pd.Series) -> pd.Series:
            return pd.Series(self.raw([c.to_numpy(dtype=float) for c in inputs]))

        return F.pandas_udf(run, "double")(*self._inputs())

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``."""
        return df.withColumn("prediction", F.lit(self.centre) + self.raw_column() * self.scale)

    def probability(self, df: DataFrame, name: str) -> DataFrame:
        """Adds the probability of class 1 as ``name``."""
        return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-self.raw_column())))

    def contribution_column(self) -> Column:
        """Shapley values of the raw score: one array a row, an entry an input, the expected score last."""
        paths = [_leaf_paths(t) for t in self.trees]

        def run(*inputs: pd.Series) -> pd.Series:
            bins = _bins_of([c.to_numpy(dtype=float) for c in inputs], self.cuts)
            out = np.zeros((len(bins), len(self.features) + 1))
            out[:, -1] = self.start
            for at in range(0, len(bins), 1024):
                part = out[at : at + 1024]
                for tree, leaves in zip(self.trees, paths):
                    _add_shapley(part, tree, leaves, bins[at : at + 1024])
            return pd.Series(list(out))

        return F.pandas_udf(run, "array<double>")(*self._inputs())


# ---------------------------------------------------------------- Shapley values


class Leaves(NamedTuple):
    """The leaves of a tree whose paths meet the same number of inputs."""

    features: np.ndarray  # (leaf, place)
    steps: list  # per leaf and place, the (node, goes left) pairs of that input
    table: np.ndarray  # (leaf, which inputs the row agrees with, place): Shapley values
    expected: float


def _paths(tree: Tree, node: int = 0, above: tuple = ()) -> Iterator[tuple[int, tuple]]:
    if tree.feature[node] < 0:
        yield node, above
        return
    for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
        share = tree.cover[child] / tree.cover[node]
        yield from _paths(tree, child, (*above, (int(tree.feature[node]), node, left, share)))


def _leaf_paths(tree: Tree) -> list[Leaves]:
    """For every leaf and every set of inputs that a row may agree with, the Shapley values of the leaf.

    An input that is not known lets a row through in proportion to the cover. With z the share let through and o
    whether the row agrees, the value of an input is v (o - z) times the sum, over the number k of other inputs that
    are known, of k! (m - 1 - k)! / m! times the coefficient of t^k in the product of (z + o t) of the others.
    """
    by_size: dict[int, list] = {}
    for leaf, path in _paths(tree):
        found: dict[int, list] = {}
        for f, node, left, share in path:
            entry = found.setdefault(f, [1.0, []])
            entry[0] *= share
            entry[1].append((node, left))
        by_size.setdefault(len(found), []).append((tree.value[leaf], found))
    out = []
    for m, leaves in by_size.items():
        value = np.array([v for v, _ in leaves])
        z = np.array([[e[0] for e in found.values()] for _, found in leaves]).reshape(len(leaves), m)
        expected = float((value * z.prod(axis=1)).sum())
        agrees = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1  # (set, place)
        table = np.zeros((len(leaves), 1 << m, m))
        for i in range(m):
            poly = np.zeros((len(leaves), 1 << m, m))
            poly[:, :, 0] = 1.0
            for j in (j for j in range(m) if j != i):
                shifted = np.zeros_like(poly)
                shifted[:, :, 1:] = poly[:, :, :-1]
                poly = poly * z[:, None, j, None] + shifted * agrees[None, :, j, None]
            weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
            table[:, :, i] = value[:, None] * (agrees[None, :, i] - z[:, i, None]) * (poly @ weight)
        features = np.array([list(found) for _, found in leaves], dtype=int).reshape(len(leaves), m)
        out.append(Leaves(features, [[e[1] for e in found.values()] for _, found in leaves], table, expected))
    return out


def _add_shapley(out: np.ndarray, tree: Tree, groups: list[Leaves], bins: np.ndarray) -> None:
    left = {}
    for node in np.flatnonzero(tree.feature >= 0):
        b = bins[:, tree.feature[node]]
        left[node] = np.where(b == MISSING, tree.missing_left[node], b <= tree.cut[node])
    for g in groups:
        out[:, -1] += g.expected
        for leaf, steps in enumerate(g.steps):
            which = np.zeros(len(bins), dtype=np.int64)
            for place, nodes in enumerate(steps):
                agrees = np.ones(len(bins), dtype=bool)
                for node, goes_left in nodes:
                    agrees &= left[node] == goes_left
                which |= agrees.astype(np.int64) << place
            if steps:
                out[:, g.features[leaf]] += g.table[leaf][which]
