"""Models that are fitted by sums over rows: the driver sees sums only."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import place
from tidemark.sources.shared import dropped, stored

#: Distinct rows of bins that the driver holds to fit trees, and that a task remembers to score them; more of them stay
#: where they are, and each level of a tree is one aggregation.
HELD = 1_000_000


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linear(columns: Sequence[str], beta: Sequence[float]) -> Column:
    """Margin of coefficients, the last of which is the intercept."""
    out = F.lit(float(beta[-1]))
    for c, b in zip(columns, beta, strict=False):
        out = out + F.col(c) * float(b)
    return out


def irls(df: DataFrame, columns: Sequence[str], y: str = "y", weight: str | None = None, l2: float = 1.0, steps: int = 25, tol: float = 1e-9) -> np.ndarray:
    """Logistic coefficients by Newton steps with halving; the intercept, last, isn't penalised."""
    w = F.col(weight) if weight else F.lit(1.0)
    names = [*columns, None]
    x = [F.col(c).cast("double") if c else F.lit(1.0) for c in names]
    n = len(names)
    penalty = np.full(n, l2)
    penalty[-1] = 0

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        m = linear(columns, beta)
        p = sigmoid(m)
        loss = F.sum(w * (F.greatest(m, F.lit(0.0)) - m * F.col(y) + F.log1p(F.exp(-F.abs(m)))))
        grad = [F.sum(w * (p - F.col(y)) * a).alias(f"g{i}") for i, a in enumerate(x)]
        gram = [F.sum(w * p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]
        row = df.agg(loss.alias("loss"), *grad, *gram).first()
        h = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                h[i, j] = h[j, i] = row[f"h{i}_{j}"] or 0.0
        return (row["loss"] or 0.0) + 0.5 * float(penalty @ beta**2), np.array([row[f"g{i}"] or 0.0 for i in range(n)]) + penalty * beta, h + np.diag(penalty + 1e-9)

    beta = np.zeros(n)
    loss, grad, gram = sums(beta)
    for _ in range(steps):
        step, scale = np.linalg.solve(gram, grad), 1.0
        while scale > 1e-4:
            new = beta - scale * step
            at = sums(new)
            if at[0] <= loss + 1e-12:
                break
            scale /= 2
        else:
            break
        done = loss - at[0] < tol * (1 + abs(loss))
        beta, (loss, grad, gram) = new, at
        if done:
            break
    return beta


def ftrl(df: DataFrame, columns: Sequence[str], order: Sequence[str], key: str = "txn_id", y: str = "y", alpha: float = 0.1, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0) -> DataFrame:
    """key and p, each predicted before its row is learned from; rows without a label are predicted only.

    Every prediction depends on all rows before it, so the rows pass one task in order; memory is two numbers for each
    column.
    """
    columns = list(columns)

    def run(batches):  # noqa: ANN001, ANN202
        z, n = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
        for pdf in batches:
            x = np.column_stack([pdf[columns].to_numpy(float), np.ones(len(pdf))])
            x = np.nan_to_num(x)
            out = np.zeros(len(pdf))
            for i, label in enumerate(pdf[y].to_numpy(float)):
                w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
                out[i] = p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x[i])))))
                if math.isnan(label):
                    continue
                g = (p - label) * x[i]
                sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
                z += g - sigma * w
                n += g * g
            yield pd.DataFrame({key: pdf[key], "p": out})

    return df.select(*dict.fromkeys([key, y, *order, *columns])).coalesce(1).sortWithinPartitions(*order).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, p double")


@dataclass(frozen=True)
class Preprocessor:
    """Median for what is missing and a flag for it, log of wide ranges, z-scores cut at 10, categories one-hot."""

    numeric: dict[str, tuple[float, bool, float, float]]
    categories: dict[str, list[str]]

    @classmethod
    def fit(cls, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> Preprocessor:
        first = df.agg(*(F.struct(F.median(c).alias("m"), F.min(c).alias("lo"), F.percentile(c, 0.99).alias("q")).alias(c) for c in numeric)).first()
        wide = {c: first[c]["lo"] is not None and first[c]["lo"] >= 0 and first[c]["q"] >= 50 for c in numeric}
        x = {c: cls._log(F.coalesce(F.col(c).cast("double"), F.lit(float(first[c]["m"] or 0))), wide[c]) for c in numeric}
        second = df.agg(*(F.struct(F.avg(v).alias("a"), F.stddev_pop(v).alias("s")).alias(c) for c, v in x.items())).first()
        cats = {c: [r[0] for r in df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).collect()] for c in categorical}
        return cls({c: (float(first[c]["m"] or 0), wide[c], float(second[c]["a"] or 0), float(second[c]["s"] or 0) or 1.0) for c in numeric}, cats)

    @staticmethod
    def _log(x: Column, wide: bool) -> Column:
        return F.log1p(x) if wide else x

    def columns(self) -> dict[str, Column]:
        out = {}
        for c, (m, wide, a, s) in self.numeric.items():
            x = self._log(F.coalesce(F.col(c).cast("double"), F.lit(m)), wide)
            out[f"x_{c}"] = F.greatest(F.least((x - a) / s, F.lit(10.0)), F.lit(-10.0))
            out[f"x_{c}_missing"] = F.col(c).isNull().cast("double")
        for c, values in self.categories.items():
            out |= {f"x_{c}_{i}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for i, v in enumerate(values)}
        return out


def logloss_gradients(margin: Column, y: Column) -> tuple[Column, Column]:
    p = sigmoid(margin)
    return p - y, F.greatest(p * (1 - p), F.lit(1e-6))


def focal_gradients(margin: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25) -> tuple[Column, Column]:
    """First and second derivative of the focal loss in the margin, the second not below 1e-6."""
    p = sigmoid(margin)
    q = F.when(y == 1, p).otherwise(1 - p)
    a, s = F.when(y == 1, alpha).otherwise(1 - alpha), F.when(y == 1, 1.0).otherwise(-1.0)
    q = F.greatest(q, F.lit(1e-12))
    g = a * s * F.pow(1 - q, gamma) * (gamma * q * F.ln(q) + q - 1)
    inner = F.pow(1 - q, gamma) * (gamma * F.ln(q) + gamma + 1) - gamma * F.pow(1 - q, gamma - 1) * (gamma * q * F.ln(q) + q - 1)
    return g, F.greatest(a * q * (1 - q) * inner, F.lit(1e-6))


def logloss_numbers(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return p - y, np.maximum(p * (1 - p), 1e-6)


def focal_numbers(margin: np.ndarray, y: np.ndarray, gamma: float = 2.0, alpha: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    a, s = np.where(y == 1, alpha, 1 - alpha), np.where(y == 1, 1.0, -1.0)
    q = np.maximum(np.where(y == 1, p, 1 - p), 1e-12)
    inner = (1 - q) ** gamma * (gamma * np.log(q) + gamma + 1) - gamma * (1 - q) ** (gamma - 1) * (gamma * q * np.log(q) + q - 1)
    return a * s * (1 - q) ** gamma * (gamma * q * np.log(q) + q - 1), np.maximum(a * q * (1 - q) * inner, 1e-6)


#: The same derivatives of numbers instead of columns.
NUMBERS: dict[Callable, Callable] = {logloss_gradients: logloss_numbers, focal_gradients: focal_numbers}


def rules(amount: Column, night: Column) -> Column:
    """Score without a model: the amount, three times as much by night."""
    return amount * (1 + 2 * night)


@dataclass
class Node:
    value: float
    feature: int = -1
    edge: int = 0
    missing_left: bool = True
    left: Node | None = None
    right: Node | None = None
    gain: float = 0.0


class Flat:
    """A tree's nodes as arrays, the root first; leaves lead to themselves."""

    def __init__(self, nodes: Sequence[Node]) -> None:
        at = {id(n): i for i, n in enumerate(nodes)}
        self.feature = np.array([n.feature for n in nodes])
        self.edge = np.array([n.edge for n in nodes])
        self.missing_left = np.array([n.missing_left for n in nodes])
        self.value = np.array([n.value for n in nodes])
        self.left, self.right = (np.array([at[id(c or n)] for n, c in zip(nodes, of, strict=True)]) for of in ([n.left for n in nodes], [n.right for n in nodes]))

    @classmethod
    def of(cls, root: Node) -> Flat:
        nodes = [root]
        for n in nodes:
            nodes += [n.left, n.right] if n.left is not None else []
        return cls(nodes)

    def step(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The nodes that rows reach from those they are at."""
        b = bins[np.arange(len(at)), self.feature[at]]
        return np.where(np.where(b == 255, self.missing_left[at], b <= self.edge[at]), self.left[at], self.right[at])

    def values(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), "int64")
        while ((on := self.step(bins, at)) != at).any():
            at = on
        return self.value[at]


@dataclass
class Trees:
    """Boosted trees over binned columns: bin i holds values below the i-th edge and not below the one before, the last bin what is missing."""

    columns: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Node] = field(default_factory=list)

    def bin(self, i: int) -> Column:
        x = F.col(self.columns[i]).cast("double")
        return F.when(x.isNull() | F.isnan(x), 255).otherwise(place(x, self.edges[i]))

    def _goes_left(self, n: Node) -> Column:
        b = F.get("bins", F.lit(n.feature))
        return F.when(b == 255, F.lit(n.missing_left)).otherwise(b <= n.edge)

    def _fold(self, n: Node, leaf) -> Column:  # noqa: ANN001
        if n.left is None:
            return leaf(n)
        return F.when(self._goes_left(n), self._fold(n.left, leaf)).otherwise(self._fold(n.right, leaf))

    def value(self, n: Node) -> Column:
        return self._fold(n, lambda leaf: F.lit(float(leaf.value)))

    def binned(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bins", F.array(*(self.bin(i) for i in range(len(self.columns)))))

    def margin(self) -> Column:
        """Margin from ``bins``."""
        out = F.lit(self.base)
        for t in self.trees:
            out = out + self.value(t)
        return out

    def scores(self) -> Column:
        """Margin from the columns, the same as ``margin`` for any number of trees: a task takes each distinct row of bins through them once."""
        edges, trees, base = [np.array(e) for e in self.edges], [Flat.of(t) for t in self.trees], self.base

        def run(parts):  # noqa: ANN001, ANN202
            known: dict[bytes, float] = {}
            for pdf in parts:
                x = pdf.to_numpy(float)
                bins = np.column_stack([np.where(np.isnan(v), 255, np.searchsorted(e, v, "right")) for v, e in zip(x.T, edges, strict=True)]).astype("uint8")
                keys = [b.tobytes() for b in bins]
                if len(known) > HELD:
                    known.clear()
                new = {k: i for i, k in enumerate(keys) if k not in known}
                if new:
                    cells = bins[list(new.values())]
                    out = np.full(len(cells), base)
                    for t in trees:
                        out += t.values(cells)
                    known.update(zip(new, out.tolist(), strict=True))
                yield pd.Series([known[k] for k in keys], dtype="float64")

        run.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(F.struct(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.columns))))

    def leaves(self) -> Column:
        """Number of the leaf that each tree puts the row in."""
        def numbered(t: Node) -> Column:
            ids: list[int] = []

            def leaf(n: Node) -> Column:
                ids.append(len(ids))
                return F.lit(ids[-1])

            return self._fold(t, leaf)

        return F.array(*map(numbered, self.trees))

    def contributions(self) -> Column:
        """Share of each column in the margin: what the value changes where a path splits on it; with the base they add up to the margin."""
        def paths(n: Node, so_far: tuple[float, ...]) -> Column:
            if n.left is None:
                return F.array(*map(F.lit, so_far))
            step = lambda c: tuple(v + (c.value - n.value) * (i == n.feature) for i, v in enumerate(so_far))
            return F.when(self._goes_left(n), paths(n.left, step(n.left))).otherwise(paths(n.right, step(n.right)))

        none = tuple(0.0 for _ in self.columns)
        out = F.array(*map(F.lit, none))
        for t in self.trees:
            out = F.zip_with(out, paths(t, none), lambda a, b: a + b)
        return out

    def bias(self) -> float:
        return self.base + sum(t.value for t in self.trees)

    def importance(self) -> dict[str, float]:
        gain = np.zeros(len(self.columns))

        def walk(n: Node) -> None:
            if n.left is not None:
                gain[n.feature] += n.gain
                walk(n.left)
                walk(n.right)

        for t in self.trees:
            walk(t)
        share = gain / (gain.sum() or 1)
        return dict(sorted(zip(self.columns, share.tolist(), strict=True), key=lambda x: (-x[1], x[0])))


class _Spread:
    """Rows of bins in the shared folder: margins and gradients are stored once a tree, a level is one aggregation."""

    def __init__(self, rows: DataFrame, model: Trees, gradients: Callable, subsample: float) -> None:
        self.rows, self.model, self.gradients, self.subsample = stored(rows.withColumn("margin", F.lit(model.base)), "boost"), model, gradients, subsample

    def begin(self, turn: int) -> tuple[float, float]:
        g, h = self.gradients(F.col("margin"), F.col("y"))
        rows = self.rows
        if self.subsample < 1:
            rows = rows.where(F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(1 << 52)) < F.lit(int(self.subsample * (1 << 52))))
        self.grads = stored(rows.select("bins", (g * F.col("w")).alias("g"), (h * F.col("w")).alias("h")), "gradients")
        total = self.grads.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).first()
        return total["g"] or 0.0, total["h"] or 0.0

    def histogram(self, nodes: list[Node], open_: list[Node]) -> np.ndarray:
        """Sums of gradients by open node, column and bin; partial sums combine before the shuffle."""
        places = {id(n): i for i, n in enumerate(open_)}
        where = self.model._fold(nodes[0], lambda n: F.lit(places.get(id(n), -1)))
        sums = self.grads.withColumn("node", where).where("node >= 0").select("node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        table = np.zeros((len(open_), len(self.model.columns), 256, 2))
        for r in sums.collect():
            table[r["node"], r["feature"], r["bin"]] = r["g"] or 0.0, r["h"] or 0.0
        return table

    def end(self, nodes: list[Node]) -> None:
        dropped(self.grads)
        self.add(nodes)

    def add(self, nodes: list[Node]) -> None:
        before, self.rows = self.rows, stored(self.rows.withColumn("margin", F.col("margin") + self.model.value(nodes[0])), "boost")
        dropped(before)

    def average_precision(self) -> float:
        from tidemark.operators.metrics import average_precision

        return average_precision(self.rows.select("y", F.col("margin").alias("p"))).first()[0] or 0.0

    def close(self) -> None:
        dropped(self.rows)


class _Held:
    """Distinct rows of bins and label in the driver's memory, with the weight of all rows that are the same."""

    def __init__(self, cells: DataFrame, model: Trees, gradients: Callable) -> None:
        k = len(model.columns)
        got = cells.select(*(F.get("bins", F.lit(i)).alias(f"b{i}") for i in range(k)), "y", "w", "n").toArrow()
        columns = [c.to_numpy() for c in got.columns]
        by = np.lexsort(columns[: k + 1])
        *bins, self.y, self.w, self.n = (c[by] for c in columns)
        self.bins, self.w = np.column_stack(bins).astype("uint8"), np.nan_to_num(self.w)
        self.margin, self.gradients = np.full(len(by), model.base), NUMBERS[gradients]

    def begin(self, turn: int) -> tuple[float, float]:
        with np.errstate(over="ignore"):
            g, h = self.gradients(self.margin, self.y)
        # As sums do that leave out what is null.
        self.g, self.h = np.nan_to_num(g) * self.w, np.nan_to_num(h) * self.w
        self.at = np.zeros(len(g), "int64")
        return float(self.g.sum()), float(self.h.sum())

    def histogram(self, nodes: list[Node], open_: list[Node]) -> np.ndarray:
        if len(nodes) > 1:
            self.at = Flat(nodes).step(self.bins, self.at)
        places = {id(n): i for i, n in enumerate(open_)}
        node = np.array([places.get(id(n), -1) for n in nodes])[self.at]
        inside = node >= 0
        node, bins, g, h = node[inside] * 256, self.bins[inside], self.g[inside], self.h[inside]
        table = np.empty((len(open_), self.bins.shape[1], 256, 2))
        for f in range(bins.shape[1]):
            at = node + bins[:, f]
            for i, v in enumerate((g, h)):
                table[:, f, :, i] = np.bincount(at, v, len(open_) * 256).reshape(-1, 256)
        return table

    def end(self, nodes: list[Node]) -> None:
        self.add(nodes)

    def add(self, nodes: list[Node]) -> None:
        self.margin = self.margin + Flat(nodes).values(self.bins)

    def average_precision(self) -> float:
        _, at = np.unique(-self.margin, return_inverse=True)
        n, pos = np.bincount(at, self.n), np.bincount(at, self.n * np.nan_to_num(self.y))
        return float((pos * pos.cumsum() / n.cumsum()).sum() / pos.sum()) if pos.sum() else 0.0

    def close(self) -> None:
        pass


def _boosted(rows: DataFrame, model: Trees, gradients: Callable = logloss_gradients, subsample: float = 1.0) -> _Spread | _Held:
    """Rows of bins, y and w by their cells, as they pass trees together: with the driver if it can hold them."""
    if subsample < 1:
        return _Spread(rows, model, gradients, subsample)
    if gradients in NUMBERS:
        cells = stored(rows.groupBy("bins", "y").agg(F.sum("w").alias("w"), F.count("*").cast("double").alias("n")), "cells")
        held = _Held(cells, model, gradients) if cells.count() <= HELD else None
        dropped(cells)
        if held:
            return held
    return _Spread(rows, model, gradients, subsample)


def _splits(table: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[list[float]], use: set[int], lam: float, least: float) -> list[tuple[float, int, int, bool, float, float] | None]:
    """For each node the best gain with its column, edge, side of what is missing and sums of the left; the first among equals."""
    sums, what = [], []
    for f, e in enumerate(edges):
        if f not in use or not e:
            continue
        cum = table[:, f, : len(e)].cumsum(1)
        for left in (True, False):
            sums.append(cum + table[:, f, 255:] if left else cum)
            what += [(f, k, left) for k in range(len(e))]
    if not what:
        return [None] * len(g)
    gl, hl = np.moveaxis(np.concatenate(sums, 1), 2, 0)
    gr, hr = g[:, None] - gl, h[:, None] - hl
    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - (g**2 / (h + lam))[:, None]
    gain[(hl < least) | (hr < least)] = -1
    best = gain.argmax(1)
    return [(float(gain[i, b]), *what[b], float(gl[i, b]), float(hl[i, b])) if gain[i, b] > 1e-9 else None for i, b in enumerate(best)]


def fit_trees(df: DataFrame, columns: list[str], y: str = "y", rounds: int = 20, depth: int = 4, rate: float = 0.2, lam: float = 1.0, least: float = 1.0, bins: int = 32, gradients=logloss_gradients, weight: str | None = None, valid: DataFrame | None = None, patience: int = 5, subsample: float = 1.0, colsample: float = 1.0, seed: int = 0) -> Trees:  # noqa: ANN001
    """Histogram boosting: a level of a tree is one sum of gradients by node, column and bin.

    Trees see bins only, so that rows with equal bins and labels have equal gradients: they are added up first, with their
    weights.  Up to ``HELD`` such cells pass the trees in the driver's memory; more stay in the shared folder (``_Spread``),
    where what returns to the driver is bounded by nodes, columns and at most 255 ``bins``.  Each
    tree sees a share ``subsample`` of the rows, by hash, and ``colsample`` of the columns.  With rows
    to validate on, trees stop ``patience`` rounds after the best average precision and those after it are dropped.
    """
    if not 2 <= bins <= 255:
        raise ValueError("bins are numbered in a byte, of which 255 stands for what is missing")
    rng = np.random.default_rng(seed)
    q = [i / bins for i in range(1, bins)]
    got = df.agg(*(F.percentile(F.col(c).cast("double"), q).alias(c) for c in columns), F.avg(F.col(y).cast("double")).alias("__rate")).first()
    rate0 = min(max(got["__rate"] or 0.5, 1e-6), 1 - 1e-6)
    model = Trees(columns, [sorted(set(got[c] or [])) for c in columns], math.log(rate0 / (1 - rate0)))

    def cells(part: DataFrame, w: Column) -> DataFrame:
        return model.binned(part).select("bins", F.col(y).cast("double").alias("y"), w.cast("double").alias("w"), *([F.rand(seed).alias("u")] if subsample < 1 else []))

    rows = _boosted(cells(df, F.col(weight) if weight else F.lit(1.0)), model, gradients, subsample)
    judge = None if valid is None else _boosted(cells(valid, F.lit(1.0)), model)
    best_round, best_ap = 0, -1.0
    for turn in range(rounds):
        g_all, h_all = rows.begin(turn)
        use = set(rng.permutation(len(columns))[: max(1, round(colsample * len(columns)))].tolist())
        root = Node(-rate * g_all / (h_all + lam))
        nodes, open_ = [root], [(root, g_all, h_all)]
        for _ in range(depth):
            table = rows.histogram(nodes, [n for n, _, _ in open_])
            found = _splits(table, np.array([g for _, g, _ in open_]), np.array([h for _, _, h in open_]), model.edges, use, lam, least)
            nxt = []
            for (n, gn, hn), best in zip(open_, found, strict=True):
                if best is None:
                    continue
                n.gain, n.feature, n.edge, n.missing_left, gl, hl = best
                n.left, n.right = Node(-rate * gl / (hl + lam)), Node(-rate * (gn - gl) / (hn - hl + lam))
                nxt += [(n.left, gl, hl), (n.right, gn - gl, hn - hl)]
            nodes += [n for n, _, _ in nxt]
            open_ = nxt
            if not open_:
                break
        model.trees.append(root)
        rows.end(nodes)
        if judge is not None:
            judge.add(nodes)
            ap = judge.average_precision()
            if ap > best_ap:
                best_round, best_ap = turn, ap
            elif turn - best_round >= patience:
                break
    rows.close()
    if judge is not None:
        judge.close()
        del model.trees[best_round + 1 :]
    return model


def reasons(contributions: str, features: Sequence[str], action: Column, n: int = 3) -> Column:
    """The n largest positive contributions, for all but approved rows."""
    pairs = F.transform(F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.col(contributions).alias("value")), lambda x: F.struct((-x["value"]).alias("by"), x["feature"].alias("feature")))
    top = F.slice(F.array_sort(F.filter(pairs, lambda x: x["by"] < 0)), 1, n)
    return F.when(action != "approve", F.transform(top, lambda x: F.struct(x["feature"].alias("feature"), (-x["by"]).alias("value"))))


def explanation(contributions: str, features: Sequence[str]) -> Column:
    """All contributions, largest by size first."""
    pairs = F.transform(F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.col(contributions).alias("value")), lambda x: F.struct((-F.abs(x["value"])).alias("by"), x["feature"].alias("feature"), x["value"].alias("value")))
    return F.transform(F.array_sort(pairs), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))
