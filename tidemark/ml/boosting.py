"""Boosted regression trees over binned features, with leaf-wise or level-wise growth, L1 and L2, early stopping with
patience, and exact contributions of the features to a prediction.

A model is fitted on a bounded sample of labelled rows (`SAMPLE_ROWS`, a parameter) in one task, several models in
tasks side by side; all rows are scored, in Arrow batches. Everything a fit does is in arrays: a histogram of gradients
per leaf, the smaller child's by one pass over its rows, the larger one's by subtraction.

Defined cases: rows with a missing feature or target are left out of the fit and of the scores. Without rows the model
is a constant 0, without validation rows there is no early stopping. Constant features are never split on. Equal gains
take the first feature and the lowest threshold, so a fit with a seed is reproducible.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a model is fitted on at most, about: a hashed share of all rows where there are more.
SAMPLE_ROWS, BINS = 100_000, 255


@dataclass(frozen=True)
class Params:
    """leaves > 0: the leaf of the largest gain is split next, up to so many leaves; 0: level by level."""

    rounds: int = 500
    rate: float = 0.05
    depth: int = 6
    leaves: int = 31
    least_rows: int = 20
    rows: float = 0.8
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    patience: int = 50
    seed: int = 42


# The two learners of the blend.
LEAF_WISE, LEVEL_WISE = Params(), Params(leaves=0, least_rows=1, seed=43)


@dataclass
class Tree:
    """feature < 0: a leaf. Rows with x <= at go left."""

    feature: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), "int32")
        rows = np.arange(len(x))
        while True:
            f = self.feature[node]
            go = f >= 0
            if not go.any():
                return self.value[node]
            i, n = rows[go], node[go]
            node[i] = np.where(x[i, f[go]] <= self.at[n], self.left[n], self.right[n])


@dataclass
class Trees:
    base: float
    trees: list[Tree]
    features: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.scores(x)
        return out

    @property
    def importances(self) -> np.ndarray:
        """The share of each feature in the gains of all splits."""
        g = np.zeros(self.features)
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(g, t.feature[inner], t.gain[inner])
        return g / g.sum() if g.sum() > 0 else g

    def contributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """((rows, features), expectation): Shapley values of the trees' own conditional expectations; a row's sum and the
        expectation give its prediction."""
        out, mean = np.zeros((len(x), self.features)), self.base
        for t in self.trees:
            mean += float(_leaf_walk(t, x, out))
        return out, mean

    def to_json(self) -> str:
        return json.dumps({"base": self.base, "features": self.features, "trees": [{k: v.tolist() for k, v in asdict(t).items()} for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Trees:
        d = json.loads(text)
        kinds = {"feature": "int32", "left": "int32", "right": "int32"}
        return cls(d["base"], [Tree(**{k: np.array(v, kinds.get(k, "float64")) for k, v in t.items()}) for t in d["trees"]], d["features"])


def _leaf_walk(t: Tree, x: np.ndarray, out: np.ndarray) -> float:
    """Adds each leaf's share to out; returns the expectation. A leaf's path is reduced to its distinct features: of each
    the share of rows that passes (without knowing the feature) and which rows pass (knowing it)."""
    mean, stack = 0.0, [(0, {})]
    while stack:
        node, path = stack.pop()
        f = int(t.feature[node])
        if f >= 0:
            goes = x[:, f] <= t.at[node]
            for child, ok in ((int(t.left[node]), goes), (int(t.right[node]), ~goes)):
                share, knows = path.get(f, (1.0, None))
                stack.append((child, {**path, f: (share * t.cover[child] / t.cover[node], ok if knows is None else knows & ok)}))
            continue
        v, d = float(t.value[node]), len(path)
        mean += v * float(np.prod([s for s, _ in path.values()]))
        if not d:
            continue
        zero = np.array([s for s, _ in path.values()])
        one = np.stack([k for _, k in path.values()]).astype("float64")
        # p[k]: sum over the subsets of k features of the product of what these know and the others do not
        p = np.zeros((d + 1, len(x)))
        p[0] = 1.0
        for j in range(d):
            p[1 : j + 2] = p[1 : j + 2] * zero[j] + p[: j + 1] * one[j]
            p[0] = p[0] * zero[j]
        weight = np.ones(d)  # |S|! (d - 1 - |S|)! / d!
        for k in range(d):
            weight[k] = 1.0 / (d * _choose(d - 1, k))
        for j, f in enumerate(path):
            # the same sums without feature j, by division: zero[j] is a share of rows and never 0
            q = np.empty((d, len(x)))
            q[0] = p[0] / zero[j]
            for k in range(1, d):
                q[k] = (p[k] - q[k - 1] * one[j]) / zero[j]
            out[:, f] += v * (one[j] - zero[j]) * (weight[:, None] * q).sum(axis=0)
    return mean


def _choose(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds between the bins of each column: the distinct values, or quantiles where these are many."""
    out = []
    for c in x.T:
        u = np.unique(c)
        if len(u) > BINS:
            u = np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1), method="lower"))
        out.append(u[:-1])
    return out


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


class _Grower:
    def __init__(self, b: np.ndarray, edges: list[np.ndarray], p: Params):
        self.b, self.edges, self.p = b, edges, p
        self.inside = np.array([len(e) for e in edges])[:, None] > np.arange(BINS)[None]  # thresholds that exist

    def histogram(self, rows: np.ndarray, g: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """(2, columns, bins): gradients and counts."""
        width = BINS + 1
        at = (self.b[np.ix_(rows, cols)].astype("int64") + np.arange(len(cols)) * width).ravel()
        n = len(cols) * width
        return np.stack([np.bincount(at, np.repeat(g[rows], len(cols)), n), np.bincount(at, minlength=n)]).reshape(2, len(cols), width)

    def best(self, h: np.ndarray, cols: np.ndarray) -> tuple[float, int, int]:
        """(gain, column, bin) of the best split of a leaf."""
        p, (g, n) = self.p, h
        total_g, total_n = g[0].sum(), n[0].sum()
        lg, ln = g.cumsum(axis=1)[:, :-1], n.cumsum(axis=1)[:, :-1]
        rg, rn = total_g - lg, total_n - ln
        score = lambda g_, n_: _soft(g_, p.l1) ** 2 / (n_ + p.l2)
        gain = score(lg, ln) + score(rg, rn) - score(total_g, total_n)
        gain[(ln < p.least_rows) | (rn < p.least_rows) | ~self.inside[cols]] = -np.inf
        k = int(gain.argmax())
        j, at = divmod(k, gain.shape[1])
        return float(gain[j, at]), int(cols[j]), at

    def tree(self, g: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Tree:
        p = self.p
        nodes: list[list[float]] = []  # feature, at, left, right, value, cover, gain

        def leaf(r: np.ndarray) -> int:
            nodes.append([-1, 0.0, 0, 0, float(-p.rate * _soft(g[r].sum(), p.l1) / (len(r) + p.l2)), len(r), 0.0])
            return len(nodes) - 1

        h = self.histogram(rows, g, cols)
        open_ = [(*self.best(h, cols), leaf(rows), 0, rows, h)]
        leaves, most = 1, p.leaves or 2**p.depth
        while open_ and leaves < most:
            # the largest gain first; level by level the order does not matter, as all are split
            i = max(range(len(open_)), key=lambda k: (open_[k][0], -open_[k][3])) if p.leaves else 0
            gain, f, at, node, depth, r, h = open_.pop(i)
            if gain <= 1e-12 or depth >= p.depth:
                continue
            goes = self.b[r, f] <= at
            lr, rr = r[goes], r[~goes]
            small = self.histogram(lr if len(lr) <= len(rr) else rr, g, cols)
            lh, rh = (small, h - small) if len(lr) <= len(rr) else (h - small, small)
            a, b = leaf(lr), leaf(rr)
            nodes[node][:4] = [f, float(self.edges[f][at]), a, b]
            nodes[node][6] = gain
            leaves += 1
            if depth + 1 < p.depth:
                open_ += [(*self.best(lh, cols), a, depth + 1, lr, lh), (*self.best(rh, cols), b, depth + 1, rr, rh)]
        c = list(zip(*nodes, strict=True))
        return Tree(np.array(c[0], "int32"), np.array(c[1]), np.array(c[2], "int32"), np.array(c[3], "int32"), np.array(c[4]), np.array(c[5], "float64"), np.array(c[6]))


def fit(x: np.ndarray, y: np.ndarray, xv: np.ndarray | None = None, yv: np.ndarray | None = None, p: Params = LEAF_WISE) -> Trees:
    """Squared loss. With validation rows the rounds up to the best one are kept; the fit ends `patience` rounds after it."""
    m = x.shape[1]
    if not len(x):
        return Trees(0.0, [], m)
    rng = np.random.default_rng(p.seed)
    edges = _edges(x)
    b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype("uint8")
    grow, base = _Grower(b, edges, p), float(y.mean())
    now, ahead = np.full(len(x), base), np.full(0 if xv is None else len(xv), base)
    out, best, best_at = [], np.inf, 0
    for k in range(p.rounds):
        rows = np.sort(rng.choice(len(x), max(1, int(p.rows * len(x))), replace=False)) if p.rows < 1 else np.arange(len(x))
        cols = np.sort(rng.choice(m, max(1, int(round(p.columns * m))), replace=False)) if p.columns < 1 else np.arange(m)
        t = grow.tree(now - y, rows, cols)
        if len(t.value) == 1:  # no split: the sampled rows' mean is no information
            t.value[:] = 0.0
        out.append(t)
        now = now + t.scores(x)
        if len(ahead):
            ahead = ahead + t.scores(xv)
            loss = float(((ahead - yv) ** 2).mean())
            if loss < best:
                best, best_at = loss, k
            elif k - best_at >= p.patience:
                break
    return Trees(base, out[: best_at + 1] if len(ahead) else out, m)


def bounded(df: DataFrame, keys: Sequence[str], rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """df, or a share of it of about `rows` rows that depends on the keys only."""
    n = df.count()
    return df if n <= rows else df.filter(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def fit_models(df: DataFrame, features: Sequence[str], target: str, validation: str, models: dict[str, Params], keys: Sequence[str] = ("symbol", "date"), rows: int = SAMPLE_ROWS) -> dict[str, Trees]:
    """A model per entry of `models`, each in a task of its own, on the same bounded sample; `validation` is a boolean column."""
    k = len(features)
    x = bounded(df.dropna(subset=[*features, target]), keys, rows).select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y"), F.col(validation).alias("v"), F.xxhash64(*keys).alias("o"))
    x = x.withColumn("model", F.explode(F.array(*map(F.lit, models))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        v, m = pdf.v.to_numpy(bool), np.array(pdf.x.tolist(), "float64").reshape(-1, k)
        y = pdf.y.to_numpy("float64")
        return pd.DataFrame({"model": [key[0]], "trees": [fit(m[~v], y[~v], m[v], y[v], models[key[0]]).to_json()]})

    got = {r.model: Trees.from_json(r.trees) for r in x.groupBy("model").applyInPandas(run, "model string, trees string").collect()}  # a row a model
    return {n: got.get(n, Trees(0.0, [], k)) for n in models}


def score(df: DataFrame, features: Sequence[str], models: dict[str, Trees]) -> DataFrame:
    """df with a column of predictions per model."""
    sent = df.sparkSession.sparkContext.broadcast({n: m.to_json() for n, m in models.items()})  # bounded by the parameters
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` double" for n in models])

    def go(batches):
        ready = {n: Trees.from_json(t) for n, t in sent.value.items()}
        for b in batches:
            x = b[list(features)].to_numpy("float64")
            yield b.assign(**{n: m.predict(x) for n, m in ready.items()})

    return df.mapInPandas(go, schema)


def drivers(df: DataFrame, features: Sequence[str], model: Trees, most: int = 5, out: str = "causal_drivers") -> DataFrame:
    """df with the features of the largest absolute contributions to each row's prediction (a top-k report)."""
    sent, names = df.sparkSession.sparkContext.broadcast(model.to_json()), list(features)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<struct<weight:double,feature:string,value:double,impact:string>>"

    def go(batches):
        m = Trees.from_json(sent.value)
        for b in batches:
            x = b[names].to_numpy("float64")
            c, _ = m.contributions(x)
            top = np.argsort(-np.abs(c), axis=1, kind="stable")[:, :most]
            yield b.assign(**{out: [[{"weight": float(abs(c[i, j])), "feature": names[j], "value": float(x[i, j]), "impact": "positive" if c[i, j] >= 0 else "negative"} for j in t] for i, t in enumerate(top)]})

    return df.mapInPandas(go, schema)


#: The ranges of the search, (low, high, 'int', 'float' or 'log').
SPACE = {"leaves": (15, 63, "int"), "depth": (3, 8, "int"), "rate": (0.01, 0.2, "log"), "least_rows": (10, 50, "int"), "rows": (0.6, 1.0, "float"), "columns": (0.6, 1.0, "float"), "l1": (1e-3, 10.0, "log"), "l2": (1e-3, 10.0, "log")}


def propose(done: list[tuple[dict, float]], space: dict, n: int, rng: np.random.Generator, start: int = 20) -> list[dict]:
    """n further trials: at random at first, then those of many candidates that the better quarter of the trials so far
    makes likely and the rest unlikely (kernel densities on the unit cube)."""
    to = {k: (lambda v, a=a, b=b, s=s: (np.log(v / a) / np.log(b / a)) if s == "log" else (v - a) / (b - a)) for k, (a, b, s) in space.items()}
    back = {k: (lambda u, a=a, b=b, s=s: int(round(a + u * (b - a))) if s == "int" else float(a * (b / a) ** u if s == "log" else a + u * (b - a))) for k, (a, b, s) in space.items()}
    out = []
    for _ in range(n):
        if len(done) < start:
            u = rng.random(len(space))
        else:
            pts = np.array([[to[k](d[k]) for k in space] for d, _ in sorted(done, key=lambda r: -r[1])])
            cut_ = max(2, len(pts) // 4)
            c = np.clip(pts[rng.integers(0, cut_, 64)] + rng.normal(0, 0.12, (64, len(space))), 0, 1)
            density = lambda p: np.exp(-((c[:, None] - p[None]) ** 2).sum(axis=2) / (2 * 0.2**2)).mean(axis=1) + 1e-12  # noqa: E731, B023
            u = c[int(np.argmax(density(pts[:cut_]) / density(pts[cut_:])))]
        out.append({k: back[k](float(u[i])) for i, k in enumerate(space)})
    return out


def search(df: DataFrame, features: Sequence[str], target: str, validation: str, base: Params = LEAF_WISE, space: dict = SPACE, trials: int = 100, at_once: int = 10, seed: int = 42, rows: int = SAMPLE_ROWS) -> list[tuple[dict, float]]:
    """(parameters, directional accuracy on the validation rows) of all trials, best first. The bounded sample goes to the
    executors once; each batch of trials runs side by side and informs the next."""
    k = len(features)
    x = bounded(df.dropna(subset=[*features, target]), ("symbol", "date"), rows).select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y"), F.col(validation).alias("v"), F.xxhash64("symbol", "date").alias("o"))
    got = sorted(x.collect(), key=lambda r: r.o)  # bounded by `rows`
    m, y, v = np.array([r.x for r in got], "float64").reshape(-1, k), np.array([r.y for r in got]), np.array([r.v for r in got], bool)
    spark = df.sparkSession
    sent, rng, done = spark.sparkContext.broadcast((m, y, v)), np.random.default_rng(seed), []

    def run(batches):
        m, y, v = sent.value
        for b in batches:
            acc = []
            for t in b.trial:
                p = fit(m[~v], y[~v], m[v], y[v], replace(base, **json.loads(t))).predict(m[v])
                acc.append(float((np.sign(p) == np.sign(y[v])).mean()) if v.any() else 0.0)
            yield pd.DataFrame({"trial": b.trial, "accuracy": acc})

    while len(done) < trials:
        todo = [json.dumps(t) for t in propose(done, space, min(at_once, trials - len(done)), rng)]
        batch = spark.createDataFrame([(t,) for t in todo], "trial string").repartition(len(todo))
        score_of = {r.trial: r.accuracy for r in batch.mapInPandas(run, "trial string, accuracy double").collect()}
        done += [(json.loads(t), score_of[t]) for t in todo]
    return sorted(done, key=lambda r: -r[1])
