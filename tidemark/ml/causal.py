"""Causal feature selection: lagged regression tests, conditional independence over time lags, and their combination."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import chi2_sf, t_two_sided
from tidemark.ml.boosting import bounded
from tidemark.ml.independence import SAMPLE_ROWS, SHUFFLES, TESTS


def _ssr(y: np.ndarray, x: np.ndarray) -> float:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ b
    return float(r @ r)


def granger_test(y: np.ndarray, x: np.ndarray, max_lag: int = 5, alpha: float = 0.05) -> tuple[bool, float, int]:
    """(causal, least p-value, its lag): does the past of x improve the regression of y on its own past?"""
    ok = ~(np.isnan(y) | np.isnan(x))
    y, x = y[ok], x[ok]
    best = (1.0, -1)
    if len(y) >= max(15, 3 * max_lag) and np.ptp(x) > 0 and np.ptp(y) > 0:
        for k in range(1, max_lag + 1):
            n = len(y) - k
            own = np.column_stack([np.ones(n)] + [y[k - j : len(y) - j] for j in range(1, k + 1)])
            both = np.column_stack([own] + [x[k - j : len(x) - j] for j in range(1, k + 1)])
            full = _ssr(y[k:], both)
            if full > 0:
                p = chi2_sf(n * (_ssr(y[k:], own) - full) / full, k)
                if p < best[0]:
                    best = (p, k)
    return best[0] < alpha, best[0], best[1]


def granger(df: DataFrame, features: Sequence[str], target: str, max_lag: int = 5, alpha: float = 0.05) -> DataFrame:
    """(symbol, feature, causal, min_pval, best_lag) for all symbols and features at once; a group is one symbol's rows."""
    x = df.select("symbol", "date", F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double") for f in features])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["_y"].to_numpy(float)
        return pd.DataFrame([(*key, f, *granger_test(y, pdf[f].to_numpy(float), max_lag, alpha)) for f in features], columns=["symbol", "feature", "causal", "min_pval", "best_lag"])

    return x.groupBy("symbol").applyInPandas(run, "symbol string, feature string, causal boolean, min_pval double, best_lag int")


def lagged_moments(df: DataFrame, columns: Sequence[str], lags: int) -> tuple[int, np.ndarray, list[tuple[str, int]]]:
    """(rows, covariance, (column, lag) of its rows): one distributed pass over lag-stacked, complete rows.

    Only the matrix of sums, of a size set by the number of columns and lags, reaches the driver.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    names = [(c, k) for k in range(lags + 1) for c in columns]
    x = df.select(*[F.lag(F.col(c).cast("double"), k).over(w).alias(f"{c}__{k}") for c, k in names]).dropna()
    size = len(names)

    def sums(batches):
        n, s, g = 0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            m = b.to_numpy(float)
            n, s, g = n + len(m), s + m.sum(0), g + m.T @ m
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    parts = x.mapInPandas(sums, "n long, s array<double>, g array<double>").select("n", F.posexplode(F.concat("s", "g")).alias("i", "v"))
    got = parts.groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()  # size + size^2 rows
    n = int(got[0].n) if got else 0
    v = np.array([r.v for r in got])
    s, g = v[:size], v[size:].reshape(size, size)
    return n, (g - np.outer(s, s) / max(n, 1)) / max(n - 1, 1), names


def _partial(cov: np.ndarray, i: int, j: int, z: list[int], n: int) -> tuple[float, float]:
    idx = [i, j, *z]
    p = np.linalg.pinv(cov[np.ix_(idx, idx)])
    r = float(np.clip(-p[0, 1] / math.sqrt(abs(p[0, 0] * p[1, 1])) if p[0, 0] * p[1, 1] else 0.0, -1 + 1e-15, 1 - 1e-15))
    dof = n - 2 - len(z)
    return r, t_two_sided(r * math.sqrt(max(dof, 0) / (1 - r * r)), dof)


def pcmci(df: DataFrame, columns: Sequence[str], tau_min: int = 1, tau_max: int = 3, pc_alpha: float = 0.10, test: str = "ParCorr", max_conditions: int | None = None, targets: Sequence[str] | None = None, sample_rows: int = SAMPLE_ROWS, shuffles: int = SHUFFLES) -> list[tuple[str, str, int, float, float]]:
    """(source, target, lag, p-value, partial correlation) of every lagged pair, or of those into `targets`.

    Parents of each variable are found by conditioning on the strongest others, on one more at a time until there are no
    more (or max_conditions); each link is then tested given the parents of both ends. With partial correlation (ParCorr)
    both stages need only the covariance of the lagged columns. GPDC and CMIknn (ml.independence) compare all pairs of
    rows, so they work on a hashed sample of about sample_rows lag-stacked rows.
    """
    if test in TESTS:
        m, names = lagged_sample(df, columns, 2 * tau_max, sample_rows)
        cov = np.cov(m, rowvar=False) if len(m) > 1 else np.zeros((len(names), len(names)))
        tests = _Rows(m, TESTS[test], shuffles)
        return _links(len(m), cov, names, columns, columns if targets is None else targets, tau_min, tau_max, pc_alpha, max_conditions, tests)
    if test != "ParCorr":
        raise ValueError(f"unsupported test {test}")
    n, cov, names = lagged_moments(df, columns, 2 * tau_max)
    return _links(n, cov, names, columns, columns if targets is None else targets, tau_min, tau_max, pc_alpha, max_conditions)


def pcmci_by_symbol(df: DataFrame, columns: Sequence[str], target: str, alpha: float = 0.01, tau_min: int = 1, tau_max: int = 3, pc_alpha: float = 0.10, max_conditions: int | None = None) -> DataFrame:
    """(symbol, feature, causal, pval, val, best_lag) as links_into, from each symbol's own rows. Complete rows count;
    a symbol with fewer than three of them has no links."""
    x = df.select("symbol", "date", *[F.col(c).cast("double") for c in columns])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values("date")[list(columns)].to_numpy(float)
        lags, out = 2 * tau_max, []
        z = np.column_stack([m[lags - k : len(m) - k] for k in range(lags + 1)]) if len(m) > lags else np.zeros((0, 1))
        z = z[~np.isnan(z).any(axis=1)]
        if len(z) >= 3:
            names = [(c, k) for k in range(lags + 1) for c in columns]
            best = {}
            for c, _, k, p, r in _links(len(z), np.cov(z, rowvar=False), names, columns, [target], tau_min, tau_max, pc_alpha, max_conditions):
                best[c] = min(best.get(c, (2.0, 0, 0.0)), (p, k, r))
            out = [(*key, c, p < alpha, p, r, k) for c, (p, k, r) in best.items() if c != target]
        return pd.DataFrame(out, columns=["symbol", "feature", "causal", "pval", "val", "best_lag"])

    return x.groupBy("symbol").applyInPandas(run, "symbol string, feature string, causal boolean, pval double, val double, best_lag int")


def _given(cov: np.ndarray, j: int, cand: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Partial correlations of j with all of cand given z: one residual covariance for all."""
    a = np.append(cand, j)
    s = cov[np.ix_(a, a)]
    if len(z):
        c = cov[np.ix_(a, z)]
        s = s - c @ np.linalg.pinv(cov[np.ix_(z, z)], hermitian=True) @ c.T
    d = np.maximum(np.diag(s), 0)
    # what is left of a column that the conditions determine is rounding
    ok = (d[:-1] > 1e-12 * np.diag(cov)[cand]) & (d[-1] > 1e-12 * cov[j, j])
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(ok, s[:-1, -1] / np.sqrt(d[:-1] * d[-1]), 0.0)
    return np.clip(r, -1 + 1e-15, 1 - 1e-15)


def _p_value(r: float, n: int, conditions: int) -> float:
    dof = n - 2 - conditions
    return t_two_sided(r * math.sqrt(max(dof, 0) / (1 - r * r)), dof)


class _Rows:
    """A test of rows in the place of the covariance: strengths are its statistic."""

    def __init__(self, m: np.ndarray, test, shuffles: int):
        self.m, self.test, self.shuffles = m, test, shuffles

    def __call__(self, i: int, j: int, z: np.ndarray) -> tuple[float, float]:
        return self.test(self.m[:, i], self.m[:, j], self.m[:, z], shuffles=self.shuffles)


def lagged_sample(df: DataFrame, columns: Sequence[str], lags: int, rows: int) -> tuple[np.ndarray, list[tuple[str, int]]]:
    """(rows, (column, lag) of its columns): about `rows` complete lag-stacked rows, chosen by hash."""
    w = Window.partitionBy("symbol").orderBy("date")
    names = [(c, k) for k in range(lags + 1) for c in columns]
    x = df.select("symbol", "date", *[F.lag(F.col(c).cast("double"), k).over(w).alias(f"{c}__{k}") for c, k in names]).dropna()
    got = bounded(x, ("symbol", "date"), rows).drop("symbol", "date").collect()  # bounded by `rows`
    return np.array([list(r) for r in got], float).reshape(-1, len(names)), names


def _parents_by_rows(test: _Rows, at, t, columns, tau_min, tau_max, pc_alpha, most) -> list[tuple[str, int]]:
    cand, j, d = [(c, k) for k in range(tau_min, tau_max + 1) for c in columns], at[t, 0], 0
    strength = dict.fromkeys(cand, math.inf)
    while most is None or d <= most:
        cand.sort(key=lambda q: (-strength[q], q))
        keep = []
        for q in cand:
            v, p = test(at[q], j, np.array([at[o] for o in cand if o != q][:d], int))
            strength[q] = min(strength[q], v)
            if p <= pc_alpha:
                keep.append(q)
        cand = keep
        if len(cand) <= d:
            break
        d += 1
    return cand


def _parents(n, cov, at, t, columns, tau_min, tau_max, pc_alpha, most) -> list[tuple[str, int]]:
    """The lagged columns that stay dependent on t given ever more of the strongest others, until there are no more."""
    cand = [(c, k) for k in range(tau_min, tau_max + 1) for c in columns]
    j = at[t, 0]
    strength = dict(zip(cand, np.abs(_given(cov, j, np.array([at[q] for q in cand]), np.empty(0, int))), strict=True))
    d = 0
    while most is None or d <= most:
        cand.sort(key=lambda q: (-strength[q], q))
        idx = np.array([at[q] for q in cand])
        # all others share the first d as conditions; each of the first d has the d others of the first d + 1
        r = np.empty(len(cand))
        r[d:] = _given(cov, j, idx[d:], idx[:d])
        for i in range(min(d, len(cand))):
            r[i] = _given(cov, j, idx[i : i + 1], np.delete(idx[: d + 1], i))[0]
        used = min(d, len(cand) - 1)
        keep = []
        for q, v in zip(cand, r.tolist(), strict=True):
            strength[q] = min(strength[q], abs(v))
            if _p_value(v, n, used) <= pc_alpha:
                keep.append(q)
        cand = keep
        if len(cand) <= d or n - 3 - d <= 0:
            break
        d += 1
    return cand


def _links(n, cov, names, columns, targets, tau_min, tau_max, pc_alpha, max_conditions, test: _Rows | None = None) -> list[tuple[str, str, int, float, float]]:
    at = {k: i for i, k in enumerate(names)}
    if test is None:
        parents = {t: _parents(n, cov, at, t, columns, tau_min, tau_max, pc_alpha, max_conditions) for t in columns}
    else:
        parents = {t: _parents_by_rows(test, at, t, columns, tau_min, tau_max, pc_alpha, max_conditions) for t in columns}
    out = []
    for t in targets:
        for c in columns:
            for k in range(tau_min, tau_max + 1):
                z = [at[o] for o in parents[t] if o != (c, k)] + [at[o, j + k] for o, j in parents[c] if j + k <= 2 * tau_max]
                z = np.array(list(dict.fromkeys(i for i in z if i not in (at[c, k], at[t, 0]))), int)
                if test is None:
                    r = float(_given(cov, at[t, 0], np.array([at[c, k]]), z)[0])
                    out.append((c, t, k, _p_value(r, n, len(z)), r))
                else:
                    v, p = test(at[c, k], at[t, 0], z)
                    out.append((c, t, k, p, v))
    return out


def links_into(df: DataFrame, links: list[tuple], target: str, alpha: float = 0.01) -> DataFrame:
    """(feature, causal, pval, val, best_lag): of each feature the lag with the least p-value."""
    t = df.sparkSession.createDataFrame([x for x in links if x[1] == target and x[0] != target], "feature string, dst string, lag int, pval double, val double")
    b = t.groupBy("feature").agg(F.min(F.struct("pval", "lag", "val")).alias("b"))
    return b.select("feature", (F.col("b.pval") < alpha).alias("causal"), F.col("b.pval").alias("pval"), F.col("b.val").alias("val"), F.col("b.lag").alias("best_lag"))


def graph_matrix(df: DataFrame, links: list[tuple]) -> DataFrame:
    """Sources by targets: the least p-value over the lags."""
    t = df.sparkSession.createDataFrame(links, "src string, dst string, lag int, pval double, val double")
    return t.groupBy("src").pivot("dst", sorted({x[1] for x in links})).agg(F.min("pval"))


def select_features(g: DataFrame, p: DataFrame, strategy: str = "intersection", most: int = 15) -> DataFrame:
    """Both tests joined, features by strategy, least conditional p-value first, capped at `most` (a top-k report).

    If both tests are by symbol, so are the selection and its cap.
    """
    by = ["symbol"] if "symbol" in g.columns else []
    x = g.select(*by, "feature", F.col("causal").alias("granger_causal"), F.round("min_pval", 4).alias("granger_pval")).join(p.select(*by, "feature", F.col("causal").alias("pcmci_causal"), F.round("pval", 4).alias("pcmci_pval"), F.col("best_lag").alias("pcmci_lag"), F.round("val", 4).alias("pcmci_val")), [*by, "feature"], "full")
    x = x.fillna({"granger_causal": False, "granger_pval": 1.0, "pcmci_causal": False, "pcmci_pval": 1.0, "pcmci_lag": -1, "pcmci_val": 0.0})
    chosen = F.col("granger_causal") & F.col("pcmci_causal") if strategy == "intersection" else F.col("granger_causal") | F.col("pcmci_causal")
    if by:
        rank = F.row_number().over(Window.partitionBy("symbol").orderBy("pcmci_pval", "feature"))
        return x.filter(chosen).withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")
    return x.filter(chosen).orderBy("pcmci_pval", "feature").limit(most)


def selection_record(selected: DataFrame, ticker: str, strategy: str, least: int = 3) -> DataFrame:
    """One JSON-ready row; raises with fewer than `least` features."""
    r = selected.agg(F.count("*").alias("n_features"), F.sort_array(F.collect_list(F.struct("pcmci_pval", F.col("feature").alias("name"), "granger_causal", "granger_pval", "pcmci_causal", "pcmci_lag"))).alias("features"))
    n = r.first().n_features
    if n < least:
        raise ValueError(f"{n} causal features; at least {least} are needed")
    return r.select(F.lit(ticker).alias("ticker"), F.lit(strategy).alias("strategy"), "n_features", "features")


def save_selection(record: DataFrame, path: str) -> None:
    """A selection_record as JSON."""
    record.write.mode("overwrite").json(path)


def load_selection(spark, path: str) -> DataFrame:
    """The records saved under a path; raises if there are none."""
    schema = "ticker string, strategy string, n_features long, features array<struct<pcmci_pval:double,name:string,granger_causal:boolean,granger_pval:double,pcmci_causal:boolean,pcmci_lag:long>>"
    return spark.read.schema(schema).json(path)


def load_features(spark, path: str, ticker: str) -> list[str]:
    """The names selected for a ticker, best first: a list capped by the selection."""
    r = load_selection(spark, path).filter(F.col("ticker") == ticker).first()
    if r is None:
        raise ValueError(f"no selection for {ticker}")
    return [f.name for f in r.features]
