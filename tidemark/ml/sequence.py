"""A recurrent model of the last rows before each row: two layers of long short-term memory and a linear head.

It is fitted on a bounded sample of sequences (`SAMPLE_SEQUENCES`, a parameter) in one task; all rows are scored, in Arrow
batches. Sequences come from windows.sequences, so a row with too few rows before it has none and is left out.

Defined cases: without sequences the model is a constant 0; without validation sequences all epochs are run. Missing
values within a sequence count as 0, the mean of scaled features.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.ml.boosting import bounded

SAMPLE_SEQUENCES = 20_000


@dataclass(frozen=True)
class Settings:
    hidden: int = 64
    dropout: float = 0.2
    epochs: int = 50
    patience: int = 10
    batch: int = 64
    rate: float = 1e-3
    clip: float = 1.0
    seed: int = 42


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _layer(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """(hidden states (T, B, H), what the way back needs) of inputs (T, B, F)."""
    n, size = x.shape[1], len(b) // 4
    h, c, out, kept = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype), [], []
    for xt in x:
        xh = np.concatenate([xt, h], axis=1)
        z = xh @ w + b
        i, f, o = (_sigmoid(z[:, k * size : (k + 1) * size]) for k in range(3))
        g, before = np.tanh(z[:, 3 * size :]), c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out.append(h)
        kept.append((xh, i, f, o, g, before, tc))
    return np.stack(out), kept


def _layer_back(dh: np.ndarray, kept: list, w: np.ndarray, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient by the inputs, by w, by b) from that by the hidden states."""
    dw, db, dx = np.zeros_like(w), np.zeros(w.shape[1], w.dtype), []
    next_h, next_c = np.zeros_like(dh[0]), np.zeros_like(dh[0])
    for t in range(len(kept) - 1, -1, -1):
        xh, i, f, o, g, before, tc = kept[t]
        d = dh[t] + next_h
        dc = d * o * (1 - tc * tc) + next_c
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw += xh.T @ dz
        db += dz.sum(axis=0)
        back = dz @ w.T
        dx.append(back[:, :inputs])
        next_h, next_c = back[:, inputs:], dc * f
    return np.stack(dx[::-1]), dw, db


class Lstm:
    def __init__(self, features: int, s: Settings = Settings()):
        r, k = np.random.default_rng(s.seed), s.hidden
        scale = lambda a, b: (r.uniform(-1, 1, (a, b)) / np.sqrt(k)).astype("float32")
        self.settings, self.features, self.center, self.spread = s, features, 0.0, 1.0
        self.p = [scale(features + k, 4 * k), np.zeros(4 * k, "float32"), scale(2 * k, 4 * k), np.zeros(4 * k, "float32"), scale(k, 1)[:, 0], np.zeros(1, "float32")]
        for b in (self.p[1], self.p[3]):
            b[k : 2 * k] = 1.0  # remember at first

    def _run(self, x: np.ndarray, rng: np.random.Generator | None = None):
        w1, b1, w2, b2, wo, bo = self.p
        h1, k1 = _layer(x.transpose(1, 0, 2), w1, b1)
        keep = 1 - self.settings.dropout
        mask = (rng.random(h1.shape) < keep).astype("float32") / np.float32(keep) if rng is not None and keep < 1 else None
        h2, k2 = _layer(h1 if mask is None else h1 * mask, w2, b2)
        return h2[-1] @ wo + bo[0], (h1, k1, mask, h2, k2)

    def gradients(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, list[np.ndarray]]:
        """(mean squared error, its gradient by each parameter); y is scaled."""
        w1, _, w2, _, wo, _ = self.p
        out, (_, k1, mask, h2, k2) = self._run(x, rng)
        d = (2 / len(y)) * (out - y)
        dh2 = np.zeros_like(h2)
        dh2[-1] = d[:, None] * wo[None]
        dx2, dw2, db2 = _layer_back(dh2, k2, w2, self.settings.hidden)
        _, dw1, db1 = _layer_back(dx2 if mask is None else dx2 * mask, k1, w1, self.features)
        return float(((out - y) ** 2).mean()), [dw1, db1, dw2, db2, h2[-1].T @ d, np.array([d.sum()], "float32")]

    def fit(self, x: np.ndarray, y: np.ndarray, xv: np.ndarray | None = None, yv: np.ndarray | None = None) -> Lstm:
        """Adam on clipped gradients; the epoch of the least validation error is kept."""
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        if not len(x):
            return self
        self.center, self.spread = float(y.mean()), float(y.std()) or 1.0
        y = ((y - self.center) / self.spread).astype("float32")
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        best, best_at, best_p = np.inf, 0, [a.copy() for a in self.p]
        for epoch in range(s.epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), s.batch):
                i = order[k : k + s.batch]
                _, grads = self.gradients(x[i], y[i], rng)
                norm, step = np.sqrt(sum(float((g * g).sum()) for g in grads)), step + 1
                for a, g, m1, v1 in zip(self.p, grads, m, v, strict=True):
                    g = (g * min(1.0, s.clip / (norm + 1e-12))).astype("float32")
                    m1 += 0.1 * (g - m1)
                    v1 += 0.001 * (g * g - v1)
                    a -= (s.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)).astype("float32")
            if xv is not None and len(xv):
                loss = float(((self.predict(xv) - yv) ** 2).mean())
                if loss < best:
                    best, best_at, best_p = loss, epoch, [a.copy() for a in self.p]
                elif epoch - best_at >= s.patience:
                    break
        if best < np.inf:
            self.p = best_p
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = [self._run(x[k : k + 4096])[0] for k in range(0, len(x), 4096)]
        return self.center + self.spread * np.concatenate(parts).astype("float64") if parts else np.zeros(0)

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "settings": self.settings.__dict__, "center": self.center, "spread": self.spread, "p": [a.tolist() for a in self.p]})

    @classmethod
    def from_json(cls, text: str) -> Lstm:
        d = json.loads(text)
        out = cls(d["features"], Settings(**d["settings"]))
        out.center, out.spread, out.p = d["center"], d["spread"], [np.array(a, "float32") for a in d["p"]]
        return out


def _array(c: pd.Series, features: int) -> np.ndarray:
    x = np.array([[list(r) for r in s] for s in c], "float32").reshape(len(c), -1, features)
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def fit_sequences(df: DataFrame, features: int, target: str, validation: str, s: Settings = Settings(), rows: int = SAMPLE_SEQUENCES) -> Lstm:
    """A model of `sequence` (windows.sequences) -> target, fitted in one task; `validation` is a boolean column."""
    x = bounded(df.dropna(subset=[target]), ("symbol", "date"), rows).select("sequence", F.col(target).cast("double").alias("y"), F.col(validation).alias("v"), F.xxhash64("symbol", "date").alias("o"), F.lit(0).alias("one"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        v, m, y = pdf.v.to_numpy(bool), _array(pdf.sequence, features), pdf.y.to_numpy("float64")
        return pd.DataFrame({"model": [Lstm(features, s).fit(m[~v], y[~v], m[v], y[v]).to_json()]})

    got = x.groupBy("one").applyInPandas(run, "model string").collect()  # one row
    return Lstm.from_json(got[0].model) if got else Lstm(features, s)


def score(df: DataFrame, model: Lstm, out: str = "lstm") -> DataFrame:
    """(symbol, date, out) of all rows with a sequence."""
    sent = df.sparkSession.sparkContext.broadcast(model.to_json())  # bounded by the settings

    def go(batches):
        m = Lstm.from_json(sent.value)
        for b in batches:
            yield b[["symbol", "date"]].assign(**{out: m.predict(_array(b.sequence, m.features))})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select("symbol", "date", "sequence").mapInPandas(go, f"symbol {kinds['symbol']}, date {kinds['date']}, `{out}` double")
