"""Row-framed window functions over a panel with one row per symbol and day.

Frames count rows, not days. A rolling value exists from `least` non-null values on (default: a full window). As a
panel has one row per symbol and day, a symbol's window is bounded by its calendar however many raw rows it has.
Missing is NULL; NaN must be turned to NULL before.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANNUAL = 252.0


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by():
    return Window.partitionBy("symbol").orderBy("date")


def up():
    return by().rowsBetween(Window.unboundedPreceding, 0)


def frame(k: int):
    return by().rowsBetween(-(k - 1), 0)


def lag(c, k: int = 1) -> Column:
    return F.lag(_c(c), k).over(by()) if k >= 0 else F.lead(_c(c), -k).over(by())


def diff(c, k: int = 1) -> Column:
    return _c(c) - lag(c, k)


def pct_change(c, k: int = 1) -> Column:
    return F.try_divide(_c(c), lag(c, k)) - 1


def log_return(c, k: int = 1) -> Column:
    return F.ln(F.try_divide(_c(c), lag(c, k)))


def _rolling(f, c, k: int, least: int | None) -> Column:
    c, w = _c(c), frame(k)
    return F.when(F.count(c).over(w) >= (k if least is None else least), f(c).over(w))


def roll_mean(c, k: int, least: int | None = None) -> Column:
    return _rolling(F.avg, c, k, least)


def roll_sum(c, k: int, least: int | None = None) -> Column:
    return _rolling(F.sum, c, k, least)


def roll_std(c, k: int, least: int | None = None) -> Column:
    return _rolling(F.stddev_samp, c, k, max(2, k if least is None else least))


def roll_var(c, k: int) -> Column:
    return _rolling(F.var_samp, c, k, max(2, k))


def roll_cov(x, y, k: int) -> Column:
    both = F.when(_c(x).isNotNull() & _c(y).isNotNull(), 1)
    return F.when(F.count(both).over(frame(k)) >= k, F.covar_samp(_c(x), _c(y)).over(frame(k)))


def roll_beta(x, y, k: int) -> Column:
    """Covariance of x and y over the variance of y; null where y does not vary."""
    return F.try_divide(roll_cov(x, y, k), F.nullif(roll_var(y, k), F.lit(0.0)))


def roll_slope(c, k: int) -> Column:
    """Least-squares slope of c over the positions of the window (needs with_position)."""
    return F.when(F.count(_c(c)).over(frame(k)) >= k, F.regr_slope(_c(c), F.col("_pos")).over(frame(k)))


def with_position(df: DataFrame) -> DataFrame:
    """Adds _pos, the row's number within its symbol, which roll_slope needs."""
    return df.withColumn("_pos", F.row_number().over(by()).cast("double"))


def roll_rank(c, k: int, least: int | None = None) -> Column:
    """Percentile rank of the newest value within the window; ties share their mean rank.

    An expression, at the cost of a list of k values a row; by_symbol has it for whole frames.
    """
    c = _c(c)
    h = F.collect_list(c).over(frame(k))
    below, same = F.size(F.filter(h, lambda v: v < c)), F.size(F.filter(h, lambda v: v == c))
    return F.when(c.isNotNull() & (F.size(h) >= (k if least is None else least)), (below + (same + 1) / 2) / F.size(h))


def fill_forward(c, limit: int | None = None) -> Column:
    return F.last(_c(c), True).over(up() if limit is None else by().rowsBetween(-limit, 0))


def fill_backward(c) -> Column:
    return F.first(_c(c), True).over(by().rowsBetween(0, Window.unboundedFollowing))


def cum_sum(c) -> Column:
    return F.when(_c(c).isNotNull(), F.sum(_c(c)).over(up()))


def cum_growth(r) -> Column:
    """Running product of 1 + r. A factor of zero or less is carried by its sign and its zeros, apart from its size."""
    f = 1 + _c(r)
    size = F.exp(F.sum(F.when(f != 0, F.ln(F.abs(f))).otherwise(0.0)).over(up()))
    sign = F.when(F.sum((f < 0).cast("int")).over(up()) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.sum((f == 0).cast("int")).over(up()) > 0, F.lit(0.0)).otherwise(size * sign)


def cum_max(c) -> Column:
    return F.max(_c(c)).over(up())


def quantile_bins(c, q: int, over) -> Column:
    """Equal-frequency bins of the ordinal rank of c (edges interpolated, right-closed)."""
    rk, n = F.row_number().over(over.orderBy(c, "date")), F.count(F.lit(1)).over(over)
    return F.when(n > 1, F.least(F.lit(q - 1), F.greatest(F.lit(0), F.ceil((rk - 1) * q / (n - 1)) - 1))).otherwise(0).cast("int")


def sequences(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """Adds `sequence`, the k rows before each row as an array of feature arrays; rows with fewer are dropped."""
    return df.withColumn("sequence", F.collect_list(F.array(*[F.col(c).cast("float") for c in columns])).over(by().rowsBetween(-k, -1))).filter(F.size("sequence") == k)


def by_symbol(df: DataFrame, ewms: Iterable[tuple] = (), ranks: Iterable[tuple[str, str, int, int]] = (), order: str = "date") -> DataFrame:
    """Adds recurrences that window expressions lack, all in one Arrow pass over each symbol's rows.

    ewms: (new column, column, alpha, least values), exponentially weighted means in the recursive form. The first value
    seeds the mean; it appears once `least` values were seen; a null leaves a gap, and the weight of the past decays over
    it. A pair of columns in place of one is their difference, and may name new columns before it.
    ranks: (new column, column, rows, least values), the percentile rank of the newest value within a window, as
    roll_rank, by a sorted window that is kept from row to row.
    A group is one symbol's calendar.
    """
    ewms, ranks = [(n, c, float(a), int(m)) for n, c, a, m in ewms], [(n, c, int(k), int(m)) for n, c, k, m in ranks]
    new = [n for n, *_ in (*ewms, *ranks)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` double" for n in new])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        got: dict[str, pd.Series] = {}

        def column(c) -> pd.Series:
            if isinstance(c, tuple):
                return column(c[0]) - column(c[1])
            return got[c] if c in got else pd.Series(pdf[c].to_numpy("float64", na_value=np.nan), index=pdf.index)

        for n, c, alpha, least in ewms:
            got[n] = column(c).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        for n, c, k, least in ranks:
            got[n] = column(c).rolling(k, min_periods=least).rank(pct=True)
        missing = {n: v.astype(object).where(v.notna(), None) for n, v in got.items()}
        return pdf.assign(**missing)

    return df.groupBy("symbol").applyInPandas(run, schema)


def ewm(df: DataFrame, specs: Iterable[tuple], order: str = "date") -> DataFrame:
    """by_symbol with exponentially weighted means only."""
    return by_symbol(df, specs, order=order)
