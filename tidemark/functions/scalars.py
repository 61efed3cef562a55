"""Scalar expressions with the panel's rules for missing and infinite values."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounded c; null stays null (least and greatest alone would skip it)."""
    c = _c(c)
    x = c if lo is None else F.greatest(c, F.lit(lo))
    x = x if hi is None else F.least(x, F.lit(hi))
    return F.when(c.isNotNull(), x)


def flag(condition: Column) -> Column:
    """1.0 or 0.0; a condition on nulls is 0.0."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def dead_band(c, at: float) -> Column:
    """1, -1, or 0 within the band."""
    return F.when(_c(c) > at, 1.0).when(_c(c) < -at, -1.0).otherwise(0.0)


def finite(c) -> Column:
    """Null for NaN and the infinities."""
    c = _c(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(c) -> Column:
    """A number from text; null where it is none."""
    return finite(_c(c).try_cast("double"))


def safe_filename(c) -> Column:
    return F.translate(F.replace(_c(c), F.lit("^"), F.lit("")), "=-.", "___")


def day_first_date(c) -> Column:
    return F.coalesce(F.try_to_date(_c(c), "d-M-yyyy"), F.try_to_date(_c(c), "d-M-yy"))


def confidence(accuracy) -> Column:
    """A directional accuracy mapped to .3 .. .9 by a logistic curve."""
    return clip(0.3 + 0.6 / (1 + F.exp(-2 * (_c(accuracy) - 0.5))), 0.3, 0.9)


def interpolate(x, x0, y0, x1, y1) -> Column:
    """The line through two points at x, held at the ends."""
    x, x0, y0, x1, y1 = map(_c, (x, x0, y0, x1, y1))
    return F.when(x <= x0, y0).when(x >= x1, y1).otherwise(y0 + (y1 - y0) * F.try_divide(x - x0, x1 - x0))


def surprise(actual, estimate, given=None) -> Column:
    """Surprise in percent of the estimate, where none is given."""
    own = F.try_divide(_c(actual) - _c(estimate), F.abs(_c(estimate))) * 100
    return own if given is None else F.coalesce(finite(given), own)


def substitute_env(text: str) -> str:
    """${NAME} replaced by the environment, by nothing if unset."""
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), text)
