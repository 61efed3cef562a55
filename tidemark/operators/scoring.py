"""Texts scored by a model in Arrow batches, with the word lists as the way out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lexicon import extended_score

MAX_CHARS = 512


def _windows(length: int) -> list[tuple[int, int]]:
    """(start, characters added) of the windows that cover a text; an empty text has one."""
    if length <= MAX_CHARS:
        return [(0, max(length, 1))]
    full, rest = divmod(length, MAX_CHARS)
    return [(i * MAX_CHARS, MAX_CHARS) for i in range(full)] + ([(length - MAX_CHARS, rest)] if rest else [])


def score_texts(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[float]]] | None = None, batch: int = 32, out: str = "score") -> DataFrame:
    """Adds a score in [-1, 1]. `load` gives a scorer of lists of texts and runs once per Python worker's task.

    Without a scorer the extended word lists are used, inside the JVM. Models see windows of MAX_CHARS characters, the
    length they are made for: a longer text is scored in consecutive windows, the last of which ends with the text, and
    gets their mean, each weighted by the characters it adds. Null texts score 0.
    """
    if load is None:
        return df.withColumn(out, extended_score(text))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            parts = [(k, a, n) for k, t in enumerate(s.fillna("")) for a, n in _windows(len(t))]
            mean, chars = [0.0] * len(s), [0] * len(s)
            texts = s.fillna("").tolist()
            for i in range(0, len(parts), batch):
                some = parts[i : i + batch]
                for (k, _, n), v in zip(some, model([texts[k][a : a + MAX_CHARS] for k, a, _ in some]), strict=True):
                    chars[k] += n
                    mean[k] += (float(v) - mean[k]) * n / chars[k]
            yield pd.Series(mean, dtype="float64")

    return df.withColumn(out, F.when(F.col(text).isNull(), F.lit(0.0)).otherwise(scored(F.col(text))))
