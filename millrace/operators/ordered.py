"""Functions of row order: lags, differences, running values, trims."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import Ordered


def series_delta(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), lag: int = 1) -> DataFrame:
    """``value`` minus its value ``lag`` rows earlier; rows without one are dropped.

    With ``by`` the order is inside each key (a window); without, it is global
    (one range shuffle, boundary rows carried from partition to partition).
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("__r", F.row_number().over(w)).withColumn("delta", F.col(value) - F.lag(value, lag).over(w)).where(F.col("__r") > lag).drop("__r")
    d = Ordered(df, *order).lag({value: "__v"}, lag).rows()
    return d.where("has_previous").withColumn("delta", F.col(value) - F.col("__v")).drop("__v", "has_previous")


def series_translate(df: DataFrame, values: Sequence[str], order: Sequence[str], by: Sequence[str] = (), lag: int = 1) -> DataFrame:
    """Columns ``v-lag`` with the values ``lag`` rows earlier; rows without them are dropped."""
    names = {v: f"{v}-{lag}" for v in values}
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        d = df.withColumn("__r", F.row_number().over(w)).withColumns({n: F.lag(v, lag).over(w) for v, n in names.items()})
        return d.where(F.col("__r") > lag).drop("__r")
    return Ordered(df, *order).lag(names, lag).rows().where("has_previous").drop("has_previous")


def second_difference(value: str, w) -> Column:
    return F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)


def running(value: str, w) -> Column:
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))


def quality_trim(qualities: Column, threshold: int) -> Column:
    """(begin, end) of the stretch kept by the running-sum trim of both ends: where ``sum(q - threshold)`` is largest."""
    def best(arr: Column) -> Column:
        # maximum-sum run by one pass: current sum, its start, best sum and its bounds
        zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("b"), F.lit(0).alias("i"), F.lit(0).alias("m"), F.lit(0).alias("mb"), F.lit(-1).alias("me"))

        def step(a: Column, q: Column) -> Column:
            s = a["s"] + q - threshold
            cur = F.greatest(s, F.lit(0))
            start = F.when(s <= 0, a["i"] + 1).otherwise(a["b"])
            better = cur > a["m"]
            return F.struct(
                cur.alias("s"), start.alias("b"), (a["i"] + 1).alias("i"),
                F.greatest(a["m"], cur).alias("m"), F.when(better, start).otherwise(a["mb"]).alias("mb"), F.when(better, a["i"]).otherwise(a["me"]).alias("me"),
            )

        return F.aggregate(arr, zero, step)

    r = best(F.transform(qualities, lambda x: x.cast("int")))
    return F.struct(r["mb"].alias("begin"), r["me"].alias("end"))


def exponential_index(df: DataFrame, key: str, t: str, value: str, alpha: float) -> DataFrame:
    """(key, t, value, smooth): exponential smoothing per series, streamed in order without holding a series."""
    schema = df.select(key, t, value).schema.add("smooth", "double")

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for pdf in batches:
            out = []
            for k, v in zip(pdf[key], pdf[value]):
                prev = state.get(k)
                if pd.isna(v):
                    out.append(prev)
                    continue
                state = {k: v if prev is None else alpha * v + (1 - alpha) * prev}
                out.append(state[k])
            yield pdf.assign(smooth=pd.array(out, dtype="float64"))

    # a key's rows are in one partition and in order, so one pass with one state is enough
    return df.select(key, t, value).repartition(key).sortWithinPartitions(key, t).mapInPandas(smooth, schema)


def natural_spline(x, y, at):
    """Natural cubic spline through (x, y), x rising, at the positions ``at``; straight beyond the ends."""
    import numpy as np

    x, y, at = np.asarray(x, float), np.asarray(y, float), np.asarray(at, float)
    n = len(x)
    if n == 0:
        return np.full(len(at), np.nan)
    if n == 1:
        return np.full(len(at), y[0])
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(n)  # second derivatives: a tridiagonal system, solved by elimination in both directions
    if n > 2:
        diag, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope)
        for i in range(1, n - 2):
            f = h[i] / diag[i - 1]
            diag[i] -= f * h[i]
            right[i] -= f * right[i - 1]
        m[n - 2] = right[-1] / diag[-1]
        for i in range(n - 4, -1, -1):
            m[i + 1] = (right[i] - h[i + 1] * m[i + 2]) / diag[i]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, u = at - x[k], x[k + 1] - at
    inside = (m[k] * u**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t
    first = slope[0] - h[0] * (2 * m[0] + m[1]) / 6
    last = slope[-1] + h[-1] * (m[-2] + 2 * m[-1]) / 6
    return np.where(at < x[0], y[0] + first * (at - x[0]), np.where(at > x[-1], y[-1] + last * (at - x[-1]), inside))


def cubic_spline(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(key, t, value, spline): a natural cubic spline per series through its known values, read at every ``t``.

    The system of a spline couples all knots, so a series is one task's work
    (its positions and values only, 16 bytes a row).  Several values at one
    ``t`` count with their mean; a series without values has none.
    """
    schema = df.select(key, t, value).schema.add("spline", "double")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[[t, value]].dropna().astype(float).groupby(t)[value].mean()
        pdf["spline"] = natural_spline(known.index, known, pdf[t].astype(float))
        return pdf

    return df.select(key, t, value).groupBy(key).applyInPandas(fit, schema)
