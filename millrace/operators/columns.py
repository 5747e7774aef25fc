"""Column preparation of a relation.

Statistics of whole columns are scalar subqueries: one aggregate, planned once
and inlined as a value, instead of a window that gathers every row.  Missing
values are NULL (NaN is read as missing) and are skipped by statistics.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .ordinal import with_ordinal


def clean(c: Column | str) -> Column:
    """NaN as NULL."""
    return F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))


def stat(df: DataFrame, agg: Column) -> Column:
    """A scalar subquery of one aggregate over ``df``."""
    return df.select(agg.alias("v")).scalar()


#: bins of one counting pass, and values that are fetched at once when only so many are left
QUANTILE_BINS = 4096
QUANTILE_VALUES = 200_000


def quantiles(df: DataFrame, c: str, shares: Sequence[float]) -> list[float | None]:
    """Exact interpolated quantiles by counting: nothing is sorted, shuffled or written.

    A pass counts the values in bins between the least and the greatest; only
    the bins that hold a wanted rank go on, each between its own least and
    greatest value, until few values are left or all are equal.  Infinite
    values have their places at the ends.  An empty column has NULL quantiles.
    """
    values = df.select(clean(c).cast("double").alias("v")).where("v IS NOT NULL")
    inf = float("inf")
    finite = F.when(F.abs(F.col("v")) != inf, F.col("v"))
    row = values.agg(F.count("*").alias("n"), F.count_if(F.col("v") == -inf).alias("low"), F.count_if(F.col("v") == inf).alias("high"), F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
    n = row["n"]
    if not n:
        return [None for _ in shares]
    places = [(n - 1) * s for s in shares]
    wanted = {int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places}
    at = {r: -inf if r < row["low"] else inf for r in wanted if r < row["low"] or r >= n - row["high"]}
    if len(at) < len(wanted):
        at |= _ranks(values, row["lo"], row["hi"], row["low"], sorted(wanted - set(at)))
    between = lambda x, y, f: x if x == y else x + (y - x) * f
    return [between(at[int(p)], at[min(int(p) + 1, n - 1)], p - int(p)) for p in places]


def _ranks(values: DataFrame, lo: float, hi: float, before: int, ranks: Sequence[int]) -> dict[int, float]:
    """The values at global ``ranks``, which all lie in ``[lo, hi]``; ``before`` values are smaller than ``lo``."""
    import numpy as np

    if lo == hi:
        return dict.fromkeys(ranks, lo)
    # halves, so that the width of the whole range of doubles is still a number
    share = (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
    number = F.least(F.floor(share * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1))
    inside = values.where(F.col("v").between(lo, hi))
    bins = sorted(inside.groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["b"])
    out: dict[int, float] = {}
    small, left = [], list(ranks)
    for r in bins:
        own = [k for k in left if k < before + r["n"]]
        left = left[len(own) :]
        if own and r["lo"] == r["hi"]:
            out |= dict.fromkeys(own, r["lo"])
        elif own and sum(x["n"] for x, _, _ in small) + r["n"] <= QUANTILE_VALUES:
            small.append((r, before, own))
        elif own:
            out |= _ranks(values, r["lo"], r["hi"], before, own)
        before += r["n"]
    if small:
        spans = [F.col("v").between(r["lo"], r["hi"]) for r, _, _ in small]
        found = values.where(reduce(lambda x, y: x | y, spans)).toArrow().column("v").to_numpy()
        for r, first, own in small:
            part = np.sort(found[(found >= r["lo"]) & (found <= r["hi"])])
            out |= {k: float(part[k - first]) for k in own}
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def center(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clean(c) - stat(df, F.avg(clean(c))) for c in cols})


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean and unit sample deviation; a constant column becomes NULL."""
    return df.withColumns(
        {c: F.try_divide(clean(c) - stat(df, F.avg(clean(c))), F.nullif(stat(df, F.stddev_samp(clean(c))), F.lit(0.0))) for c in cols}
    )


def normalize(df: DataFrame, cols: Sequence[str], scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    """To ``[shift, shift + scale]``; a constant column becomes ``shift``."""
    out = {}
    for c in cols:
        lo, hi = stat(df, F.min(clean(c))), stat(df, F.max(clean(c)))
        out[c] = F.when(hi > lo, (clean(c) - lo) / (hi - lo) * scale + shift).when(clean(c).isNotNull(), F.lit(float(shift)))
    return df.withColumns(out)


def math_expression(df: DataFrame, cols: Sequence[str], fn: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``fn(A, MIN, MAX)`` of each column."""
    return df.withColumns({c: fn(clean(c), stat(df, F.min(clean(c))), stat(df, F.max(clean(c)))) for c in cols})


def numeric_transform(df: DataFrame, fn: Callable[[Column], Column], cols: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in (cols or numeric_columns(df))})


def row_normalize(df: DataFrame, cols: Sequence[str], norm: float = 1.0) -> DataFrame:
    """L2 norm of the row set to ``norm``; any missing value makes all of them missing, a zero row stays."""
    total = sum((clean(c) * clean(c) for c in cols), F.lit(0.0))
    return df.withColumns({c: F.when(total == 0, clean(c)).otherwise(F.try_divide(clean(c) * norm, F.sqrt(total))) for c in cols})


def mode_value(df: DataFrame, c: str, domain: Sequence | None = None) -> Column:
    """The most frequent value; ties go to the level declared first, or the smallest."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n"))
    rank = F.array_position(F.array(*[F.lit(x) for x in domain]), F.col("__v")) if domain else F.col("__v")
    return counts.select(F.min_by("__v", F.struct((-F.col("__n")).alias("n"), rank.alias("r"))).alias("v")).scalar()


def replace_missing(df: DataFrame, numeric: Sequence[str] = (), nominal: Sequence[str] = (), domains: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Mean for numeric columns, mode for nominal ones; text columns stay."""
    out = {c: F.coalesce(clean(c), stat(df, F.avg(clean(c)))) for c in numeric}
    out |= {c: F.coalesce(F.col(c), mode_value(df, c, (domains or {}).get(c))) for c in nominal}
    return df.withColumns(out)


def replace_missing_with(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(clean(c) if isinstance(v, float) else F.col(c), F.lit(v)) for c, v in values.items()})


def numeric_clean(c: str, low: float, low_default: float, high: float, high_default: float, close_to: float | None = None, close_default: float = 0.0, tolerance: float = 1e-6) -> Column:
    v = clean(c)
    out = F.when(v < low, F.lit(low_default)).when(v > high, F.lit(high_default))
    if close_to is not None:
        out = out.when(F.abs(v - close_to) <= tolerance, F.lit(close_default))
    return out.otherwise(v)


def numeric_to_binary(c: str) -> Column:
    return F.when(clean(c).isNull(), None).when(clean(c) != 0, 1).otherwise(0)


def indicator(c: str, value) -> Column:
    return F.when(F.col(c).isNull(), None).otherwise((F.col(c) == F.lit(value)).cast("int"))


def one_hot(c: str, domain: Sequence[str]) -> dict[str, Column]:
    return {f"{c}={v}": indicator(c, v) for v in domain}


def ordered_binary(c: str, domain: Sequence[str]) -> dict[str, Column]:
    """Binary columns ``c=b,c`` for ordered levels: at or above each level but the first."""
    return {f"{c}={','.join(domain[i:])}": F.when(F.col(c).isNull(), None).otherwise(F.col(c).isin(*domain[i:]).cast("int")) for i in range(1, len(domain))}


def merge_levels(c: str, levels: Sequence[str], label: str | None = None) -> Column:
    return F.when(F.col(c).isin(*levels), F.lit(label or "_".join(levels))).otherwise(F.col(c))


def swap_levels(c: str, a: str, b: str) -> Column:
    return F.when(F.col(c) == a, F.lit(b)).when(F.col(c) == b, F.lit(a)).otherwise(F.col(c))


def domain(df: DataFrame, c: str, ignore_case: bool = False, added: Sequence = ()) -> DataFrame:
    """(level, n, code): distinct values and their sorted 1-based code, numbered without one task for all levels.

    ``added`` are levels the domain has besides those that occur (n is 0).
    """
    levels = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("level")).agg(F.count("*").alias("n"))
    if added:
        more = df.sparkSession.createDataFrame([(x, 0) for x in added], levels.schema)
        levels = levels.unionByName(more).groupBy("level").agg(F.sum("n").alias("n"))
    order = [F.lower("level"), F.col("level")] if ignore_case else ["level"]
    return with_ordinal(levels, *order, name="code").withColumn("code", F.col("code").cast("int"))


def class_order(df: DataFrame, c: str) -> DataFrame:
    """Levels by ascending frequency, ties by name."""
    levels = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("level")).agg(F.count("*").alias("n"))
    return with_ordinal(levels, "n", "level", name="position").withColumn("position", F.col("position").cast("int"))


def first_seen_code(df: DataFrame, c: str, order: str, name: str = "code") -> DataFrame:
    """1-based code of each value in order of first appearance."""
    seen = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias("__o"))
    seen = with_ordinal(seen, "__o", c, name=name).withColumn(name, F.col(name).cast("int")).drop("__o")
    return df.join(seen, c, "left")


def first_order(df: DataFrame, cols: Sequence[str], prefix: str = "diff") -> DataFrame:
    """Differences of neighbouring columns of a row."""
    return df.withColumns({f"{prefix}{i}": clean(b) - clean(a) for i, (a, b) in enumerate(zip(cols, cols[1:]), 1)})


def iqr_flags(df: DataFrame, cols: Sequence[str], outlier: float = 3.0, extreme: float = 6.0) -> DataFrame:
    """Outlier and ExtremeValue: some column beyond the quartiles by so many interquartile ranges."""
    out, ext = F.lit(False), F.lit(False)
    for c in cols:
        q1, q3 = (F.lit(q).cast("double") for q in quantiles(df, c, [0.25, 0.75]))
        iqr, v = q3 - q1, clean(c)
        far = lambda k, v=v, q1=q1, q3=q3, iqr=iqr: F.coalesce((v > q3 + iqr * k) | (v < q1 - iqr * k), F.lit(False))
        ext = ext | far(extreme)
        out = out | (far(outlier) & ~far(extreme))
    return df.withColumns({"outlier": out.cast("int"), "extreme": ext.cast("int")})


def discretize(df: DataFrame, c: str, bins: int | None = None, name: str = "bin") -> DataFrame:
    """Equal-frequency bins of rank order; ``bins`` defaults to the square root of the row count."""
    n = df.where(clean(c).isNotNull()).count() if bins is None else 0
    k = bins or max(1, int(round(n**0.5)))
    cuts = F.array(*[F.lit(q) for q in quantiles(df, c, [i / k for i in range(1, k)]) if q is not None]).cast("array<double>")
    return df.withColumn(name, F.when(clean(c).isNull(), None).otherwise(F.size(F.filter(cuts, lambda x: x < clean(c))) + 1))


def equal_width(df: DataFrame, c: str, bins: int, name: str = "bin") -> DataFrame:
    lo, hi = stat(df, F.min(clean(c))), stat(df, F.max(clean(c)))
    at = F.floor(F.try_divide((clean(c) - lo) * bins, hi - lo)) + 1
    return df.withColumn(name, F.when(clean(c).isNull(), None).otherwise(F.least(F.coalesce(at, F.lit(1)), F.lit(bins)).cast("int")))


#: distinct values up to which the table of counts of an entropy split is handled on the driver
MDL_CELLS = 100_000


def mdl_cuts(df: DataFrame, c: str, label: str) -> list[float]:
    """Cut points of the entropy split with the minimum description length stop, exact at any size.

    Class counts are aggregated per distinct value.  Up to MDL_CELLS values the
    table of counts is split on the driver; a longer one keeps running counts
    per class in order of the value, and each split is one aggregate over it.
    """
    known = df.where(clean(c).isNotNull() & F.col(label).isNotNull()).select(clean(c).cast("double").alias("v"), F.col(label).cast("string").alias("l"))
    labels = sorted(r["l"] for r in known.select("l").distinct().collect())
    if not labels:
        return []
    table = known.groupBy("v").agg(*[F.count_if(F.col("l") == x).alias(f"n{i}") for i, x in enumerate(labels)])
    rows = table.limit(MDL_CELLS + 1).collect()
    if len(rows) <= MDL_CELLS:
        find, ends, total = _local_boundaries(sorted(tuple(r) for r in rows), len(labels))
    else:
        find, ends, total = _stored_boundaries(table, len(labels))

    def split(lo: int, hi: int, counts: list[int], base: list[int]) -> list[float]:
        """Cuts between the values lo..hi, whose classes count ``counts`` behind ``base``."""
        best = find(lo, hi, counts, base) if lo < hi else None
        if best is None:
            return []
        at, middle, left = best
        right = [x - y for x, y in zip(counts, left)]
        n = sum(counts)
        gain = _entropy(counts) - (sum(left) * _entropy(left) + sum(right) * _entropy(right)) / n
        k, k1, k2 = (sum(x > 0 for x in t) for t in (counts, left, right))
        delta = math.log2(3**k - 2) - (k * _entropy(counts) - k1 * _entropy(left) - k2 * _entropy(right))
        if gain <= (math.log2(max(n - 1, 1)) + delta) / n:
            return []
        return [*split(lo, at, left, base), middle, *split(at + 1, hi, right, [x + y for x, y in zip(base, left)])]

    return split(*ends, total, [0] * len(labels))


def _entropy(counts: Sequence[int]) -> float:
    n = sum(counts)
    return -sum(x / n * math.log2(x / n) for x in counts if x) if n else 0.0


def _local_boundaries(rows: list[tuple], k: int):
    """The best boundary inside a stretch of the sorted rows (value, counts...): (last position, middle, counts before it)."""

    def find(lo, hi, counts, base):
        left, best, n = [0] * k, None, sum(counts)
        for i in range(lo, hi):
            left = [x + y for x, y in zip(left, rows[i][1:])]
            right = [x - y for x, y in zip(counts, left)]
            e = round((sum(left) * _entropy(left) + sum(right) * _entropy(right)) / n, 12)
            if best is None or e < best[0]:
                best = (e, i, left)
        return best and (best[1], (rows[best[1]][0] + rows[best[1] + 1][0]) / 2, best[2])

    return find, (0, len(rows) - 1), [sum(r[i + 1] for r in rows) for i in range(k)]


def _stored_boundaries(table: DataFrame, k: int):
    """The same over a table of any length: running counts are kept with each value, a boundary is one aggregate."""
    from .ordinal import Ordered

    kept = Ordered(table, "v")
    for i in range(k):
        kept.total(f"s{i}", F.col(f"n{i}"))
    d = cut(kept.ordinal("o", 0).rows())
    size, *total = d.agg(F.count("*"), *[F.sum(f"n{i}") for i in range(k)]).first()

    def weighted(parts: list[Column]) -> Column:
        n = sum(parts[1:], parts[0])
        logs = [F.when(x > 0, x * F.log2(n / x)).otherwise(0.0) for x in parts]
        return sum(logs[1:], logs[0])

    def find(lo, hi, counts, base):
        left = [F.col(f"s{i}") - F.lit(base[i]) for i in range(k)]
        right = [F.lit(counts[i]) - x for i, x in enumerate(left)]
        e = F.round((weighted(left) + weighted(right)) / float(sum(counts)), 12)
        best = d.where(F.col("o").between(lo, hi - 1)).agg(F.min_by(F.struct("o", "v", *[x.alias(f"l{i}") for i, x in enumerate(left)]), F.struct(e.alias("e"), "o")).alias("b")).first()["b"]
        following = d.where(F.col("o") == best["o"] + 1).first()["v"]
        return best["o"], (best["v"] + following) / 2, [best[f"l{i}"] for i in range(k)]

    return find, (0, size - 1), total


def drop_useless(df: DataFrame, max_share: float = 0.99) -> DataFrame:
    """Without constant columns and text columns of which more than ``max_share`` are distinct."""
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    row = df.agg(F.count("*").alias("__n"), *[F.approx_count_distinct(c, 0.01).alias(c) for c in cols], *[F.count(c).alias(f"__c_{c}") for c in cols]).first()
    drop = []
    for c in cols:
        distinct, n = row[c], row[f"__c_{c}"]
        if distinct <= 1 and n == row["__n"] or isinstance(df.schema[c].dataType, T.StringType) and n and distinct > max_share * n:
            drop.append(c)
    return df.drop(*drop)


def remove_by_name(df: DataFrame, pattern: str) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in df.columns if not re.fullmatch(pattern, c)])


def remove_by_type(df: DataFrame, *kinds: str) -> DataFrame:
    return df.select([f.name for f in df.schema.fields if f.dataType.simpleString() not in kinds])


def remove_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Without the columns first..last (1-based, inclusive)."""
    return df.select([c for i, c in enumerate(df.columns, 1) if not first <= i <= last])


def reorder(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    return df.select([df.columns[i - 1] for i in positions])


def rename_by_regex(df: DataFrame, find: str, replace: str) -> DataFrame:
    return df.toDF(*[re.sub(find, replace, c) for c in df.columns])


def random_subset(df: DataFrame, share: float, seed: int) -> DataFrame:
    import random

    k = max(1, round(len(df.columns) * share))
    keep = set(random.Random(seed).sample(df.columns, k))
    return df.select([c for c in df.columns if c in keep])


def with_class(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.col(c).alias(c, metadata={"class": True}))


def obfuscate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Neutral names for columns and sorted ``V1``.. for the levels of ``cols``."""
    for i, c in enumerate(cols, 1):
        codes = domain(df, c).select(F.col("level").alias(c), F.concat(F.lit("V"), "code").alias("__v"))
        df = df.join(F.broadcast(codes) if codes.count() <= 10_000 else codes, c, "left").withColumn(c, F.col("__v")).drop("__v").withColumnRenamed(c, f"A{i}")
    return df


def add_noise(df: DataFrame, c: str, percent: float, levels: Sequence[str], seed: int) -> DataFrame:
    other = F.element_at(F.array(*[F.lit(x) for x in levels]), (F.floor(F.rand(seed + 1) * len(levels)) + 1).cast("int"))
    return df.withColumn(c, F.when(F.rand(seed) < percent / 100.0, other).otherwise(F.col(c)))


def to_sparse(df: DataFrame, cols: Sequence[str], name: str = "sparse") -> DataFrame:
    """Map of the 0-based positions of the values that are not zero."""
    entries = F.array(*[F.struct(F.lit(i).alias("k"), clean(c).alias("v")) for i, c in enumerate(cols)])
    return df.withColumn(name, F.map_from_entries(F.filter(entries, lambda e: e["v"].isNull() | (e["v"] != 0))))


def from_sparse(df: DataFrame, c: str, names: Sequence[str]) -> DataFrame:
    """Columns of a sparse map: an absent position is zero, a NULL value stays missing."""
    return df.withColumns({n: F.when(F.map_contains_key(c, F.lit(i)), F.col(c)[i]).otherwise(F.lit(0.0)) for i, n in enumerate(names)})


def haar(arr: Column) -> Column:
    """One level of the Haar wavelet of an array padded with a zero to even length."""
    padded = F.when(F.size(arr) % 2 == 1, F.concat(arr, F.array(F.lit(0.0)))).otherwise(arr)
    half = (F.size(padded) / 2).cast("int")
    pair = lambda sign: F.when(half > 0, F.transform(F.sequence(F.lit(1), F.greatest(half, F.lit(1))), lambda i: (padded[2 * i - 2] + sign * padded[2 * i - 1]) / F.sqrt(F.lit(2.0)))).otherwise(F.array().cast("array<double>"))
    return F.concat(pair(1), pair(-1))


def chain(df: DataFrame, *filters: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for f in filters:
        df = df.transform(f)
    return df
