"""Facets, statistics and run-length aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import Ordered


def facet_field(df: DataFrame, field: str, valid: Column | None = None) -> DataFrame:
    """(term, frequency); ``valid`` tells which values may become terms."""
    rows = df if valid is None else df.where(valid)
    return rows.groupBy(F.col(field).alias("term")).agg(F.count("*").alias("frequency"))


def facet_queries(df: DataFrame, queries: Mapping[str, Column]) -> DataFrame:
    """(query, n): one pass over the rows for all queries."""
    row = df.agg(*[F.count_if(q).alias(k) for k, q in queries.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("query"), F.col(f"`{k}`").alias("n")) for k in queries])
    return row.select(F.inline(pairs))


def facet_range(df: DataFrame, value: str, start: float, end: float, gap: float) -> DataFrame:
    """(bucket, n): buckets of width ``gap``, and what lies before and after."""
    v = F.col(value)
    low = F.floor((v - start) / gap) * gap + start
    bucket = F.when(v < start, F.lit("before")).when(v >= end, F.lit("after")).otherwise(low.cast("bigint").cast("string"))
    return df.where(v.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def facet_pivot(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.rollup(a, b).agg(F.count("*").alias("n"))


def grouped_top(df: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group: grouped hits."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def subtags(df: DataFrame, parent: str, child: str, max_tags: int, min_count: int = 1, min_total: int = 1) -> DataFrame:
    """(parent, child, n, total): for each parent the most frequent children, small ones left out."""
    n = df.groupBy(parent, child).agg(F.count("*").alias("n"))
    w = Window.partitionBy(parent)
    ranked = n.withColumn("total", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), child)))
    return ranked.where((F.col("n") >= min_count) & (F.col("total") >= min_total) & (F.col("rank") <= max_tags))


def counter(df: DataFrame, op: str, amount: str) -> DataFrame:
    """Net count of inc / dec events."""
    return df.agg(F.sum(F.when(F.col(op) == "inc", F.col(amount)).when(F.col(op) == "dec", -F.col(amount)).otherwise(0)).alias("value"))


def share_of_total(df: DataFrame, key: str, value: Column, name: str = "share") -> DataFrame:
    """Aggregated values and their share of the whole; the window sees one row per key."""
    g = df.groupBy(key).agg(value.alias("value"))
    total = g.select(F.sum("value").alias("t")).scalar()
    return g.withColumn(name, F.try_divide(F.col("value").cast("double"), total.cast("double")))


def runs(df: DataFrame, key: str, order: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregate consecutive rows with an equal key (NULL equals NULL)."""
    change = (~F.col("has_previous") | ~F.col(key).eqNullSafe(F.col("__k"))).cast("bigint")
    d = Ordered(df, order).lag({key: "__k"}).total("run", change).rows()
    return d.groupBy("run", key).agg(*aggs)


def frequent_values(df: DataFrame, c: str, k: int, order: str) -> DataFrame:
    """Rows whose value is among the ``k`` most frequent; missing values stay, ties go to the value seen first."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n"), F.min(order).alias("__o"))
    top = counts.orderBy(F.desc("__n"), "__o").limit(k).select(c)
    return df.where(F.col(c).isNull()).unionByName(df.join(top, c, "left_semi").select(df.columns))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, cumulative): counts of equal-width bins 1..bins; values outside the range are left out."""
    v = F.col(value)
    at = F.least(F.floor((v - low) * bins / (high - low)) + 1, F.lit(bins)).cast("int")
    h = df.where((v >= low) & (v <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("cumulative", F.sum("n").over(Window.orderBy("bin")))


def coverage(df: DataFrame, start: str, end: str) -> DataFrame:
    """(begin, depth): depth of half-open ranges by a sweep over their ends, aggregated per position first."""
    ends = df.select(F.explode(F.array(F.struct(F.col(start).alias("begin"), F.lit(1).alias("d")), F.struct(F.col(end).alias("begin"), F.lit(-1).alias("d")))).alias("e"))
    points = ends.groupBy("e.begin").agg(F.sum("e.d").alias("d"))
    return Ordered(points, "begin").total("depth", F.col("d")).rows().select("begin", "depth")


def weighted_mode(df: DataFrame, keys: Sequence[str], symbol: str, weight: str) -> DataFrame:
    """Consensus: the symbol with the largest summed weight per key, ties to the smaller one."""
    g = df.groupBy(*keys, symbol).agg(F.sum(weight).alias("__w"))
    return g.groupBy(*keys).agg(F.min_by(symbol, F.struct((-F.col("__w")).alias("w"), symbol)).alias("consensus"), F.max("__w").alias("weight"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def mean_until(value: str, sentinel: int) -> Column:
    """Average of the values that are not the sentinel."""
    return F.avg(F.when(F.col(value) != sentinel, F.col(value)))


def property_tree(df: DataFrame, name: str) -> DataFrame:
    """(prefix, depth, n): number of dotted names below each prefix."""
    parts = F.split(F.col(name), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), ".").alias("prefix"), i.alias("depth")))
    return df.where(F.col(name).isNotNull()).select(F.inline(prefixes)).groupBy("prefix", "depth").agg(F.count("*").alias("n"))


def significance(df: DataFrame, score: Column, reference: DataFrame, reference_score: Column, matched: Column, width: float) -> DataFrame:
    """``df`` with ``significance``: the share of reference scores in the score's bin that were matches, 0 where there is none.

    The reference is reduced to one row per bin before it meets the scores; a
    missing score has significance 0.
    """
    bins = reference.groupBy(F.floor(reference_score / width).alias("__bin")).agg(F.avg(matched.cast("double")).alias("__p"))
    d = df.withColumn("__bin", F.floor(score / width)).join(bins.where("__bin IS NOT NULL"), "__bin", "left")
    return d.withColumn("significance", F.coalesce("__p", F.lit(0.0))).drop("__bin", "__p")


def lag_correlation(df: DataFrame, key: str, t: str | Sequence[str], a: str, b: str, lag: int) -> DataFrame:
    """(key, r, n): correlation per key of series ``a`` with series ``b`` shifted by ``lag``; NULL where one does not vary."""
    w = Window.partitionBy(key).orderBy(*([t] if isinstance(t, str) else t))
    x = F.when(F.col("__b").isNotNull(), F.col(a))
    spread = F.stddev_samp(x) * F.stddev_samp("__b")
    r = F.try_divide(F.covar_samp(x, "__b"), F.nullif(spread, F.lit(0.0)))
    return df.withColumn("__b", F.lag(b, lag).over(w)).groupBy(key).agg(r.alias("r"), F.count("__b").alias("n"))


def gram_counts(df: DataFrame, key: str, text: str, n: int = 1) -> DataFrame:
    """(key, gram, n): character n-grams of each text, summed map-side."""
    t = F.col(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))
    return df.where(F.length(t) >= n).select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def cross_entropy(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, entropy): bits per gram of each left text under each right profile, add-one smoothed.

    ``right`` are the gram counts of a few profiles (authors, languages); a
    gram a profile lacks is met by its total, so left grams meet profiles by an
    equi-join on the gram and one on the profile, never by all pairs of texts.
    """
    total = right.groupBy(right_key).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    size = left.groupBy(left_key).agg(F.sum("n").alias("size"))
    # bits of a gram the profile lacks, for every gram; then the correction for those it has
    base = F.log2((F.col("total") + F.col("kinds") + 1).cast("double"))
    shared = left.withColumnRenamed("n", "ln").join(right.withColumnRenamed("n", "rn"), "gram")
    known = shared.groupBy(left_key, right_key).agg(F.sum(F.col("ln") * F.log2((F.col("rn") + 1).cast("double"))).alias("saved"))
    return (
        known.join(total, right_key)
        .join(size, left_key)
        .select(left_key, right_key, (base - F.col("saved") / F.col("size")).alias("entropy"))
    )


def history(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, history): the values of each key in order, NULL where none was ever set.

    The result holds a key's whole history in one value, which is the feature;
    use windows where a key may have more rows than a value can hold.
    """
    h = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("__h"))
    return df.select(key).distinct().join(h, key, "left").select(key, F.transform("__h", lambda x: x[value]).alias("history"))
