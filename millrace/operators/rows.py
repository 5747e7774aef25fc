"""Sorting, paging, sampling, folds and set operations on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import with_ordinal


def order_column(name: str, ascending: bool = True, case_sensitive: bool = True) -> Column:
    c = F.col(name) if case_sensitive else F.lower(F.col(name))
    return c.asc_nulls_first() if ascending else c.desc_nulls_last()


def page(df: DataFrame, order: Sequence[Column], start: int, end: int) -> DataFrame:
    """Rows start..end-1 of the order."""
    return df.orderBy(*order).offset(start).limit(max(end - start, 0))


def page_with_total(df: DataFrame, order: Sequence[Column], start: int, end: int) -> DataFrame:
    total = df.select(F.count("*").alias("n")).scalar()
    return page(df, order, start, end).withColumn("total_size", total)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The page after a key: a filter that reaches the scan instead of an offset."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(size)


def tree_order(parent: str, index: str) -> list[Column]:
    """Parents in order of their index, each followed by its children."""
    return [F.coalesce(F.col(parent), F.col(index)).asc(), F.col(parent).isNotNull().asc(), F.col(index).asc()]


def argsort(arr: str) -> Column:
    """0-based positions of an array in ascending order of the values."""
    pairs = F.transform(F.col(arr), lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def distinct_sorted(df: DataFrame, c: str, order: str, case_sensitive: bool = True) -> DataFrame:
    """Distinct strings; without case the spelling seen last stands for all."""
    if case_sensitive:
        return df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c)
    return df.where(F.col(c).isNotNull()).groupBy(F.lower(c).alias("k")).agg(F.max_by(c, order).alias(c)).orderBy("k").select(c)


def time_of_day(c: str) -> Column:
    """Minutes of ``HH?MM`` read by position."""
    return F.substring(c, 1, 2).try_cast("int") * 60 + F.substring(c, 4, 2).try_cast("int")


def remove_percentage(df: DataFrame, order: str, percent: float) -> DataFrame:
    """Without the first percent of rows, rounded half up."""
    d = with_ordinal(df, order)
    n = d.count()
    return d.where(F.col("ordinal") > int(n * percent / 100 + 0.5)).drop("ordinal")


def remove_rows(df: DataFrame, order: str, first: int, last: int) -> DataFrame:
    return with_ordinal(df, order).where(~F.col("ordinal").between(first, last)).drop("ordinal")


def slices(df: DataFrame, order: str, bounds: Sequence[tuple[int, int | None]]) -> DataFrame:
    """Union of positional slices ``[a, b)``, 0-based; None is the end."""
    d = with_ordinal(df, order, start=0)
    cond = reduce(lambda x, y: x | y, [(F.col("ordinal") >= a) & (F.lit(True) if b is None else F.col("ordinal") < b) for a, b in bounds])
    return d.where(cond).drop("ordinal")


def fold(df: DataFrame, order: str, folds: int, keep: int) -> DataFrame:
    """The rows of one of ``folds`` contiguous folds of nearly equal size, the larger ones first."""
    d = with_ordinal(df, order)
    n = d.count()
    size, more = divmod(n, folds)
    start = (keep - 1) * size + min(keep - 1, more)
    return d.where((F.col("ordinal") > start) & (F.col("ordinal") <= start + size + (keep <= more))).drop("ordinal")


def stratified_fold(df: DataFrame, key: str, cls: str, folds: int, keep: int) -> DataFrame:
    """One fold with each class spread evenly: position inside the class modulo the folds.

    Positions are counted in hash shards of the key so that a frequent class is not one task.
    """
    shard = F.pmod(F.xxhash64(key), F.lit(64))
    d = df.withColumn("__s", shard)
    n = d.groupBy(cls, "__s").agg(F.count("*").alias("__n"))
    n = n.withColumn("__a", F.coalesce(F.sum("__n").over(Window.partitionBy(cls).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumnRenamed(cls, "__c")
    r = d.withColumn("__r", F.row_number().over(Window.partitionBy(cls, "__s").orderBy(key)))
    j = r.join(n.withColumnRenamed("__s", "__t"), F.col(cls).eqNullSafe(F.col("__c")) & (F.col("__s") == F.col("__t")))
    return j.where((F.col("__r") - 1 + F.col("__a")) % folds == keep - 1).select(df.columns)


def class_cap(df: DataFrame, cls: str, order: Sequence[str], cap: int) -> DataFrame:
    """At most ``cap`` rows of each class, the first in order."""
    w = Window.partitionBy(cls).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def hash_split(df: DataFrame, key: str, shares: Mapping[str, float]) -> DataFrame:
    """Column ``split`` by a hash of the key: the same row is always in the same part."""
    u = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) / 1_000_000.0
    out, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        out = F.when(u < upto, F.lit(name)) if out is None else out.when(u < upto, F.lit(name))
    return df.withColumn("split", out)


def reservoir(df: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` rows at random: a top-k of a random number, merged from each partition's own top-k."""
    return df.withColumn("__u", F.rand(seed)).orderBy("__u").limit(k).drop("__u")


def resample(df: DataFrame, share: float, seed: int, replacement: bool = True) -> DataFrame:
    return df.sample(withReplacement=replacement, fraction=share, seed=seed)


def resample_to_uniform(df: DataFrame, cls: str, share: float, bias: float, seed: int) -> DataFrame:
    """A sample with replacement whose class shares move by ``bias`` (0 to 1) from those of the rows to equal ones.

    Each row is repeated a Poisson number of times (normal from a rate of 30
    on); the rates come from one count per class, so rows are never gathered.
    A missing class is a class.
    """
    counts = df.groupBy(cls).agg(F.count("*").alias("__n")).withColumnRenamed(cls, "__c")
    rows, classes = df.select(F.count("*").alias("n")).scalar(), counts.select(F.count("*").alias("k")).scalar()
    rates = counts.select("__c", ((1 - bias) * share + bias * share * rows / (classes * F.col("__n"))).alias("__rate"))
    # a Poisson number by the inverse of its distribution: how many of the cumulated probabilities lie below the draw
    term = F.aggregate(
        F.sequence(F.lit(1), F.lit(160)),
        F.struct(F.lit(0).alias("k"), F.exp(-F.col("__rate")).alias("p"), F.exp(-F.col("__rate")).alias("c")),
        lambda a, i: F.struct((a["k"] + (F.col("__u") > a["c"]).cast("int")).alias("k"), (a["p"] * F.col("__rate") / i).alias("p"), (a["c"] + a["p"] * F.col("__rate") / i).alias("c")),
        lambda a: a["k"],
    )
    large = F.greatest(F.round(F.col("__rate") + F.sqrt("__rate") * F.col("__z")), F.lit(0)).cast("int")
    drawn = df.withColumn("__u", F.rand(seed)).withColumn("__z", F.randn(seed + 1)).join(rates, F.col(cls).eqNullSafe(F.col("__c")))
    drawn = drawn.withColumn("__k", F.when(F.col("__rate") < 30, term).otherwise(large))
    return drawn.where("__k > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__k")))).select(df.columns)


def rank_select(df: DataFrame, score: Column, ties: Sequence[str], draws: int, seed: int) -> DataFrame:
    """``draws`` rows drawn with replacement, the best of n with weight n, the next with n - 1, ... (``rank`` is added).

    The weight of the ranks up to r is a square, so a uniform number gives a
    rank in closed form, and drawn ranks meet rows by an equi-join.
    """
    ranked = with_ordinal(df, score.desc_nulls_last(), *ties, name="rank")
    n = ranked.count()
    if not n:
        return ranked
    u = F.rand(seed) * (n * (n + 1) / 2)
    # from the last rank upwards weights are 1, 2, ...: the first place whose sum exceeds the number
    at = F.least(F.floor((F.sqrt(8 * u + 1) - 1) / 2), F.lit(n - 1))
    drawn = df.sparkSession.range(draws).select((F.lit(n) - at).cast("bigint").alias("rank"))
    return drawn.groupBy("rank").agg(F.count("*").alias("__n")).join(ranked, "rank").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*df.columns, "rank")


def shuffle_rows(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def gaussian(df: DataFrame, mean: float, variance: float, seed: int, name: str = "gauss") -> DataFrame:
    return df.withColumn(name, F.randn(seed) * F.sqrt(F.lit(float(variance))) + mean)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """Nodes reachable from a start over (src, dst): frontier joins until nothing new appears, however long the paths."""
    from ..session import cut

    spark = edges.sparkSession
    seen = spark.createDataFrame([(start,)], edges.select(F.col("src").alias("node")).schema)
    frontier = seen
    while True:
        nxt = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(nxt.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen
