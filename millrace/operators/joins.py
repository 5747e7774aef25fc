"""Joins and lookups beyond the plain equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import great_circle_miles

#: a side with up to this many rows is sent to every task
BROADCAST_ROWS = 200_000
#: cells of one width a range may meet before it is kept in wider ones
RANGE_CELLS = 8


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when a bounded count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """Rows whose key is among the given ones; long lists become a semi join."""
    if len(keys) <= 1000:
        return df.where(F.col(key).isin(*keys))
    wanted = df.sparkSession.createDataFrame([(k,) for k in keys], df.select(key).schema)
    return df.join(small(wanted), key, "left_semi")


def inverted_search(entities: DataFrame, key: str, terms: Column, term: str) -> DataFrame:
    """Entities one of whose terms equals ``term``: explode, filter, distinct keys, semi join."""
    hits = entities.select(key, F.explode(terms).alias("__t")).where(F.col("__t") == term).select(key).distinct()
    return entities.join(hits, key, "left_semi")


def natural_key(*parts: str) -> Column:
    """One string for several parts: the separator is escaped in them and NULL is marked, so no two keys meet in one."""
    return F.concat_ws("|", *[F.coalesce(F.regexp_replace(F.col(p).cast("string"), r"([|\\])", r"\\$1"), F.lit("\\N")) for p in parts])


def merge_keyed(left: DataFrame, right: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Full outer merge in which the right side wins where it has a value."""
    r = right.select(key, *[F.col(v).alias(f"__r_{v}") for v in values])
    return left.join(r, key, "full").select(key, *[F.coalesce(f"__r_{v}", v).alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges ``[low, high]`` that hold them.

    Both sides are cut into cells of ``width``; the join is on the cell, so no
    pair is formed outside a cell.  A range appears in each cell it meets; one
    that is wider than RANGE_CELLS cells is kept in cells twice, four times, ...
    as wide, and points look into the widths that occur (some tens at most).
    A range whose end lies before its start, or with an open end, holds nothing.
    """
    cells = F.greatest((F.col(high) - F.col(low)).cast("double") / width, F.lit(1.0))
    level = F.greatest(F.ceil(F.log2(cells / RANGE_CELLS)), F.lit(0)).cast("int")
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("__level", level)
    levels = sorted(x["__level"] for x in r.select("__level").distinct().collect())
    at = lambda c, n: F.floor(F.col(c).cast("double") / (width * F.pow(F.lit(2.0), n))).cast("bigint")
    r = r.withColumn("__cell", F.explode(F.sequence(at(low, F.col("__level")), at(high, F.col("__level")))))
    p = points.withColumn("__level", F.explode(F.lit(levels).cast("array<int>")))
    p = p.withColumn("__cell", at(value, F.col("__level")))
    return p.join(r, ["__level", "__cell"]).where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("__level", "__cell")


def asof_join(left: DataFrame, right: DataFrame, key: str, t: str, values: Sequence[str], cell: Column | None = None) -> DataFrame:
    """Each left row with the latest right values at or before its time: one union and one window, no pairs.

    A key with very many rows is split by ``cell``, a Column that does not fall
    as the time rises (a day, say): windows run inside (key, cell), and what a
    cell starts with comes from a second window over one row per cell.  Without
    one, times are split by the day and other orders not at all.
    """
    if cell is None and isinstance(left.schema[t].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        cell = F.date_trunc("day", F.col(t))
    kind = [F.lit(None).cast(right.schema[v].dataType).alias(f"__r_{v}") for v in values]
    a = left.select("*", *kind, F.lit(1).alias("__left"))
    b = right.select(key, t, *[F.col(v).alias(f"__r_{v}") for v in values], F.lit(0).alias("__left"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__cell", cell if cell is not None else F.lit(0))
    w = Window.partitionBy(key, "__cell").orderBy(F.col(t), F.col("__left")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("__left") == 0, F.struct(*[F.col(f"__r_{v}").alias(v) for v in values]))
    out = both.withColumn("__v", F.last(seen, ignorenulls=True).over(w))
    if cell is not None:
        ends = both.where("__left = 0").groupBy(F.col(key).alias("__k"), F.col("__cell").alias("__c")).agg(F.max_by(F.struct(*[F.col(f"__r_{v}").alias(v) for v in values]), t).alias("__e"))
        cells = both.select(F.col(key).alias("__k"), F.col("__cell").alias("__c")).distinct()
        ahead = Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
        carried = cells.join(ends, ["__k", "__c"], "left").withColumn("__from", F.last("__e", ignorenulls=True).over(ahead)).drop("__e")
        out = out.join(carried, F.col(key).eqNullSafe(F.col("__k")) & F.col("__cell").eqNullSafe(F.col("__c")), "left").withColumn("__v", F.coalesce("__v", "__from"))
    return out.where("__left = 1").select(*left.columns, *[F.col("__v")[v].alias(v) for v in values])


def near_miles(a: DataFrame, b: DataFrame, miles: float) -> DataFrame:
    """Pairs of places within ``miles``: (id_a, id_b, miles); both sides need id, lat, lon.

    Joined on cells of both axes and their neighbours.  A band of latitude is as
    high as the distance; it is cut around the globe into a whole number of
    cells at least as wide as the distance at the band's edge nearest a pole,
    so partners lie in neighbouring cells, also across the 180th meridian.
    """
    size = max(miles / 69.0, 1e-6)
    band = lambda c: F.floor(F.col(c) / size).cast("bigint")
    # the highest latitude a place of the band or of its neighbours can have, and the longitudes the distance spans there
    edge = F.least(F.greatest(F.abs(F.col("__b") - 1), F.abs(F.col("__b") + 2)) * size, F.lit(90.0))
    ratio = F.sin(F.lit(min(miles / (2 * 3958.0), 1.5))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    span = F.when(ratio < 1, F.degrees(2 * F.asin(ratio))).otherwise(F.lit(360.0))
    count = F.greatest(F.floor(F.lit(360.0) / F.greatest(span, F.lit(1e-9))), F.lit(1)).cast("bigint")
    cell = lambda c: F.least(F.floor(F.pmod(F.col(c).cast("double"), F.lit(360.0)) * F.col("__n") / 360.0).cast("bigint"), F.col("__n") - 1)
    x = a.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a")).withColumn("__b", band("lat_a")).withColumn("__n", count)
    x = x.withColumn("__c", cell("lon_a")).drop("__n")
    y = b.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    y = y.withColumn("__b", F.explode(F.sequence(band("lat_b") - 1, band("lat_b") + 1))).withColumn("__n", count).withColumn("__c", cell("lon_b"))
    y = y.withColumn("__c", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("__c") + k, F.col("__n")) for k in (-1, 0, 1)])))).drop("__n")
    d = great_circle_miles("lat_a", "lon_a", "lat_b", "lon_b")
    return x.join(y, ["__b", "__c"]).withColumn("miles", d).where(F.col("miles") <= miles).select("id_a", "id_b", "miles")


def partners(reads: DataFrame, key: str, place: str, strand: str, least: int, most: int) -> DataFrame:
    """(key, distance): pairs of rows of one key on opposite strands, the distance between them within ``[least, most]``.

    A mate pair has two rows, so the rows of a key are aggregated, not joined;
    a key with another number of rows or with both on one strand is none.
    """
    pair = reads.where(F.col(place).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.countDistinct(strand).alias("strands"), (F.max(place) - F.min(place)).alias("distance")
    )
    return pair.where((F.col("n") == 2) & (F.col("strands") == 2) & F.col("distance").between(least, most)).select(key, "distance")


def first_container(elements: DataFrame, zones: DataFrame, key: str, zone: str, priority: Sequence[str]) -> DataFrame:
    """Each element with the first zone, in fixed priority, that holds it; none gives NULL."""
    rank = F.array_position(F.array(*[F.lit(z) for z in priority]), F.col(zone))
    best = zones.where(rank > 0).groupBy(key).agg(F.min_by(zone, rank).alias("found"))
    return elements.join(best, key, "left")


def implied_foreign_keys(columns: DataFrame) -> DataFrame:
    """(table, column, parent): columns named and typed like the primary key of another table.

    ``columns`` has table, column, type, is_key; joined on name and type.
    """
    keys = columns.where("is_key").select(F.col("table").alias("parent"), "column", "type")
    return columns.join(keys, ["column", "type"]).where(F.col("table") != F.col("parent")).select("table", "column", "parent")


def bidirectional(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(from, to, direction): a mapping usable both ways, the last write winning each way."""
    fwd = df.groupBy(F.col(key).cast("string").alias("from")).agg(F.max_by(F.col(value).cast("string"), order).alias("to"))
    back = df.groupBy(F.col(value).cast("string").alias("from")).agg(F.max_by(F.col(key).cast("string"), order).alias("to"))
    return fwd.withColumn("direction", F.lit("key")).unionByName(back.withColumn("direction", F.lit("value")))
