"""Global order without a single-task window.

A window without partition keys sends every row to one task.  These operators
range-partition by the order instead, number the rows inside each partition
and add the number of rows in the partitions before it; only one count per
partition reaches the driver.  :class:`Ordered` carries lags and running totals
over the same partitions: what a partition needs from those before it is one
boundary row or one sum, so nothing is shuffled or joined again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

_BITS = 33
#: partitions whose offsets are inlined
MAX_INLINE = 256
#: rows of one block in prefix sums
BLOCK = 1 << 16


class Ordered:
    """Rows in a global order: one range shuffle, written once, then passes over its partitions.

    ``order`` must be total for a stable result.  An empty table stays empty.
    """

    def __init__(self, df: DataFrame, *order: Column | str):
        cols = [F.col(o) if isinstance(o, str) else o for o in order]
        # the range boundaries are sampled anew in each run, so positions are fixed by writing them once
        self.frame = cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id()))
        self.counts = self._each(F.count("*"))

    def _each(self, value: Column) -> dict:
        """One aggregate of every partition that has rows, in order."""
        rows = self.frame.groupBy(F.shiftright("__at", _BITS).alias("p")).agg(value.alias("v")).collect()
        return {r["p"]: r["v"] for r in sorted(rows, key=lambda r: r["p"])}

    def ordinal(self, name: str = "ordinal", start: int = 1) -> Ordered:
        """Add the position of each row."""
        before, offsets = 0, []
        for p, n in self.counts.items():
            offsets.append((p, before))
            before += n
        part = F.shiftright("__at", _BITS)
        inside = F.col("__at").bitwiseAND((1 << _BITS) - 1)
        if len(offsets) > MAX_INLINE:  # one row per partition: a table is cheaper to plan than a literal map
            shifts = self.frame.sparkSession.createDataFrame(offsets, "__p bigint, __o bigint")
            placed = self.frame.withColumn("__p", part).join(F.broadcast(shifts), "__p").withColumn(name, (inside + F.col("__o") + start).cast("bigint"))
            self.frame = placed.drop("__p", "__o")
        elif not offsets:
            self.frame = self.frame.withColumn(name, F.lit(start).cast("bigint"))
        else:
            shift = F.create_map(*[F.lit(x) for pair in offsets for x in pair])[part]
            self.frame = self.frame.withColumn(name, (inside + shift + start).cast("bigint"))
        return self

    def _pass(self, step: Callable, fields: list[T.StructField]) -> None:
        """``step(partition)`` gives a function from an Arrow batch to the new columns, called batch by batch in order."""
        import pyarrow as pa

        def run(batches):
            state = None
            for batch in batches:
                if batch.num_rows:
                    if state is None:
                        state = step(batch.column(batch.schema.get_field_index("__at"))[0].as_py() >> _BITS)
                    yield pa.RecordBatch.from_arrays([*batch.columns, *state(batch)], names=names)

        schema = T.StructType([*self.frame.schema.fields, *fields])
        names = schema.names
        self.frame = self.frame.mapInArrow(run, schema)

    def lag(self, columns: Mapping[str, str], by: int = 1) -> Ordered:
        """Add the values ``by`` rows earlier (source to new name) and ``has_previous``.

        The last ``by`` rows of each partition reach the driver.
        """
        import pyarrow as pa

        sources = list(columns)
        sizes = self.frame.sparkSession.createDataFrame(list(self.counts.items()), "__p bigint, __n bigint")
        ends = (
            self.frame.select("__at", *sources, F.shiftright("__at", _BITS).alias("__p"))
            .join(F.broadcast(sizes), "__p")
            .where(F.col("__at").bitwiseAND((1 << _BITS) - 1) >= F.col("__n") - by)
            .select("__at", *sources)
            .toArrow()
            .sort_by("__at")
        )
        parts = [x >> _BITS for x in ends.column("__at").to_pylist()]
        # rows before each partition: the last ``by`` of all ends that precede it
        first = {p: i for i, p in reversed(list(enumerate(parts)))}
        carried = {p: ends.slice(max(i - by, 0), min(by, i)).select(sources).combine_chunks() for p, i in first.items()}

        def step(part: int) -> Callable:
            held = carried[part]
            lacking = by - held.num_rows
            tails = [pa.concat_arrays([pa.nulls(lacking, c.type), *c.chunks]) for c in held.columns]
            flags = pa.array([False] * lacking + [True] * held.num_rows)

            def new(batch):
                nonlocal tails, flags
                n = batch.num_rows
                whole = [pa.concat_arrays([t.cast(c.type), c]) for t, c in zip(tails, (batch.column(batch.schema.get_field_index(s)) for s in sources))]
                known = pa.concat_arrays([flags, pa.array([True] * n)])
                tails, flags = [w.slice(n) for w in whole], known.slice(n)
                return [*(w.slice(0, n) for w in whole), known.slice(0, n)]

            return new

        fields = [T.StructField(columns[s], self.frame.schema[s].dataType) for s in sources]
        self._pass(step, [*fields, T.StructField("has_previous", T.BooleanType())])
        return self

    def total(self, name: str, value: Column) -> Ordered:
        """Add the running sum of an integer or floating value; missing values add nothing.  One sum of each partition reaches the driver."""
        import pyarrow.compute as pc

        kind = self.frame.select(F.sum(value).alias("v")).schema["v"].dataType
        if not isinstance(kind, (T.LongType, T.DoubleType)):
            raise TypeError("running totals are kept of integer and floating values")
        self.frame = self.frame.withColumn("__v", F.coalesce(value.cast(kind), F.lit(0).cast(kind)))
        before, starts = 0, {}
        for p, v in self._each(F.sum("__v")).items():
            starts[p] = before
            before += v

        def step(part: int) -> Callable:
            reached = starts[part]

            def new(batch):
                nonlocal reached
                sums = pc.cumulative_sum(batch.column(batch.schema.get_field_index("__v")), start=reached)
                reached = sums[-1].as_py()
                return [sums]

            return new

        self._pass(step, [T.StructField(name, kind)])
        self.frame = self.frame.drop("__v")
        return self

    def rows(self) -> DataFrame:
        return self.frame.drop("__at")


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal", start: int = 1) -> DataFrame:
    """``df`` with the global position of each row in ``order`` (a total order for a stable result)."""
    return Ordered(df, *order).ordinal(name, start).rows()


def lagged(df: DataFrame, columns: dict[str, str], ordinal: str = "ordinal", by: int = 1) -> DataFrame:
    """``df`` (with an ordinal) joined with the values ``by`` rows earlier: ``columns`` maps source to new name."""
    back = df.select((F.col(ordinal) + by).alias(ordinal), *[F.col(c).alias(n) for c, n in columns.items()], F.lit(True).alias("__has"))
    return df.join(back, ordinal, "left").withColumn("has_previous", F.coalesce("__has", F.lit(False))).drop("__has")


def running_total(df: DataFrame, value: Column, ordinal: str = "ordinal", name: str = "total") -> DataFrame:
    """Prefix sums over the ordinal in two levels: inside blocks of rows, then over block totals."""
    block = F.expr(f"({ordinal} - 1) div {BLOCK}")
    d = df.withColumn("__b", block).withColumn("__v", value)
    totals = d.groupBy("__b").agg(F.sum("__v").alias("__t"))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__a", F.coalesce(F.sum("__t").over(ahead), F.lit(0))).drop("__t")
    own = Window.partitionBy("__b").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("__s", F.sum("__v").over(own)).join(totals, "__b").withColumn(name, F.coalesce("__s", F.lit(0)) + F.col("__a")).drop("__b", "__v", "__s", "__a")
