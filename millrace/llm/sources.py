"""Access to the source-file table shared by the operators on code."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def extension(path: Column | str) -> Column:
    """Lower-case text after the last dot of the file name (`''` without one)."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1))


#: bytes of a scan (as the planner estimates them) that one task of a lexer should take at most
TASK_BYTES = 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, and no partition far beyond TASK_BYTES.

    A scan has as many tasks as its files have splits; the lexers cost far more
    than the scan, so a few large splits are dealt out by a unique key.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = cores if size >= 1 << 55 else max(cores, -(-size // TASK_BYTES))  # beyond that the planner knows no size
    parts = df.rdd.getNumPartitions()
    return df.repartition(wanted, key) if parts < cores or 2 * parts < wanted else df


def with_ext(files: DataFrame, exts: tuple[str, ...], content: str = "content") -> DataFrame:
    """Rows with content whose path ends in one of ``exts``; only the needed columns are read."""
    rows = (
        files.where(F.col(content).isNotNull())
        .select("file_id", extension("path").alias("ext"), F.col(content).alias("content"))
        .where(F.col("ext").isin(*exts))
    )
    return spread(rows, "file_id")


def without_blocks(text: str, names: tuple[str, ...]) -> str:
    """``text`` with a blank for each marked-up block ``<name ...> ... </name>``.

    Only what stands before the last closing tag is searched, so openings that
    are never closed cost nothing.
    """
    for name in names:
        closing = [m.end() for m in re.finditer(rf"(?i)</{name}\s*>", text)]
        if closing:
            text = re.sub(rf"(?is)<{name}\b[^<>]*>.*?</{name}\s*>", " ", text[: closing[-1]]) + text[closing[-1] :]
    return text


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` where ``fn`` takes and returns a dict of column lists (one Arrow batch at a time)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, st)
