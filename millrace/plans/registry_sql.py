"""Named SQL, formatters by type and expression hooks: the extension surface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NamedSql:
    """SQL texts by name, run with named arguments."""

    def __init__(self, texts: dict[str, str]):
        self._texts = dict(texts)

    def get(self, name: str) -> str:
        return self._texts[name]

    def run(self, spark: SparkSession, name: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
        return spark.sql(self._texts[name], args=args, **frames)


class Formatters:
    """Text forms of columns chosen by their type."""

    def __init__(self):
        self._by_type: dict[type, Callable[[Column], Column]] = {}

    def set(self, kind: type[T.DataType], formatter: Callable[[Column], Column]) -> Formatters:
        self._by_type[kind] = formatter
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        out = []
        for f in df.schema.fields:
            fn = next((g for k, g in self._by_type.items() if isinstance(f.dataType, k)), lambda c: c.cast("string"))
            out.append(fn(F.col(f.name)).alias(f.name))
        return df.select(out)


def condition(df: DataFrame, text: str) -> DataFrame:
    """A condition given as a SQL expression; it is parsed, never evaluated as code."""
    return df.where(F.expr(text))


def mapped(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """A row mapper run over Arrow batches."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [fn(r) for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows)

    return df.mapInPandas(run, schema)


def crossover(mom: str, dad: str, mask: str) -> Column:
    """Uniform crossover of two arrays by an array of flags."""
    both = F.arrays_zip(F.col(mom).alias("m"), F.col(dad).alias("d"), F.col(mask).alias("k"))
    return F.transform(both, lambda x: F.when(x["k"], x["m"]).otherwise(x["d"]))
