"""Readers for record formats; each returns a DataFrame planned on Spark's own sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the batches in which the records of a file are passed on.
BATCH_BYTES = 4_000_000


# -------------------------------------------------------------- JSON, CSV
def json_arrays(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON arrays as records; a schema saves the inference pass."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(paths)


def json_splits(spark: SparkSession, paths: Sequence[str], schema=None, level: int = -1) -> DataFrame:
    """Records with the split they came from: the part of their file's path at ``level``, -1 being the file name."""
    return json_arrays(spark, paths, schema).withColumn("split", F.element_at(F.split(F.input_file_name(), "/"), level))


def delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema=None) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def delimited_map(lines: DataFrame, names: Sequence[str], sep: str = ",", column: str = "value") -> DataFrame:
    """Each line as a map of name to field; missing fields are absent."""
    parts = F.split(F.col(column), re.escape(sep))
    keys = F.slice(F.array(*[F.lit(n) for n in names]), 1, F.least(F.size(parts), F.lit(len(names))))
    return lines.select(F.map_from_arrays(keys, F.slice(parts, F.lit(1), F.size(keys))).alias("record"))


def jdbc(spark: SparkSession, url: str, query: str, fetch: int = 10_000, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A SQL source; ``partition`` is (column, low, high, parts) and makes the read parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch).options(**options)
    if partition:
        c, lo, hi, n = partition
        return reader.options(partitionColumn=c, lowerBound=lo, upperBound=hi, numPartitions=n).option("dbtable", f"({query}) q").load()
    return reader.option("query", query).load()


def shards(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Union of the same table in several stores, each row marked with its shard."""
    from ..operators.rows import union_all

    return union_all([spark.read.parquet(p).withColumn("shard", F.lit(name)) for name, p in folders.items()])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([]))


def with_labels(spark: SparkSession, labels: Sequence[str], rows: Sequence[Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], T.StructType([T.StructField(n, T.StringType()) for n in labels]))


# -------------------------------------------------------------------- ARFF
_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", re.I)


def arff_header(lines: Sequence[str]) -> list[tuple[str, str, list[str]]]:
    """(name, kind, domain) of the declared attributes; the domain of a date is its format."""
    out = []
    for line in lines:
        m = _ATTRIBUTE.match(line.strip())
        if not m:
            continue
        name, kind = m.group(1).strip("'\""), m.group(2).strip()
        if kind.startswith("{"):
            out.append((name, "nominal", [v.strip().strip("'\"") for v in kind.strip("{}").split(",")]))
        elif kind.lower().startswith("date"):
            fmt = kind[4:].strip().strip("'\"") or "yyyy-MM-dd'T'HH:mm:ss"
            out.append((name, "date", [fmt]))
        else:
            out.append((name, "numeric" if kind.lower() in ("numeric", "real", "integer") else "string", []))
    return out


def arff(spark: SparkSession, path: str) -> DataFrame:
    """A declared relation: dense rows ``a,b,?`` and sparse rows ``{i v, ...}``.

    In a sparse row an omitted number is 0, an omitted nominal value the first
    declared level, an omitted date the epoch; ``?`` is missing.  ``ord`` is
    the 1-based row number.  The header is read on the driver (it precedes
    @data); the rows are not.
    """
    text = spark.read.text(path)
    head = text.where(F.lower(F.trim("value")).startswith("@attribute")).collect()
    attributes = arff_header([r["value"] for r in head])
    line = F.trim("value")
    data = text.withColumn("at", F.monotonically_increasing_id()).where((F.length(line) > 0) & ~line.startswith("@") & ~line.startswith("%"))
    sparse = line.startswith("{")
    dense_parts = F.transform(F.split(line, r",(?=(?:[^']*'[^']*')*[^']*$)"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")))
    pairs = F.transform(F.split(F.regexp_replace(line, r"^\{\s*|\s*\}$", ""), r"\s*,\s*"), lambda p: F.split(p, r"\s+", 2))
    pairs = F.filter(pairs, lambda p: F.size(p) == 2)
    entries = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0].cast("int").alias("k"), F.regexp_replace(p[1], r"^['\"]|['\"]$", "").alias("v"))))
    rows = data.select("at", F.when(sparse, entries).alias("s"), F.when(~sparse, dense_parts).alias("d"))
    cols = []
    for i, (name, kind, dom) in enumerate(attributes):
        default = {"numeric": "0", "nominal": dom[0] if dom else None, "date": None, "string": None}[kind]
        raw = F.when(F.col("d").isNotNull(), F.try_element_at("d", F.lit(i + 1))).when(F.map_contains_key("s", F.lit(i)), F.col("s")[i]).otherwise(F.lit(default))
        value = F.when(raw == "?", None).otherwise(raw)
        if kind == "numeric":
            value = value.try_cast("double")
        elif kind == "date":
            parsed = F.try_to_timestamp(value, F.lit(dom[0]))
            omitted = F.col("s").isNotNull() & ~F.map_contains_key("s", F.lit(i))
            value = F.when(omitted, F.timestamp_seconds(F.lit(0))).otherwise(parsed)
        cols.append(value.alias(name, metadata={"kind": kind, "domain": dom}))
    from ..operators.ordinal import with_ordinal

    out = with_ordinal(rows, "at", name="ord")
    return out.select("ord", *cols)


# ---------------------------------------------------------------- INI, text
def ini(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """(section, key, value) of ``key=value`` lines below their section; malformed lines are skipped."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^\s*\[([^\]]*)\]", 1)
    rows = text.withColumn("section", F.last(F.when(F.col("line").rlike(r"^\s*\["), F.lower(head)), ignorenulls=True).over(w))
    rows = rows.where(F.col("line").rlike(r"^\s*[^\[;#=][^=]*=")).select(
        "section", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.regexp_replace("line", "^[^=]*=", "")).alias("value")
    )
    return rows if section is None else rows.where(F.col("section") == section.lower())


def fixed_records(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(file, n, record): binary files cut into records of a fixed length; a rest that is too short is kept.

    A file is cut in one pass over Arrow's own buffer: in SQL every substring
    first copies the whole content, which is the square of a file's size.
    """
    step = max(1, min(10_000, BATCH_BYTES // length))

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                data = content.as_buffer()
                count = -(-data.size // length)
                for first in range(0, count, step):
                    n = np.arange(first, min(first + step, count), dtype=np.int32)
                    part = data.slice(first * length, min(len(n) * length, data.size - first * length))
                    ends = np.minimum(np.arange(len(n) + 1, dtype=np.int64) * length, part.size).astype(np.int32)
                    records = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), part])
                    yield pa.RecordBatch.from_arrays([pa.repeat(file, len(n)), pa.array(n), records], ["file", "n", "record"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInArrow(cut, "file string, n int, record binary")


# --------------------------------------------------------- FASTQ, FASTA
def fastq(spark: SparkSession, path: str, offset: int = 33) -> DataFrame:
    """(id, comment, bases, qualities): four-line and multi-line records.

    Records start at an ``@`` after as many qualities as bases, which only a
    pass in order can tell; each file is one pass, files run in parallel.
    """
    schema = "id string, comment string, bases string, qualities array<int>"

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                lines = text.splitlines()
                i = 0
                while i < len(lines):
                    if not lines[i].startswith("@"):
                        i += 1
                        continue
                    name = lines[i][1:].split(None, 1)
                    i += 1
                    bases = ""
                    while i < len(lines) and not lines[i].startswith("+"):
                        bases += lines[i].strip()
                        i += 1
                    i += 1
                    quals = ""
                    while i < len(lines) and len(quals) < len(bases):
                        quals += lines[i].strip()
                        i += 1
                    if len(quals) == len(bases):
                        rows.append((name[0] if name else "", name[1] if len(name) > 1 else None, bases, [ord(c) - offset for c in quals]))
            yield pd.DataFrame(rows, columns=["id", "comment", "bases", "qualities"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, schema)


# ----------------------------------------------------------- HL7, library
def hl7(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, segment, field, rep, component, value) of pipe-delimited messages."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n?|\n")).alias("n", "line"))
    fields = text.where(F.length("line") > 3).select("file", "n", F.split_part("line", F.lit("|"), F.lit(1)).alias("segment"), F.posexplode(F.split("line", r"\|")).alias("field", "raw"))
    fields = fields.where((F.col("field") > 0) & (F.length("raw") > 0))
    reps = fields.select("file", "n", "segment", "field", F.posexplode(F.split("raw", "~")).alias("rep", "r"))
    return reps.select("file", "n", "segment", "field", "rep", F.posexplode(F.split("r", r"\^")).alias("component", "value")).where(F.length("value") > 0)


def aleph(spark: SparkSession, path: str) -> DataFrame:
    """(id, tag, ind, subfields, deleted) of library line records ``id tag ind L value``."""
    line = F.col("value")
    parts = F.filter(F.split(F.substring(line, 19, 1_000_000), r"\$\$"), lambda x: F.length(x) > 0)
    sub = F.transform(parts, lambda x: F.struct(F.substring(x, 1, 1).alias("code"), F.substring(x, 2, 1_000_000).alias("text")))
    return spark.read.text(path).where(F.length(line) >= 18).select(
        F.substring(line, 1, 9).alias("id"),
        F.trim(F.substring(line, 11, 3)).alias("tag"),
        F.substring(line, 14, 2).alias("ind"),
        sub.alias("subfields"),
        (F.trim(F.substring(line, 11, 3)) == "DEL").alias("deleted"),
    )


def xml_records(spark: SparkSession, path: str, row_tag: str, schema=None, mode: str = "PERMISSIVE") -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", mode)
    return (reader.schema(schema) if schema is not None else reader).load(path)


# ----------------------------------------------------------------- catalog
def catalog(spark: SparkSession) -> DataFrame:
    """(database, table, column, type, nullable) of everything the session knows."""
    rows = [
        (db.name, tb.name, c.name, c.dataType, c.nullable)
        for db in spark.catalog.listDatabases()
        for tb in spark.catalog.listTables(db.name)
        for c in spark.catalog.listColumns(tb.name if tb.isTemporary else f"{db.name}.{tb.name}")
    ]
    return spark.createDataFrame(rows, "database string, table string, column string, type string, nullable boolean")


def query_rows(spark: SparkSession, sql: str, **args) -> DataFrame:
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def to_array(df: DataFrame, name: str = "row") -> DataFrame:
    """Each row as one array of strings."""
    return df.select(F.array(*[F.col(c).cast("string") for c in df.columns]).alias(name))


def cursor(df: DataFrame):
    """Forward cursor over the rows, a partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


def file_filter(spark: SparkSession, fmt: str, path: str, globs: Sequence[str], schema=None) -> DataFrame:
    """Files whose names pass any of the globs."""
    from ..operators.rows import union_all

    readers = [spark.read.format(fmt).option("pathGlobFilter", g) for g in globs]
    return union_all([(r.schema(schema) if schema is not None else r).load(path) for r in readers])


