"""Sinks and exporters."""

from __future__ import annotations

import re
import shutil
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8, not escaped."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)


def export(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """``csv`` or ``xml``; another format is refused."""
    if fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif fmt == "xml":
        df.write.mode(mode).format("xml").option("rowTag", "row").option("rootTag", "rows").save(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")


def sql_literal(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        text = c.cast("string")
    else:
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row."""
    values = F.concat_ws(", ", *[sql_literal(F.col(f.name), f.dataType) for f in df.schema.fields])
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("statement"))


def create_table(df: DataFrame, table: str) -> str:
    """CREATE TABLE statement of a schema."""
    cols = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields)
    return f"CREATE TABLE {table} ({cols})"


def fasta(df: DataFrame, name: str, values: str, width: int = 60) -> DataFrame:
    """(value): a FASTA record per row; arrays are written as blank-separated numbers, text in lines of ``width``."""
    if isinstance(df.schema[values].dataType, T.ArrayType):
        body = F.array_join(F.transform(F.col(values), lambda x: F.lpad(x.cast("string"), 2, "0")), " ")
    else:
        body = F.rtrim(F.regexp_replace(values, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), body).alias("value"))


def merge_update(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, int]:
    """The target with the updated columns, and how many rows an UPDATE would report."""
    u = updates.select(key, *[F.col(c).alias(f"__u_{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = target.join(u, key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    out = joined.withColumns({c: F.when(hit, F.col(f"__u_{c}")).otherwise(F.col(c)) for c in columns}).select(target.columns)
    return out, joined.where(hit).count()


def each_row(df: DataFrame, send: Callable[[dict], None]) -> None:
    """Call ``send`` for every row on the executors, a partition at a time."""

    def run(rows):
        for r in rows:
            send(r.asDict(recursive=True))

    df.foreachPartition(run)


def write_arff(df: DataFrame, path: str, relation: str, order: str, nominal: Sequence[str] = ()) -> None:
    """A declared relation: the header in a file of its own that sorts first, the rows in order of ``order`` (written as ``pos``)."""
    from ..operators.columns import clean, domain

    def quoted(c: Column) -> Column:
        return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("")), F.lit("'"))

    head, values = [f"@relation {relation}", "", "@attribute pos numeric"], [F.col(order).cast("string")]
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name == order:
            continue
        if f.name in nominal:
            levels = [r["level"] for r in domain(df, f.name).orderBy("code").collect()]
            head.append(f"@attribute {f.name} {{{','.join(levels)}}}")
            text = quoted(c)
        elif isinstance(f.dataType, T.NumericType):
            head.append(f"@attribute {f.name} numeric")
            text = clean(f.name).cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            head.append(f"@attribute {f.name} date \"yyyy-MM-dd'T'HH:mm:ss\"")
            text = quoted(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
        else:
            head.append(f"@attribute {f.name} string")
            text = quoted(c)
        values.append(F.coalesce(text, F.lit("?")))
    spark = df.sparkSession
    df.orderBy(order).select(F.concat_ws(",", *values).alias("value")).write.text(path)
    spark.createDataFrame([("\n".join([*head, "@data"]),)], "value string").coalesce(1).write.mode("append").text(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()


def derby_archive(df: DataFrame, folder: str, table: str) -> str:
    """Save ``df`` as a table of a Derby database that every process can read; its URL.

    Only one process can have an embedded database open, so executors with JVMs
    of their own can not insert into one.  They write delimited files into the
    shared ``folder``, the database imports them on the driver and is packed
    into a jar, which Derby opens for reading in any number of processes.
    """
    from py4j.protocol import Py4JJavaError

    path = re.sub(r"^file:(//)?(?=/)", "", folder)
    if not path.startswith("/"):
        raise ValueError(f"Derby reads and writes local and mounted folders only: {folder}")
    spark, db = df.sparkSession, f"{path}/db"
    values = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"no import of {f.dataType.simpleString()}: {f.name}")
        text = F.col(f.name).cast("string")
        if isinstance(f.dataType, T.StringType):
            text = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        values.append(F.coalesce(text, F.lit("")))  # an empty field without quotes is NULL
    df.select(F.concat_ws(",", *values).alias("value")).write.text(f"{folder}/rows")
    write_jdbc(spark.createDataFrame([], df.schema).limit(0), f"jdbc:derby:{db};create=true", table)  # no task: the driver creates the table

    connect = spark._jvm.java.sql.DriverManager.getConnection
    con = connect(f"jdbc:derby:{db}")
    load = con.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
    for part in sorted(Path(path, "rows").glob("part-*")):
        if part.stat().st_size:
            load.setString(1, table.upper())
            load.setString(2, str(part))
            load.execute()
    con.close()
    try:
        connect(f"jdbc:derby:{db};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # what a shutdown that went well says
            raise
    with zipfile.ZipFile(f"{path}/db.jar", "w") as jar:  # stored, so that a page is reached without unpacking those before it
        for f in sorted(Path(db).rglob("*")):
            jar.write(f, f.relative_to(path))
    shutil.rmtree(db)
    shutil.rmtree(f"{path}/rows")
    return f"jdbc:derby:jar:({path}/db.jar)db"
