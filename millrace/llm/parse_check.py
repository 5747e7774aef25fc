"""P5 - source files that do not parse.

Every file is lexed into rows of adjacent token-class pairs, which are
anti-joined against the pairs the grammar permits.  A file all of whose pairs
are permitted, but whose bracketed regions or statements do not reduce to the
language's productions, contributes the row :data:`PRODUCTION` that no grammar
permits.  Python, JSON, XML, XSL
and OPML productions are checked by their exact grammars.

Defined results: null content is never broken; empty content is broken only
where the grammar needs something (JSON, XML, XSL, OPML); an unknown extension
is not judged; rows delivered again under one ``file_id`` count once; columns
beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import syntax
from .sources import map_rows, with_ext

#: pair code of a file whose productions do not reduce
PRODUCTION = -1


def permissible(spark: SparkSession) -> DataFrame:
    """The grammar table: under 8 000 rows whatever the input."""
    return spark.createDataFrame(syntax.permissible_pairs(), "ext string, pair int")


def lex_pairs(files: DataFrame, exts: tuple[str, ...] = syntax.PARSED) -> DataFrame:
    """(file_id, ext, pairs): the distinct adjacent token pairs of each file."""

    def lex(cols: dict) -> dict:
        pairs = []
        for ext, text in zip(cols["ext"], cols["content"]):
            ok, codes = syntax.analyse(ext, text)
            pairs.append(codes if ok else [*codes, PRODUCTION])
        return {"file_id": cols["file_id"], "ext": cols["ext"], "pairs": pairs}

    return map_rows(with_ext(files, exts), lex, "file_id bigint, ext string, pairs array<int>")


def violations(files: DataFrame, exts: tuple[str, ...] = syntax.PARSED) -> DataFrame:
    """(file_id, ext, pair): each kind of violation in each file."""
    rows = lex_pairs(files, exts).select("file_id", "ext", F.explode("pairs").alias("pair"))
    return rows.join(F.broadcast(permissible(files.sparkSession)), ["ext", "pair"], "left_anti")


def broken_files(files: DataFrame, exts: tuple[str, ...] = syntax.PARSED) -> DataFrame:
    """Distinct ``file_id`` of the files that do not parse."""
    return violations(files, exts).select("file_id").distinct()


def broken_causes(files: DataFrame) -> DataFrame:
    """(ext, cause, files): broken files told by a pair alone, and by their productions."""
    per_file = violations(files).groupBy("file_id", "ext").agg(F.max("pair").alias("pair"))
    cause = F.when(F.col("pair") == PRODUCTION, "production").otherwise("pair")
    return per_file.groupBy("ext", cause.alias("cause")).agg(F.count("*").alias("files"))


def broken_rates(files: DataFrame) -> DataFrame:
    """Files, broken files and their rate per repository and extension (each ``file_id`` once)."""
    once = (
        files.where(F.col("content").isNotNull())
        .select("file_id", "repo_id", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9_]+)$", 1)).alias("ext"))
        .where(F.col("ext").isin(*syntax.PARSED))
        .distinct()
    )
    bad = broken_files(files).withColumn("bad", F.lit(1))
    return (
        once.join(bad, "file_id", "left")
        .groupBy("repo_id", "ext")
        .agg(F.count("*").alias("files"), F.count("bad").alias("broken"))
        .withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
    )
