"""The training-data queries, by the names the driver knows, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .secrets import secrets_found

    return secrets_found(table(spark, d, "source_file"), table(spark, d, "batch_job"))


def _p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    from .secrets import redacted_files

    return redacted_files(table(spark, d, "source_file"))


def _p1_redacted_jobs(spark: SparkSession, d: str) -> DataFrame:
    from .secrets import redacted_jobs

    return redacted_jobs(table(spark, d, "batch_job"))


def _p1_rules(spark: SparkSession, d: str) -> DataFrame:
    from .secrets import branch_counts

    return branch_counts(table(spark, d, "source_file"))


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .nlcode import languages_in_code

    return languages_in_code(table(spark, d, "source_file"), table(spark, d, "documents"))


def _p2_shares(spark: SparkSession, d: str) -> DataFrame:
    from .nlcode import language_shares

    return language_shares(table(spark, d, "source_file"), table(spark, d, "documents"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .docpairs import described_functions

    return described_functions(table(spark, d, "source_file"))


def _p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    from .docpairs import code_pairs

    return code_pairs(table(spark, d, "source_file"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    from .handwritten import files_not_by_hand

    return files_not_by_hand(table(spark, d, "source_file"), table(spark, d, "repo"))


def _p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    from .handwritten import file_reasons

    return file_reasons(table(spark, d, "source_file"), table(spark, d, "repo"))


def _p4_stages(spark: SparkSession, d: str) -> DataFrame:
    from .handwritten import stage_counts

    return stage_counts(table(spark, d, "source_file"), table(spark, d, "repo"))


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .parse_check import broken_files

    return broken_files(table(spark, d, "source_file"))


def _p5_causes(spark: SparkSession, d: str) -> DataFrame:
    from .parse_check import broken_causes

    return broken_causes(table(spark, d, "source_file"))


def _p5_rates(spark: SparkSession, d: str) -> DataFrame:
    from .parse_check import broken_rates

    return broken_rates(table(spark, d, "source_file"))


def _p6_packing(spark: SparkSession, d: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, d, "documents"), table(spark, d, "pack_target"))


def _p6_fill(spark: SparkSession, d: str) -> DataFrame:
    from .packing import fill

    return fill(table(spark, d, "documents"), table(spark, d, "pack_target"))


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .leakage import leaks_exact

    return leaks_exact(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _p7_near(spark: SparkSession, d: str) -> DataFrame:
    from .leakage import leaks_near

    return leaks_near(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _p7_report(spark: SparkSession, d: str) -> DataFrame:
    from .leakage import leak_report

    return leak_report(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _p8_found(spark: SparkSession, d: str) -> DataFrame:
    from .truncation import truncated

    return truncated(table(spark, d, "documents"))


def _p8_reasons(spark: SparkSession, d: str) -> DataFrame:
    from .truncation import cuts

    return cuts(table(spark, d, "documents")).drop("state")


def _p8_causes(spark: SparkSession, d: str) -> DataFrame:
    from .truncation import cause_counts

    return cause_counts(table(spark, d, "documents"))


def _p8_rates(spark: SparkSession, d: str) -> DataFrame:
    from .truncation import truncation_rates

    return truncation_rates(table(spark, d, "documents"))


def _p8_hazards(spark: SparkSession, d: str) -> DataFrame:
    from .truncation import length_hazards

    return length_hazards(table(spark, d, "documents")).where("significant").select("source", "unit", "length", "n", "at_risk")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _p1_found,
    "p1_redacted": _p1_redacted,
    "p1_redacted_jobs": _p1_redacted_jobs,
    "p1_rules": _p1_rules,
    "p2_found": _p2_found,
    "p2_shares": _p2_shares,
    "p3_found": _p3_found,
    "p3_pairs": _p3_pairs,
    "p4_found": _p4_found,
    "p4_reasons": _p4_reasons,
    "p4_stages": _p4_stages,
    "p5_found": _p5_found,
    "p5_causes": _p5_causes,
    "p5_rates": _p5_rates,
    "p6_packing": _p6_packing,
    "p6_fill": _p6_fill,
    "p7_found": _p7_found,
    "p7_near": _p7_near,
    "p7_report": _p7_report,
    "p8_found": _p8_found,
    "p8_reasons": _p8_reasons,
    "p8_causes": _p8_causes,
    "p8_rates": _p8_rates,
    "p8_hazards": _p8_hazards,
}

#: none of these operators can be stated in SQL; tests compare them with brute force
SQL: dict[str, str] = {}
