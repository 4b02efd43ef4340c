"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, licenses, line_dedup, mixing, near_dedup, pii, quality, secret_scan, warc
from .common import table
from .sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    docs = lambda s, d: table(s, d, "documents")
    pages = lambda s, d: table(s, d, "pages")
    return {
        "op1_pii": lambda s, d: pii.report(docs(s, d)),
        "op2_quality": lambda s, d: quality.report(docs(s, d)),
        "op3_secrets": lambda s, d: secret_scan.report(docs(s, d)),
        "op4_near_dedup": lambda s, d: near_dedup.report(docs(s, d)),
        "op5_html_text": lambda s, d: html_text.report(pages(s, d)),
        "op6_licenses": lambda s, d: licenses.report(docs(s, d)),
        "op7_warc": lambda s, d: warc.report(pages(s, d)),
        "op8_mixing": lambda s, d: mixing.report(docs(s, d)),
        "op8_passes": lambda s, d: mixing.passes(docs(s, d)),
        "op9_line_dedup": lambda s, d: line_dedup.report(docs(s, d)),
        "op10_decontaminate": lambda s, d: decontaminate.report(docs(s, d), table(s, d, "benchmark")),
        "op10_proximity": lambda s, d: decontaminate.near_report(docs(s, d), table(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
