"""Figures of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_metrics(results: DataFrame, by: str = "doc_id", elapsed: str = "elapsed", status: str = "status", markdown: str = "markdown") -> DataFrame:
    """(doc, n_pages, total_s, avg_s, n_fallback, n_chars) for each document."""
    total = F.coalesce(F.sum(elapsed), F.lit(0.0))
    return results.groupBy(by).agg(
        F.count("*").alias("n_pages"), total.alias("total_s"), (total / F.greatest(F.count("*"), F.lit(1))).alias("avg_s"),
        F.count_if(F.col(status) == "fallback").alias("n_fallback"), F.coalesce(F.sum(F.length(markdown)), F.lit(0)).alias("n_chars"),
    )


def fallback_pages(results: DataFrame, by: str = "doc_id", page: str = "page_number", status: str = "status") -> DataFrame:
    """(doc, pages, n): pages that fell back, in order, of each document that has any."""
    return results.where(F.col(status) == "fallback").groupBy(by).agg(F.array_sort(F.collect_list(page)).alias("pages"), F.count("*").alias("n"))


def with_ordinals(pages: DataFrame, by: str = "doc_id", page: str = "page_number") -> DataFrame:
    """pages with ordinal and n_pages within their document."""
    from pyspark.sql import Window

    w = Window.partitionBy(by)
    return pages.withColumn("ordinal", F.row_number().over(w.orderBy(page))).withColumn("n_pages", F.count("*").over(w))
