"""Fetch logs: pages kept, counts, throttled schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.functions.ids import uuid5_url


def page_ok(error: Column, text: Column) -> Column:
    return error.isNull() & F.coalesce(text != "", F.lit(False))


def throttled(arrivals: DataFrame, domain: str, at: str, delay: float, order: str) -> DataFrame:
    """arrivals with start_at: each request of a domain starts when it arrives, or `delay` after the one before it started.

    start_i = max(arrive_i, start_(i-1) + delay) is the running maximum of arrive_j - delay * j, plus delay * i. A delay
    of 0 or less changes nothing. at: seconds as a number.
    """
    if delay <= 0:
        return arrivals.withColumn("start_at", F.col(at).cast("double"))
    w = Window.partitionBy(domain).orderBy(at, order)
    ahead = arrivals.withColumn("__i", F.row_number().over(w) - 1)
    running = F.max(F.col(at).cast("double") - delay * F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ahead.withColumn("start_at", delay * F.col("__i") + running).drop("__i")


def fetch_status(log: DataFrame) -> DataFrame:
    """(source, done, ok, failed)."""
    ok = page_ok(F.col("error"), F.col("text"))
    return log.groupBy("source").agg(F.count(F.lit(1)).alias("done"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


def scrape_counters(log: DataFrame) -> DataFrame:
    """One row (total, ok, failed, non_html)."""
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(~F.coalesce(T.is_html(F.col("content_type")), F.lit(False))).alias("non_html"))


def page_rows(pages: DataFrame, markers: list[str]) -> DataFrame:
    """pages with page_uuid, machine_generated (any marker occurs), char_count, word_count."""
    made = F.lit(False)
    for m in markers:
        made = made | F.col("text").contains(m)
    ws = T.normalize(F.col("text"))
    return pages.withColumns({"page_uuid": uuid5_url(F.col("url")), "machine_generated": made, "char_count": F.length("text"), "word_count": F.when(ws == "", 0).otherwise(F.size(F.split(ws, " ")))})


def export_pages(log: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds with the fetched page of their url, if it is usable. The log's last row of a url counts: see store.latest."""
    return seeds.join(log.where(page_ok(F.col("error"), F.col("text"))), "url")
