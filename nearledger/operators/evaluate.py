"""Evaluation of decisions against expected ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a value range that may be sorted at once; parts that a larger range is cut into.
SORTED, PARTS = 1_000_000, 4096


def confusion(rows: DataFrame) -> DataFrame:
    """n, fp (denied, expected approved), fn (approved, expected denied), e = fp + 3 fn, eps = e / n, fail = (fp + fn) / n."""
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(count(~F.col("approved") & F.col("expected_approved")), F.lit(0)).alias("fp"), F.coalesce(count(F.col("approved") & ~F.col("expected_approved")), F.lit(0)).alias("fn"))
    e, n = F.col("fp") + 3 * F.col("fn"), F.when(F.col("n") == 0, F.lit(1)).otherwise(F.col("n"))
    return got.select("n", "fp", "fn", e.alias("e"), (e / n).alias("eps"), ((F.col("fp") + F.col("fn")) / n).alias("fail"))


def detection_score(e: Column, eps: Column) -> Column:
    return 1000 * F.log10(1 / F.greatest(eps, F.lit(0.001))) - 300 * F.log10(1 + e)


def load_score(fp: int, fn: int, errors: int, n: int, p99_ms: float) -> float:
    """Detection and latency of a load test: errors weigh five, and over 15 % failures or 2000 ms the part is -3000."""
    e = fp + 3 * fn + 5 * errors
    detection = -3000.0 if n and (fp + fn + errors) / n > 0.15 else 1000 * math.log10(1 / max(e / max(n, 1), 0.001)) - 300 * math.log10(1 + e)
    latency = -3000.0 if p99_ms > 2000 else 1000 * math.log10(1000 / max(p99_ms, 1.0))
    return detection + latency


def vote_breakdown(rows: DataFrame) -> DataFrame:
    """Per cheap vote that occurs: total, escalated, fp, fn and the mean of rows_scanned of those escalated (0 if none)."""
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return rows.groupBy("cheap_votes").agg(
        F.count(F.lit(1)).alias("total"), count(F.col("escalated")).alias("escalated"), count(~F.col("approved") & F.col("expected_approved")).alias("fp"),
        count(F.col("approved") & ~F.col("expected_approved")).alias("fn"), F.coalesce(F.avg(F.when(F.col("escalated"), F.col("rows_scanned"))), F.lit(0.0)).alias("mean_rows"),
    )


def order_statistic(rows: DataFrame, column: str, percent: float) -> float | None:
    """sorted[floor(n percent / 100)] (the last at most), exactly; None of no rows. Ranges of values are counted and narrowed until what is left can be sorted, so no task sees all rows."""
    x = rows.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    n, low, high = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    k = min(n - 1, math.floor(n * percent / 100))
    held = x
    while n > SORTED and low < high:
        width = (high - low) / PARTS
        part = F.least(F.floor((F.col("x") - low) / width), F.lit(PARTS - 1))
        for r in sorted(held.groupBy(part.alias("p")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()):
            if k < r["n"]:
                break
            k -= r["n"]
        n, low, high = r["n"], r["low"], r["high"]
        held = x.filter((F.col("x") >= low) & (F.col("x") <= high))
    return low if low == high else held.orderBy("x").offset(k).limit(1).first()[0]


def index_percentiles(rows: DataFrame, column: str, percents: list[float]) -> DataFrame:
    """percent, value."""
    return rows.sparkSession.createDataFrame([(float(p), order_statistic(rows, column, p)) for p in percents], "percent double, value double")


def compare_scores(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """n, mismatches of votes over the queries of both."""
    both = approximate.select("qid", F.col("votes").alias("a")).join(exact.select("qid", F.col("votes").alias("b")), "qid")
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0)), F.lit(0)).alias("mismatches"))
