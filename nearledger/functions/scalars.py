"""Scalar functions as column expressions; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_RISK

#: Digits of a zoned timestamp's date and time; offset and fraction are not read.
STAMP = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}).([0-9]{2}).([0-9]{2})."


def clamp(x: Column) -> Column:
    """Into [0, 1]. Not-a-number stays what it is: Spark sorts it above all numbers, hence the first case."""
    return F.when(F.isnan(x), x).when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x)


def divide(a: Column, b: Column) -> Column:
    """Division as in IEEE arithmetic, also by zero."""
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def flag(x: Column) -> Column:
    return x.cast("int").cast("double")


def merchant_risk(mcc: Column, risk: dict[str, float]) -> Column:
    """The code's risk; the default where the table lacks it. The table is a handful of literals, so there is no join."""
    pairs = [y for k, v in sorted(risk.items()) for y in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), mcc), F.lit(DEFAULT_RISK)) if pairs else F.lit(DEFAULT_RISK)


def parse_stamp(text: Column) -> Column:
    """A zoned timestamp's date and time as they stand (offset and fraction are not read). Months, days, hours, minutes and seconds
    out of range roll over; null unless it has 20 characters, digits in their places and a month and day above zero."""
    fits = (F.length(text) >= 20) & text.rlike(STAMP)
    safe = F.when(fits, text).otherwise(F.lit("0001-01-01T00:00:00Z"))
    part = lambda i: F.regexp_extract(safe, STAMP, i).cast("int")
    day = F.date_add(F.add_months(F.make_date(F.greatest(part(1), F.lit(1)), F.lit(1), F.lit(1)), part(2) - 1), part(3) - 1)
    at = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), part(4), part(5), part(6).cast("decimal(18,6)"))
    return F.when(fits & (part(2) > 0) & (part(3) > 0), at)


def hour_share(at: Column) -> Column:
    return F.hour(at).cast("double") / F.lit(23.0)


def weekday_share(at: Column) -> Column:
    """Monday 0 to Sunday 1."""
    return F.weekday(at).cast("double") / F.lit(6.0)


def minutes_between(late: Column, early: Column) -> Column:
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))).cast("double") / F.lit(60e6)


def quantize(x: Column) -> Column:
    """-1 (and all below zero) to 0, [0, 1] to 1..10001, half away from zero: by floor, as Spark's round goes through decimals; what is cut off is exact."""
    y = F.least(x, F.lit(1.0)) * F.lit(10000.0)
    return F.when(x < 0, F.lit(0)).otherwise((F.floor(y) + F.when(y - F.floor(y) >= 0.5, F.lit(2)).otherwise(F.lit(1))).cast("int"))


def dequantize(code: Column) -> Column:
    return F.when(code == 0, F.lit(-1.0)).otherwise((code - 1).cast("double") / F.lit(10000.0))


def bucket_of(v: Sequence[Column]) -> Column:
    """online 8 + card 4 + unknown merchant 2 + no last transaction 1."""
    bit = lambda cond, weight: F.when(cond, F.lit(weight)).otherwise(F.lit(0))
    return bit(v[9] > 0.5, 8) + bit(v[10] > 0.5, 4) + bit(v[11] > 0.5, 2) + bit(v[5] < 0, 1)


def bucket_penalty(q: Sequence[Column], bucket: Column) -> Column:
    """Least squared distance from a query to any row of a bucket, as far as its flags force it."""
    off = lambda x, weight: F.when((x > 0.5) != (bucket.bitwiseAND(F.lit(weight)) != 0), F.lit(1.0)).otherwise(F.lit(0.0))
    has_null, is_null = q[5] < 0, bucket.bitwiseAND(F.lit(1)) != 0
    last = F.when(has_null == is_null, F.lit(0.0)).when(has_null, F.lit(2.0)).otherwise((q[5] + 1) * (q[5] + 1) + (q[6] + 1) * (q[6] + 1))
    return off(q[9], 8) + off(q[10], 4) + off(q[11], 2) + last


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Sum over dimensions in their order, unrolled so that it stays in generated code."""
    total = None
    for x, y in zip(a, b, strict=True):
        d = (x - y) * (x - y)
        total = d if total is None else total + d
    return total
