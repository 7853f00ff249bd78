"""Transactions to feature vectors: 14 double columns d0 to d13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DIMS, Norm
from ..functions import scalars as S

VECTOR = [f"d{i}" for i in range(DIMS)]
#: Columns of a flat transaction.
FLAT = (
    "amount double, installments int, requested_at timestamp_ntz, avg_amount double, tx_count int, known_merchants array<string>, merchant_id string, "
    "mcc string, merchant_avg double, is_online boolean, card_present boolean, km_home double, last_at timestamp_ntz, km_last double"
)


def features(norm: Norm, risk: dict[str, float]) -> list[Column]:
    """The vector of a flat transaction. A missing last transaction gives -1 in d5 and d6, never null."""
    c = F.col
    none = c("last_at").isNull()
    share = lambda x, most: S.clamp(x.cast("double") / F.lit(most))
    return [
        share(c("amount"), norm.max_amount),
        share(c("installments"), norm.max_installments),
        S.clamp(S.divide(c("amount"), c("avg_amount")) / F.lit(norm.amount_vs_avg_ratio)),
        S.hour_share(c("requested_at")),
        S.weekday_share(c("requested_at")),
        F.when(none, F.lit(-1.0)).otherwise(S.clamp(S.minutes_between(c("requested_at"), c("last_at")) / F.lit(norm.max_minutes))),
        F.when(none, F.lit(-1.0)).otherwise(share(c("km_last"), norm.max_km)),
        share(c("km_home"), norm.max_km),
        share(c("tx_count"), norm.max_tx_count_24h),
        S.flag(c("is_online")),
        S.flag(c("card_present")),
        S.flag(~F.array_contains("known_merchants", c("merchant_id"))),
        S.merchant_risk(c("mcc"), risk),
        share(c("merchant_avg"), norm.max_merchant_avg_amount),
    ]


def vectorize(tx: DataFrame, norm: Norm, risk: dict[str, float]) -> DataFrame:
    """The rows with d0 to d13 added."""
    return tx.select("*", *[x.alias(n) for n, x in zip(VECTOR, features(norm, risk), strict=True)])
