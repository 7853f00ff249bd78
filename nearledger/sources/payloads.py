"""JSON requests: parsing, the check for what is missing, evaluation files, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DIMS
from ..functions import scalars as S

PAYLOAD = (
    "struct<id:string,transaction:struct<amount:double,installments:int,requested_at:string>,customer:struct<avg_amount:double,tx_count_24h:int,known_merchants:array<string>>,"
    "merchant:struct<id:string,mcc:string,avg_amount:double>,terminal:struct<is_online:boolean,card_present:boolean,km_from_home:double>,last_transaction:struct<timestamp:string,km_from_current:double>>"
)


def parse_requests(rows: DataFrame, column: str = "request", lenient: bool = False) -> DataFrame:
    """Flat transactions of JSON texts, with is_fallback: the request can't be scored and is approved with score 0.

    Strict: every field must be there and well formed, and the key of the last transaction too, be it null.
    Lenient: what is missing is zero, empty or false, a bad time is 0001-01-01, a Monday; only unreadable JSON falls back.
    """
    parsed = rows.withColumn("_p", F.from_json(column, PAYLOAD, {"mode": "PERMISSIVE"})).withColumn("_keys", F.json_object_keys(column))
    p = lambda name: F.col(f"_p.{name}")
    at, last_at = S.parse_stamp(p("transaction.requested_at")), S.parse_stamp(p("last_transaction.timestamp"))
    has_last = p("last_transaction").isNotNull()
    zero = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    need = [
        "transaction.amount", "transaction.installments", "customer.avg_amount", "customer.tx_count_24h", "customer.known_merchants", "merchant.id", "merchant.mcc",
        "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home",
    ]
    whole = F.col("_keys").isNotNull() & F.array_contains(F.coalesce("_keys", F.array().cast("array<string>")), "last_transaction") & at.isNotNull()
    for n in need:
        whole = whole & p(n).isNotNull()
    whole = whole & (~has_last | (last_at.isNotNull() & p("last_transaction.km_from_current").isNotNull()))
    ok = F.coalesce(F.col("_keys").isNotNull() if lenient else whole, F.lit(False))
    fill = lambda x, y: F.coalesce(x, F.lit(y))
    return parsed.select(
        *rows.columns, p("id").alias("id"), (~ok).alias("is_fallback"),
        fill(p("transaction.amount"), 0.0).alias("amount"), fill(p("transaction.installments"), 0).alias("installments"), F.coalesce(at, zero).alias("requested_at"),
        fill(p("customer.avg_amount"), 0.0).alias("avg_amount"), fill(p("customer.tx_count_24h"), 0).alias("tx_count"),
        F.coalesce(p("customer.known_merchants"), F.array().cast("array<string>")).alias("known_merchants"), fill(p("merchant.id"), "").alias("merchant_id"),
        fill(p("merchant.mcc"), "").alias("mcc"), fill(p("merchant.avg_amount"), 0.0).alias("merchant_avg"), fill(p("terminal.is_online"), False).alias("is_online"),
        fill(p("terminal.card_present"), False).alias("card_present"), fill(p("terminal.km_from_home"), 0.0).alias("km_home"),
        F.when(has_last, F.coalesce(last_at, zero)).alias("last_at"), F.when(has_last, fill(p("last_transaction.km_from_current"), 0.0)).alias("km_last"),
    )


def read_references(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """rid, d0 to d13, fraud of a JSON array of {vector, label}, also gzipped. Such a file is one split, so it is dealt out after reading. Broken records fail the read."""
    rows = spark.read.schema("vector array<double>, label string").option("multiLine", True).option("mode", "FAILFAST").json(path)
    sized = F.when(F.size("vector") == DIMS, F.col("vector")).otherwise(F.raise_error(F.lit(f"a reference vector has {DIMS} numbers")))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), sized.alias("v"), F.coalesce(F.col("label") == "fraud", F.lit(False)).alias("fraud"))
    return rows.repartition(partitions or spark.sparkContext.defaultParallelism, "rid").select("rid", *[F.col("v")[i].alias(f"d{i}") for i in range(DIMS)], "fraud")


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """request (JSON text) and expected_approved of {"entries": [{"request", "expected_approved"}]}."""
    # the request stays the text that it is, so that a missing key and a null one are told apart
    rows = spark.read.schema("entries array<struct<request:string,expected_approved:boolean>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.explode("entries").alias("e")).select("e.request", "e.expected_approved")


def respond(votes: Column, fallback: Column) -> list[Column]:
    """approved and fraud_score of a request."""
    n = F.when(fallback, F.lit(0)).otherwise(F.coalesce(votes, F.lit(0)))
    return [(n < 3).alias("approved"), (n / F.lit(5.0)).alias("fraud_score")]
