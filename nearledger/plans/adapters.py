"""The transaction view over orders and customers, for Spark and for SQL, and the SQL of the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import load_constants
from ..operators.vectorize import VECTOR, vectorize
from ..sources.store import stored

#: Merchant category codes of the risk table, and two that it lacks.
MCC = ["5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "1234", "9999"]
#: Cells a bucket, probes of the cheap and of the high pass, sample rows a bucket in the queries.
NLIST, NPROBE, NPROBE_HIGH, SAMPLE = 8, 3, 6, 400
#: Probes of the high pass for some cheap votes.
HIGH_FOR_VOTES = {2: 4, 3: 8}


#: So many customers at most are sent to all workers; more are joined by key.
FEW = 500_000


def transactions(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """One flat transaction per order, with qid and the label fraud. only: a condition on orders; the windows then run over the orders of those customers alone who have such orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    if only is not None:
        theirs = stored(orders.filter(only).select(F.col("o_custkey").alias("_cust")).distinct(), "customers")
        orders = orders.join(F.broadcast(theirs) if theirs.count() <= FEW else theirs, F.col("o_custkey").eqNullSafe(F.col("_cust")), "left_semi")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (key % 24).cast("int"))
    own = Window.partitionBy("o_custkey")
    line = own.orderBy("o_orderdate", "o_orderkey")
    merchant = lambda x: F.concat(F.lit("m"), x.cast("string"))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(own)
    # the windows first, over narrow rows: what stands in one select with them is computed below them, and shuffled and sorted
    rows = orders.withColumn("at", at).withColumn("sec", F.unix_seconds(F.col("at").cast("timestamp"))).select(
        "o_orderkey", "o_custkey", "o_totalprice", "at", (cents.cast("double") / F.count(F.lit(1)).over(own) / 5000).alias("avg_amount"),
        F.count(F.lit(1)).over(own.orderBy("sec").rangeBetween(-86400, 0)).cast("int").alias("tx_count"), F.lag("at").over(line).alias("last_at"),
    )
    return (rows if only is None else rows.filter(only)).select(
        key.alias("qid"), (F.col("o_totalprice") / 50).alias("amount"), (key % 12 + 1).cast("int").alias("installments"), F.col("at").alias("requested_at"), "avg_amount", "tx_count",
        F.array(merchant(cust % 50), merchant(cust * 7 % 50), merchant(cust * 13 % 50)).alias("known_merchants"), merchant(key % 50).alias("merchant_id"),
        F.array(*map(F.lit, MCC))[(cust % 12).cast("int")].alias("mcc"), ((key % 53) * 200).cast("double").alias("merchant_avg"),
        ((key % 7) < 3).alias("is_online"), ((key % 11) < 6).alias("card_present"), (key * 37 % 1500).cast("double").alias("km_home"), "last_at",
        F.when(F.col("last_at").isNotNull(), (key * 13 % 1200).cast("double")).alias("km_last"), ((key * 31 + cust) % 10 < 4).alias("fraud"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, d0 to d13, fraud."""
    return vectorize(transactions(spark, sf_dir), *load_constants()).select("qid", *VECTOR, "fraud")


TX = f"""tx AS (
  SELECT *, CASE WHEN last_at IS NOT NULL THEN CAST(qid * 13 % 1200 AS DOUBLE) END AS km_last FROM (
    SELECT o_orderkey AS qid, o_totalprice / 50 AS amount, CAST(o_orderkey % 12 + 1 AS INTEGER) AS installments, tm AS requested_at,
      CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey) AS DOUBLE) / count(*) OVER (PARTITION BY o_custkey) / 5000 AS avg_amount,
      CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS INTEGER) AS tx_count,
      ['m' || (o_custkey % 50), 'm' || (o_custkey * 7 % 50), 'm' || (o_custkey * 13 % 50)] AS known_merchants, 'm' || (o_orderkey % 50) AS merchant_id,
      ({MCC})[o_custkey % 12 + 1] AS mcc, CAST(o_orderkey % 53 * 200 AS DOUBLE) AS merchant_avg, o_orderkey % 7 < 3 AS is_online, o_orderkey % 11 < 6 AS card_present,
      CAST(o_orderkey * 37 % 1500 AS DOUBLE) AS km_home, lag(tm) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last_at, (o_orderkey * 31 + o_custkey) % 10 < 4 AS fraud
    FROM (SELECT *, epoch_us(tm) // 1000000 AS sec FROM (SELECT *, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS tm FROM orders))
  )
)"""


def _clamp(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN 0.0 WHEN {x} > 1 THEN 1.0 ELSE {x} END"


RISK = f"coalesce((map({[*load_constants()[1]]}, {[*load_constants()[1].values()]}))[mcc], CAST(0.5 AS DOUBLE))"
_n = load_constants()[0]
FEATURES = [
    _clamp(f"(amount / {_n.max_amount}::DOUBLE)"), _clamp(f"(installments::DOUBLE / {_n.max_installments}::DOUBLE)"), _clamp(f"(amount / avg_amount / {_n.amount_vs_avg_ratio}::DOUBLE)"),
    "hour(requested_at)::DOUBLE / 23::DOUBLE", "(isodow(requested_at) - 1)::DOUBLE / 6::DOUBLE",
    "CASE WHEN last_at IS NULL THEN -1 ELSE " + _clamp(f"((epoch_us(requested_at) - epoch_us(last_at))::DOUBLE / 60000000::DOUBLE / {_n.max_minutes}::DOUBLE)") + " END",
    "CASE WHEN last_at IS NULL THEN -1 ELSE " + _clamp(f"(km_last / {_n.max_km}::DOUBLE)") + " END", _clamp(f"(km_home / {_n.max_km}::DOUBLE)"), _clamp(f"(tx_count::DOUBLE / {_n.max_tx_count_24h}::DOUBLE)"),
    "is_online::INTEGER::DOUBLE", "card_present::INTEGER::DOUBLE", "(NOT list_contains(known_merchants, merchant_id))::INTEGER::DOUBLE", RISK, _clamp(f"(merchant_avg / {_n.max_merchant_avg_amount}::DOUBLE)"),
]
D = ", ".join(VECTOR)
VEC = f"{TX}, vec AS (SELECT qid, {', '.join(f'CAST({x} AS DOUBLE) AS d{i}' for i, x in enumerate(FEATURES))}, fraud FROM tx)"
_code = lambda x: f"CAST(CASE WHEN {x} < 0 THEN 0 ELSE round(least({x}, 1.0::DOUBLE) * 10000::DOUBLE) + 1 END AS INTEGER)"
_value = lambda c: f"CASE WHEN {c} = 0 THEN (-1)::DOUBLE ELSE ({c} - 1)::DOUBLE / 10000::DOUBLE END"
BUCKET = "CAST(CASE WHEN d9 > 0.5 THEN 8 ELSE 0 END + CASE WHEN d10 > 0.5 THEN 4 ELSE 0 END + CASE WHEN d11 > 0.5 THEN 2 ELSE 0 END + CASE WHEN d5 < 0 THEN 1 ELSE 0 END AS INTEGER)"
PENALTY = (
    " + ".join(f"CASE WHEN (q.d{i} > 0.5) <> (bucket & {w} <> 0) THEN 1 ELSE 0 END" for i, w in ((9, 8), (10, 4), (11, 2)))
    + " + CASE WHEN (q.d5 < 0) = (bucket & 1 <> 0) THEN 0 WHEN q.d5 < 0 THEN 2 ELSE (q.d5 + 1) * (q.d5 + 1) + (q.d6 + 1) * (q.d6 + 1) END"
)
#: Codes with ranks in buckets, and their values.
CODED = f"""{VEC}, code AS (SELECT qid AS rid, {', '.join(f'{_code(f"d{i}")} AS c{i}' for i in range(14))}, {BUCKET} AS bucket, fraud FROM vec),
val AS (SELECT rid, bucket, fraud, {', '.join(f'{_value(f"c{i}")} AS d{i}' for i in range(14))}, {', '.join(f'c{i}' for i in range(14))},
  row_number() OVER (PARTITION BY bucket ORDER BY rid) - 1 AS rn, count(*) OVER (PARTITION BY bucket) AS m FROM code)"""
SAMPLED = f"""{CODED}, sampled AS (SELECT * EXCLUDE (rn, m), rn // greatest(m // {SAMPLE}, 1) AS rn FROM val WHERE rn % greatest(m // {SAMPLE}, 1) = 0 AND rn // greatest(m // {SAMPLE}, 1) < {SAMPLE}),
sample AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS m FROM sampled),
seed AS (SELECT bucket, CAST(rn // greatest(m // {NLIST}, 1) AS INTEGER) AS cell, {D} FROM sample WHERE rn % greatest(m // {NLIST}, 1) = 0 AND rn // greatest(m // {NLIST}, 1) < {NLIST})"""


def distance(a: str, b: str) -> str:
    return " + ".join(f"({a}.d{i} - {b}.d{i}) * ({a}.d{i} - {b}.d{i})" for i in range(14))


def assigned(rows: str, centroids: str, name: str) -> str:
    """A view of rows with the nearest centroid's cell."""
    return f"{name} AS (SELECT v.*, n.cell FROM {rows} v JOIN (SELECT rid, arg_min(cell, (d, cell)) AS cell FROM (SELECT v.rid, c.cell, {distance('v', 'c')} AS d FROM {rows} v JOIN {centroids} c ON c.bucket = v.bucket) GROUP BY rid) n ON n.rid = v.rid)"


def centroid_means(rows: str) -> str:
    mean = lambda i: f"CASE WHEN sum(c{i}) = 0 THEN (-1)::DOUBLE ELSE CAST(sum(c{i}) - count(*) AS DOUBLE) / CAST(count(*) * 10000 AS DOUBLE) END AS d{i}"
    return f"SELECT bucket, cell, {', '.join(map(mean, range(14)))} FROM {rows} GROUP BY bucket, cell"


BUCKET_Q = "(CASE WHEN q.d9 > 0.5 THEN 8 ELSE 0 END + CASE WHEN q.d10 > 0.5 THEN 4 ELSE 0 END + CASE WHEN q.d11 > 0.5 THEN 2 ELSE 0 END + CASE WHEN q.d5 < 0 THEN 1 ELSE 0 END)"
#: One iteration over the sample, then all rows assigned.
INDEXED = f"""{SAMPLED}, {assigned('sample', 'seed', 'step0')}, moved AS ({centroid_means('step0')}),
cent0 AS (SELECT s.bucket, s.cell, {', '.join(f'coalesce(m.d{i}, s.d{i}) AS d{i}' for i in range(14))} FROM seed s LEFT JOIN moved m USING (bucket, cell)),
{assigned('val', 'cent0', 'rows')}, size AS (SELECT bucket, cell, count(*) AS n FROM rows GROUP BY bucket, cell), cent AS (SELECT c.*, n FROM cent0 c JOIN size USING (bucket, cell)),
q AS (SELECT * FROM vec WHERE qid % 100 = 0),
cellrank AS (SELECT q.qid, c.bucket, c.cell, c.n, row_number() OVER (PARTITION BY q.qid, c.bucket ORDER BY {distance('q', 'c')}, c.cell) - 1 AS place, {PENALTY} AS penalty, c.bucket = {BUCKET_Q} AS home FROM q, cent c)"""


def searched(name: str, most: str, rows: str = "q") -> str:
    """Views: name (qid, rid, d, fraud, rank) of a pruned search with `most` probes, an expression over the query's row."""
    return f"""{name}p AS (SELECT r.* FROM cellrank r JOIN {rows} q ON q.qid = r.qid WHERE r.place < {most}),
{name}h AS (SELECT * FROM (SELECT p.qid, v.rid, v.fraud, {distance('q', 'v')} AS d FROM {name}p p JOIN rows v USING (bucket, cell) JOIN q ON q.qid = p.qid WHERE p.home) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, rid) <= 5),
{name}k AS (SELECT qid, CASE WHEN count(*) >= 5 THEN max(d) END AS kth FROM {name}h GROUP BY qid),
{name}o AS (SELECT p.qid, v.rid, v.fraud, {distance('q', 'v')} AS d FROM {name}p p LEFT JOIN {name}k k ON k.qid = p.qid JOIN rows v USING (bucket, cell) JOIN q ON q.qid = p.qid WHERE NOT p.home AND (k.kth IS NULL OR p.penalty <= k.kth)),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rank FROM (SELECT * FROM {name}h UNION ALL BY NAME SELECT * FROM {name}o) QUALIFY rank <= 5)"""
