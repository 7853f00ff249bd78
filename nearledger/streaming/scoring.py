"""Scoring a stream of JSON requests. Requests are independent, so each micro-batch is scored like a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Norm, SearchConfig
from ..operators.index import Index
from ..operators.search import two_tier
from ..operators.vectorize import VECTOR, vectorize
from ..sources.payloads import parse_requests
from ..sources.store import scratch, stored


def score_requests(requests: DataFrame, index: Index, norm: Norm, risk: dict[str, float], config: SearchConfig | None = None) -> DataFrame:
    """approved, fraud_score and is_fallback of rows qid, request. No row is lost: what can't be scored is approved with score 0."""
    flat = stored(parse_requests(requests).drop("request"), "requests")
    tx = stored(vectorize(flat, norm, risk).select("qid", "is_fallback", *VECTOR), "vectors")
    usable = tx.filter(~F.col("is_fallback") & ~F.isnan("d2"))
    scored = two_tier(usable, index, config or SearchConfig()).select("qid", "votes")
    votes = F.coalesce("votes", F.lit(0))
    return tx.select("qid", (F.col("is_fallback") | F.isnan("d2")).alias("is_fallback")).join(scored, "qid", "left").select("qid", "is_fallback", (votes < 3).alias("approved"), (votes / F.lit(5.0)).alias("fraud_score"))


def start(spark: SparkSession, source: str, index: Index, norm: Norm, risk: dict[str, float], sink: Callable[[DataFrame, int], None], checkpoint: str, config: SearchConfig | None = None, interval: str | None = None):
    """Score JSON files (qid, request) that arrive in a folder; the sink gets each scored batch with its number, again after a failure, and writes it
    before it returns: the batch's own tables are deleted then. interval: seconds between batches, as in "10 seconds"; without it, what is there is scored and the query ends."""
    rows = spark.readStream.schema("qid long, request string").json(source)

    def score(batch: DataFrame, k: int) -> None:
        with scratch(batch.sparkSession):
            sink(score_requests(batch, index, norm, risk, config), k)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return rows.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**trigger).start()
