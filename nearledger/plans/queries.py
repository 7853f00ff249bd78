"""The engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig, load_constants
from ..functions import scalars as S
from ..operators import evaluate, index as ix, knn, search
from ..operators.vectorize import VECTOR
from ..sources.payloads import parse_requests, respond
from ..sources.store import MADE, stored, work_dir
from ..streaming.scoring import score_requests, start
from . import adapters as A

#: Neighbour queries take every row whose id is divisible by this, against all rows.
EVERY = 100
CONFIG = SearchConfig(nprobe=A.NPROBE, nprobe_high=A.NPROBE_HIGH, margin=1)


#: The same of orders.
ASKED = f"o_orderkey % {EVERY} = 0"


def asked(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("qid") % EVERY == 0)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vectors(spark, sf_dir).withColumnRenamed("qid", "rid")


def kept_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as A.vectors(), written once: index, queries and exact search all read them."""

    def make():
        out = stored(A.vectors(spark, sf_dir), "all-vectors")
        return out._stored_at, out

    return _built("vectors", spark, sf_dir, make)[1]


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("rid"), "embedding", (F.col("label") < 4).alias("fraud"))


def near_embeddings(spark: SparkSession, sf_dir: str, k: int = 5, refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = embeddings(spark, sf_dir) if refs is None else refs
    queries = embeddings(spark, sf_dir).select(F.col("rid").alias("qid"), "embedding").filter(F.col("qid") % EVERY == 0)
    return queries, rows, knn.nearest(queries, rows, "embedding", k, exclude_self=True)


#: By session and folder: the vectors, the sample and then the index that were built, with their place, as long as store.clear() leaves it.
BUILT: dict[tuple, tuple[str, DataFrame | ix.Index]] = {}


def _built(kind: str, spark: SparkSession, sf_dir: str, make: Callable):
    key = kind, id(spark), sf_dir
    if key not in BUILT or BUILT[key][0] not in MADE:
        BUILT[key] = make()
    return BUILT[key]


def _sample(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    def make():
        at = work_dir(spark)
        return at, ix.prepare(kept_vectors(spark, sf_dir).withColumnRenamed("qid", "rid"), at, A.SAMPLE, kept=True)

    return _built("sample", spark, sf_dir, make)


def index(spark: SparkSession, sf_dir: str) -> ix.Index:
    at, sample = _sample(spark, sf_dir)
    return _built("index", spark, sf_dir, lambda: (at, ix.finish(sample, at, A.NLIST, 1, kept_vectors(spark, sf_dir).withColumnRenamed("qid", "rid"))))[1]


def coded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The systematic sample of the codes."""
    return _sample(spark, sf_dir)[1]


def vectorize_tx(spark, d):
    return A.vectors(spark, d)


def time_features(spark, d):
    at = F.col("requested_at")
    return A.transactions(spark, d).select("qid", S.hour_share(at).alias("hour"), S.weekday_share(at).alias("weekday"))


def last_tx_sentinel(spark, d):
    return A.vectors(spark, d).groupBy((F.col("d5") < 0).alias("no_last")).agg(F.count(F.lit(1)).alias("n"), F.min("d5").alias("least_d5"), F.max("d6").alias("most_d6"))


def unknown_merchant(spark, d):
    return A.transactions(spark, d).select("qid", (~F.array_contains("known_merchants", F.col("merchant_id"))).alias("unknown"))


def mcc_lookup(spark, d):
    return A.transactions(spark, d).select("qid", "mcc", S.merchant_risk(F.col("mcc"), load_constants()[1]).alias("risk"))


def clamp_values(spark, d):
    x = F.col("o_totalprice") / 100000 - 1
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.clamp(x).alias("clamped"), S.clamp(S.divide(x, F.col("o_orderkey") % 3)).alias("divided")).select("o_orderkey", "clamped", F.when(~F.isnan("divided"), F.col("divided")).alias("divided"))


def quantize(spark, d):
    return ix.coded(references(spark, d)).drop("bucket", "fraud")


def dequantize_roundtrip(spark, d):
    rows = A.vectors(spark, d)
    return rows.select("qid", *[S.dequantize(S.quantize(F.col(v))).alias(v) for v in VECTOR], *[(S.quantize(S.dequantize(S.quantize(F.col(v)))) == S.quantize(F.col(v))).alias(f"same_{v}") for v in ("d0", "d5")])


def bucket_of(spark, d):
    return A.vectors(spark, d).select("qid", S.bucket_of([F.col(v) for v in VECTOR]).alias("bucket"))


def bucket_histogram(spark, d):
    return ix.bucket_counts(ix.coded(references(spark, d)))


def bucket_penalty(spark, d):
    rows = A.vectors(spark, d).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.select("qid", "bucket", S.bucket_penalty([F.col(v) for v in VECTOR], F.col("bucket")).alias("penalty"))


def json_extract(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


def requests(spark, d, only: str | None = None) -> DataFrame:
    """qid and request: every transaction (or those of these orders) as JSON, four in ten of them damaged in different ways."""
    tx = A.transactions(spark, d, only)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.struct(
        F.concat(F.lit("tx-"), F.col("qid")).alias("id"), F.struct("amount", "installments", stamp(F.col("requested_at")).alias("requested_at")).alias("transaction"),
        F.struct("avg_amount", F.col("tx_count").alias("tx_count_24h"), "known_merchants").alias("customer"), F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", F.col("km_home").alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_at").isNotNull(), F.struct(stamp(F.col("last_at")).alias("timestamp"), F.col("km_last").alias("km_from_current"))).alias("last_transaction"),
    )
    text = F.to_json(body, {"ignoreNullFields": "false"})
    k = F.col("qid") % 10
    damaged = F.when(k == 1, F.lit("{bad")).when(k == 3, F.replace(text, F.lit('"last_transaction"'), F.lit('"earlier"'))).when(k == 5, F.replace(text, F.lit('"installments":'), F.lit('"installments":0.')))
    return tx.select("qid", damaged.when(k == 7, F.regexp_replace(text, '"requested_at":"[0-9]{4}', '"requested_at":"x')).otherwise(text).alias("request"))


def payload_fallback(spark, d):
    rows = parse_requests(requests(spark, d))
    return rows.select("qid", "is_fallback", *[F.when(~F.col("is_fallback"), F.col(c)).alias(c) for c in ("amount", "installments", "tx_count", "merchant_id", "km_last")], *[x.alias(n) for x, n in zip(respond(F.lit(5), F.col("is_fallback")), ("approved", "fraud_score"), strict=True)])


def knn_exact(spark, d):
    return near_embeddings(spark, d)[2]


def knn_vote(spark, d):
    queries, rows, found = near_embeddings(spark, d)
    return knn.votes(queries, found, rows)


def knn_kth_distance(spark, d):
    return near_embeddings(spark, d)[2].groupBy("qid").agg(F.max("d").alias("kth"))


def knn_empty_refs(spark, d):
    none = embeddings(spark, d).filter("rid < 0")
    queries, rows, found = near_embeddings(spark, d, refs=none)
    return knn.votes(queries, found, rows)


def knn_fewer_than_k(spark, d):
    few = embeddings(spark, d).filter("rid < 3")
    queries, rows, found = near_embeddings(spark, d, refs=few)
    return knn.votes(queries, found, rows)


def knn_tx(spark, d):
    rows = kept_vectors(spark, d)
    return knn.nearest(asked(rows), rows.withColumnRenamed("qid", "rid"), VECTOR, kept=True)


def coarse_candidates(spark, d):
    """Both sides quantised: the 64 nearest by the exact distance of what the codes stand for, which gives a missing last transaction its true cost."""
    codes = ix.values(ix.coded(kept_vectors(spark, d).withColumnRenamed("qid", "rid")))
    own = codes.filter(F.col("rid") % EVERY == 0).select(F.col("rid").alias("qid"), *VECTOR)
    return knn.nearest(own, codes, VECTOR, 64, kept=True).select("qid", "rid", "rank")


def systematic_sample(spark, d):
    return coded_sample(spark, d).select("rid", "bucket", "rn", "m")


def kmeans_seed(spark, d):
    return ix.seeds(coded_sample(spark, d), A.NLIST)


def kmeans_assign(spark, d):
    rows = coded_sample(spark, d)
    return ix.assign(rows, ix.Centroids(ix.seeds(rows, A.NLIST).collect())).select("rid", "bucket", "cell")


def kmeans_step(spark, d):
    rows = coded_sample(spark, d)
    return ix.means(ix.assign(rows, ix.Centroids(ix.seeds(rows, A.NLIST).collect())))


def kmeans_iterations(spark, d):
    """Three iterations of Lloyd's; a cell that loses all its rows keeps its centroid."""
    held = ix.fit_centroids(coded_sample(spark, d), A.NLIST, 3)
    return spark.createDataFrame(held.rows(), "bucket int, cell int, " + ", ".join(f"{v} double" for v in VECTOR))


def index_rows(spark, d):
    return index(spark, d).rows.select("rid", "bucket", "cell", "fraud")


def index_roundtrip(spark, d):
    """The index opened again from its files: metadata and centroids."""
    again = ix.Index(spark, index(spark, d).path)
    return again.centroids.select("bucket", "cell", "n", *VECTOR)


def ivf_probe_cells(spark, d):
    return search.probes(asked(kept_vectors(spark, d)), index(spark, d).centroids, A.NPROBE)


def ivf_topk(spark, d):
    return search.search(stored(asked(kept_vectors(spark, d)).select("qid", *VECTOR), "queries"), index(spark, d), A.NPROBE)


def ivf_all_cells(spark, d):
    return search.search(stored(asked(kept_vectors(spark, d)).select("qid", *VECTOR), "queries"), index(spark, d), A.NLIST).drop("fraud")


def ivf_recall(spark, d):
    """How many of the exact nearest neighbours, by the stored codes, a search of a few cells finds. What it finds bounds the exact search, which goes over all rows."""
    queries = stored(asked(kept_vectors(spark, d)).select("qid", *VECTOR), "queries")
    found = stored(search.search(queries, index(spark, d), A.NPROBE), "found")
    exact = search.exact_by_codes(queries, index(spark, d), search.summary(queries, found).select("qid", "kth")).select("qid", "rid")
    found = found.select("qid", "rid", F.lit(1).alias("hit"))
    return exact.join(found, ["qid", "rid"], "left").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"), (F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))


def search_max_scan(spark, d):
    return search.search(stored(asked(kept_vectors(spark, d)).select("qid", *VECTOR), "queries"), index(spark, d), A.NPROBE, max_scan=300).drop("fraud")


def rows_scanned(spark, d):
    return search.scanned(asked(kept_vectors(spark, d)), index(spark, d), A.NPROBE)


def escalation_gate(spark, d):
    queries = stored(asked(kept_vectors(spark, d)).select("qid", *VECTOR), "gate")
    got = search.summary(queries, search.search(queries, index(spark, d), A.NPROBE))
    return got.select("qid", "votes", search.escalates(CONFIG, F.col("votes"), F.col("kth")).alias("by_margin"), search.escalates(SearchConfig(margin=-1, radius=0.1), F.col("votes"), F.col("kth")).alias("by_radius"))


def two_tier(spark, d):
    return search.two_tier(asked(kept_vectors(spark, d)), index(spark, d), CONFIG)


def two_tier_per_vote(spark, d):
    """The same with probes of the high pass by the cheap vote."""
    return search.two_tier(asked(kept_vectors(spark, d)), index(spark, d), replace(CONFIG, high_for_votes=A.HIGH_FOR_VOTES))


def work_percentiles(spark, d):
    """Rows scanned a query: median, 99th percentile and most."""
    return evaluate.index_percentiles(rows_scanned(spark, d), "rows_scanned", [50.0, 99.0, 100.0])


def judged(spark, d) -> DataFrame:
    queries = stored(asked(kept_vectors(spark, d)), "judged")
    return search.two_tier(queries, index(spark, d), CONFIG).join(queries.select("qid", (~F.col("fraud")).alias("expected_approved")), "qid").join(search.scanned(queries, index(spark, d), A.NPROBE_HIGH), "qid")


def confusion(spark, d):
    return evaluate.confusion(judged(spark, d))


def detection_score(spark, d):
    return evaluate.confusion(judged(spark, d)).select(F.round(evaluate.detection_score(F.col("e"), F.col("eps")), 6).alias("score"))


def vote_breakdown(spark, d):
    return evaluate.vote_breakdown(judged(spark, d))


def index_percentile(spark, d):
    return evaluate.index_percentiles(spark.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", [0.0, 50.0, 90.0, 99.0, 100.0])


def approx_vs_exact(spark, d):
    """Every row is a query here, not only those of asked()."""
    rows = kept_vectors(spark, d)
    queries, refs = rows.select("qid", *VECTOR), rows.withColumnRenamed("qid", "rid")
    cheap = search.cheap_pass(queries, index(spark, d), CONFIG)
    exact = search.summary(queries, search.exact(queries, refs, index(spark, d), cheap.select("qid", "kth")))
    return evaluate.compare_scores(search.two_tier(queries, index(spark, d), CONFIG, cheap), exact)


def score_batch(spark, d):
    """Requests scored from their JSON on, those of the query set."""
    return score_requests(requests(spark, d, ASKED), index(spark, d), *load_constants(), CONFIG)


def score_stream(spark, d):
    """The same through a stream of files."""
    at, batches = work_dir(spark), []
    requests(spark, d, ASKED).repartition(4).write.json(f"{at}/in")
    query = start(spark, f"{at}/in", index(spark, d), *load_constants(), lambda df, k: (df.write.mode("overwrite").parquet(f"{at}/out/batch={k}"), batches.append(k)), f"{at}/checkpoint", CONFIG)
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vectorize_tx, time_features, last_tx_sentinel, unknown_merchant, mcc_lookup, clamp_values, quantize, dequantize_roundtrip, bucket_of, bucket_histogram, bucket_penalty,
        json_extract, payload_fallback, knn_exact, knn_vote, knn_kth_distance, knn_empty_refs, knn_fewer_than_k, knn_tx, coarse_candidates, systematic_sample, kmeans_seed,
        kmeans_assign, kmeans_step, kmeans_iterations, index_rows, index_roundtrip, ivf_probe_cells, ivf_topk, ivf_recall, ivf_all_cells, search_max_scan, rows_scanned, escalation_gate, two_tier, two_tier_per_vote, work_percentiles,
        confusion, detection_score, vote_breakdown, index_percentile, approx_vs_exact, score_batch, score_stream,
    )
}
