"""What keeps the index queries small at size: narrow windows, vectors computed once, runs of rows passed over."""

from pathlib import Path

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from nearledger.config import DIMS
from nearledger.functions import scalars as S
from nearledger.operators import index as ix, knn, search
from nearledger.operators.vectorize import VECTOR
from nearledger.plans import adapters, queries
from nearledger.sources import store

from .test_scoring import vectors

ORDERS = "1 AS o_orderkey, 2 AS o_custkey, 3.5D AS o_totalprice, timestamp_ntz'1995-01-01 00:00:00' AS o_orderdate"


def test_windows_stand_on_narrow_rows(spark, tmp_path):
    spark.range(1).selectExpr(*ORDERS.split(", ")).write.parquet(f"file://{tmp_path}/orders.parquet")
    plan = adapters.vectors(spark, f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Window [") :]
    assert "o_custkey" in below and "array(" not in below and "concat(" not in below


def test_vectors_are_computed_once(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.range(400).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey", "id * 7.5D AS o_totalprice", "timestamp_ntz'1995-01-01 00:00:00' AS o_orderdate").write.parquet(f"{d}/orders.parquet")
    n = len(store.MADE)
    queries.two_tier(spark, d).collect()
    queries.knn_tx(spark, d).collect()
    assert sum("/all-vectors-" in at for at in store.MADE[n:]) == 1 and not any("/references-" in at for at in store.MADE[n:])


def test_rows_of_probed_cells_are_searched_exactly(spark, tmp_path):
    """Cells of many runs and equal distances, against a plain search of the same cells."""
    refs = vectors(spark, 6000, 8, "rid").select((F.col("rid") * 3 + 1).alias("rid"), *[F.round(v, 1).alias(v) for v in VECTOR], "fraud")
    asked = vectors(spark, 300, 9, "qid").select("qid", *[F.round(v, 1).alias(v) for v in VECTOR])
    index = ix.build_index(refs, f"file://{tmp_path}/index", nlist=2, iters=1, sample=50)
    rows, cells = ix.values(index.rows).toPandas(), search.probes(asked, index.centroids, 1).filter("home").toPandas()
    got = search.candidates(asked, search.probes(asked, index.centroids, 1, True), index, 1).toPandas()
    place = {q: (b, c) for q, b, c in zip(cells.qid, cells.bucket, cells.cell, strict=True)}
    for q in asked.collect():
        own = rows[(rows.bucket == place[q.qid][0]) & (rows.cell == place[q.qid][1])]
        d = sum((own[v].to_numpy() - q[v]) ** 2 for v in VECTOR)
        want = [int(own.rid.to_numpy()[i]) for i in np.lexsort((own.rid, d))[:5]]
        mine = got[got.qid == q.qid].sort_values(["d", "rid"]).rid.tolist()[:5]
        assert mine == want


def test_reach_of_some_queries():
    best = knn.Best(np.arange(10.0)[:, None] * np.ones((1, DIMS)), 5, np.full(10, 1.0))
    assert best.reach(np.full(DIMS, 4.0), np.full(DIMS, 5.0), np.array([0, 5, 9])).tolist() == [5]


def test_places_in_buckets(spark, tmp_path):
    codes = spark.range(0, 5000, 1, 7).select((F.hash("id") * F.lit(1)).cast("long").alias("rid"), F.when(F.col("id") % 10 == 3, 5).otherwise(2).alias("bucket"))
    got = ix.ranked(codes, f"file://{tmp_path}/ranked").toPandas().sort_values("rid")
    for _, own in got.groupby("bucket"):
        assert own.rn.tolist() == list(range(len(own))) and set(own.m) == {len(own)}


def near_the_grid(spark, n, seed, key):
    """Vectors between the codes, many of them equal or nearer to one another than a code tells."""
    few = vectors(spark, max(1, n // 20), seed, "k")
    rows = spark.range(n).select(F.col("id").alias(key), (F.col("id") % max(1, n // 20)).alias("k")).join(few, "k")
    return rows.select(key, *[F.when(F.col(v) < 0, F.col(v)).otherwise(F.least(F.col(v) + (F.col(key) % 3) * 1e-6, F.lit(1.0))).alias(v) if i not in (9, 10, 11) else v for i, v in enumerate(VECTOR)], "fraud")


def test_exact_search_through_the_index(spark, tmp_path):
    """Against a plain search by the vectors, also where 20 rows have one code, where a bound doesn't hold and where there is none."""
    near_the_grid(spark, 4000, 5, "rid").unionByName(vectors(spark, 2000, 6, "rid").withColumn("rid", F.col("rid") + 10_000)).write.parquet(f"file://{tmp_path}/refs")
    refs = spark.read.parquet(f"file://{tmp_path}/refs")
    asked = refs.filter("rid % 50 = 0").withColumnRenamed("rid", "qid").select("qid", *VECTOR)
    index = ix.build_index(refs, f"file://{tmp_path}/index", nlist=4, iters=1, sample=50)
    kth = search.summary(asked, search.search(asked, index, 1)).select("qid", F.when(F.col("qid") % 3 == 0, F.lit(1e-12)).when(F.col("qid") % 3 == 1, F.col("kth")).alias("kth"))
    rows = lambda df: sorted((r.qid, r["rank"], r.rid, r.d) for r in df.collect())
    got = search.exact(asked, refs, index, kth)
    assert rows(got) == rows(knn.nearest_pairs(asked, refs, VECTOR))
    fraud = {r.rid: r.fraud for r in refs.select("rid", "fraud").collect()}
    assert all(r.fraud == fraud[r.rid] for r in got.collect())
    good = search.summary(asked, search.search(asked, index, 1)).select("qid", "kth")
    assert rows(search.exact_by_codes(asked, index, good)) == rows(knn.nearest_pairs(asked, ix.values(index.rows), VECTOR))


def test_exact_neighbours_come_from_the_index(spark, tmp_path):
    """No second ordered copy of all rows is written for them, nor one of their codes."""
    d = f"file://{tmp_path}"
    spark.range(3000).selectExpr("id AS o_orderkey", "id % 300 AS o_custkey", "id * 7.5D AS o_totalprice", "timestamp_ntz'1995-01-01 00:00:00' AS o_orderdate").write.parquet(f"{d}/orders.parquet")
    n = len(store.MADE)
    assert queries.approx_vs_exact(spark, d).first().n == 3000 and queries.ivf_recall(spark, d).first().n == 150
    assert not any("/leaves-" in at for at in store.MADE[n:])
    assert not any(Path(at.removeprefix("file://"), "codes").exists() for at in store.MADE[n:])


def test_scores_of_every_row_are_compared(spark, tmp_path):
    """None of these ids is divisible by 100."""
    d = f"file://{tmp_path}"
    spark.range(1, 90).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey", "id * 7.5D AS o_totalprice", "timestamp_ntz'1995-01-01 00:00:00' AS o_orderdate").write.parquet(f"{d}/orders.parquet")
    assert queries.approx_vs_exact(spark, d).first().n == 89


def test_second_pass_is_bounded_by_the_first(spark, tmp_path):
    """A search whose queries have bounds draws no sample, and finds the same."""
    refs, asked = vectors(spark, 3000, 3, "rid"), vectors(spark, 60, 4, "qid").select("qid", *VECTOR)
    index = ix.build_index(refs, f"file://{tmp_path}/index", nlist=4, iters=1, sample=50)
    first, home = search.searched(asked, index, 1)
    want = sorted(search.search(asked, index, 3).select("qid", "rid", "d", "rank").collect())
    again = ix.Index(spark, index.path)
    got = search.candidates(asked.join(home.filter("kth is not null"), "qid"), search.probes(asked.join(home.filter("kth is not null"), "qid"), again.centroids, 3, True), again, 3)
    assert got.count() and again.some is None
    assert sorted(search.search(asked.join(home, "qid", "left"), index, 3).select("qid", "rid", "d", "rank").collect()) == want


def test_requests_of_some_orders(spark, tmp_path):
    """Windows run over the orders of the customers asked for alone."""
    d = f"file://{tmp_path}"
    spark.range(3000).selectExpr("id AS o_orderkey", "id * 7 % 290 AS o_custkey", "id * 7.5D AS o_totalprice", "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast(id % 5 AS int)) AS o_orderdate").write.parquet(f"{d}/orders.parquet")
    got = queries.requests(spark, d, queries.ASKED)
    assert sorted(got.collect()) == sorted(queries.asked(queries.requests(spark, d)).collect()) and got.count() == 30
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.rindex("Window [") :]


def test_codes_round_half_up(spark):
    k = np.arange(0, 10_000, 37)
    y = np.concatenate([(k + 0.5) / 10000, np.nextafter((k + 0.5) / 10000, 0), np.nextafter((k + 0.5) / 10000, 1), np.random.default_rng(2).random(5000), [0.0, 1.0, 1.5, -1.0, 5e-5]])
    x = F.col("x")
    rounded = F.when(x < 0, F.lit(0)).otherwise(F.round(F.least(x, F.lit(1.0)) * F.lit(10000.0)).cast("int") + 1)
    rows = spark.createDataFrame([(float(v),) for v in y], "x double").select(S.quantize(x).alias("got"), rounded.alias("want"))
    assert rows.filter("got <> want").isEmpty()
    plain = np.array([r.got for r in rows.select("got").collect()])
    assert (ix.codes_of(np.column_stack([y] * DIMS))[0] == plain[:, None]).all()


def test_vectors_are_coded_as_by_expressions(spark, tmp_path):
    """Where they are assigned to cells, with one that is not a number."""
    refs = near_the_grid(spark, 2000, 5, "rid").withColumn("d2", F.when(F.col("rid") == 7, F.lit(float("nan"))).otherwise(F.col("d2")))
    held = ix.Centroids(ix.seeds(ix.coded(refs).withColumns({"rn": F.row_number().over(Window.partitionBy("bucket").orderBy("rid")) - 1, "m": F.count(F.lit(1)).over(Window.partitionBy("bucket"))}), 4).collect())
    assert sorted(ix.assign(refs, held, raw=True).collect()) == sorted(ix.assign(ix.coded(refs), held).collect())
