import json
import math
import random

import pytest
from pyspark.sql import functions as F

from nearledger.config import SearchConfig, load_constants
from nearledger.functions import scalars as S
from nearledger.operators import evaluate, index as ix, knn, search
from nearledger.operators.vectorize import VECTOR, vectorize
from nearledger.sources.payloads import parse_requests, read_evaluation, read_references
from nearledger.streaming.scoring import score_requests

#: Requests of the published format and their expected vectors (test_golden_vectors).
LEGIT = {
    "id": "tx-1329056812", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]}, "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None,
}
FRAUD = {
    "id": "tx-3330991687", "transaction": {"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
    "customer": {"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008", "MERC-007", "MERC-005"]}, "merchant": {"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 952.27}, "last_transaction": None,
}
LAST = LEGIT | {
    "transaction": {"amount": 100, "installments": 1, "requested_at": "2026-03-11T12:00:00Z"}, "merchant": {"id": "MERC-001", "mcc": "9999", "avg_amount": 100},
    "terminal": {"is_online": True, "card_present": False, "km_from_home": 10}, "last_transaction": {"timestamp": "2026-03-11T11:00:00Z", "km_from_current": 500},
}


def requests(spark, *payloads):
    return spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "qid long, request string")


def vectors(spark, n, seed, name):
    """Random vectors in the shape that transactions have."""
    r, rows = random.Random(seed), []
    for i in range(n):
        none = r.random() < 0.3
        u = lambda: round(r.random(), 4)
        v = [u(), r.randrange(13) / 12, u(), r.randrange(24) / 23, r.randrange(7) / 6, -1.0 if none else u(), -1.0 if none else u(), u(), r.randrange(21) / 20, *[float(r.random() < 0.5) for _ in range(3)], r.choice([0.15, 0.25, 0.3, 0.45, 0.5, 0.75, 0.85]), u()]
        rows.append((i, *[round(x, 4) for x in v], r.random() < 0.44))
    return spark.createDataFrame(rows, f"{name} long, " + ", ".join(f"{v} double" for v in VECTOR) + ", fraud boolean")


def test_golden_vectors(spark):
    rows = vectorize(parse_requests(requests(spark, LEGIT, FRAUD, LAST)), *load_constants()).orderBy("qid").collect()
    want = [
        [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006],
        [0.9506, 0.8333, 1.0, 0.2174, 0.8333, -1, -1, 0.9523, 1.0, 0, 1, 1, 0.75, 0.0055],
    ]
    for row, w in zip(rows, want, strict=False):
        assert [row[v] for v in VECTOR] == pytest.approx(w, abs=1e-3)
    last = rows[2]
    assert (last.d5, last.d6, last.d9, last.d10, last.d12) == (pytest.approx(60 / 1440), 0.5, 1.0, 0.0, 0.5)


def test_bad_requests_fall_back(spark):
    no_key = {k: v for k, v in LEGIT.items() if k != "last_transaction"}
    bad_time = LEGIT | {"transaction": LEGIT["transaction"] | {"requested_at": "yesterday, early in the day"}}
    text_number = LEGIT | {"transaction": LEGIT["transaction"] | {"installments": 1.5}}
    rows = requests(spark, LEGIT, "{bad", no_key, bad_time, text_number, "", "[]")
    assert [r.is_fallback for r in parse_requests(rows).orderBy("qid").collect()] == [False] + [True] * 6
    lenient = parse_requests(rows, lenient=True).orderBy("qid").collect()
    assert [r.is_fallback for r in lenient[:5]] == [False, True, False, False, False]
    assert str(lenient[3].requested_at) == "0001-01-01 00:00:00"


def test_stamps_roll_over_and_ignore_offsets(spark):
    cases = {
        "2026-03-11T18:45:53Z": "2026-03-11 18:45:53", "2026-03-11T18:45:53.250+02:00": "2026-03-11 18:45:53", "2025-13-32T25:61:61Z": "2026-02-02 02:02:01",
        "2026-00-01T00:00:00Z": None, "2026-01-00T00:00:00Z": None, "2026-01-01T00:00:0Z": None, "2026/01/01T00:00:00Z": None, "": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", S.parse_stamp(F.col("s")).cast("string").alias("t")).collect()
    assert {r.s: r.t for r in got} == cases


def test_scalars(spark):
    x = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,), (0.49999999999999994,), (0.00005,)], "x double")
    assert [r[0] for r in x.select(S.quantize(F.col("x"))).collect()] == [0, 1, 10001, 10001, 5001, 2]
    assert [r[0] for r in x.select(S.dequantize(S.quantize(F.col("x")))).collect()][:4] == [-1.0, 0.0, 1.0, 1.0]
    y = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double").select(S.clamp(S.divide(F.col("a"), F.col("b"))).alias("c")).collect()
    assert [y[0].c, y[1].c, y[3].c] == [1.0, 0.0, 0.25] and math.isnan(y[2].c)


def test_arrow_and_expression_neighbours_agree(spark):
    refs, queries = vectors(spark, 900, 1, "rid"), vectors(spark, 40, 2, "qid")
    a = knn.nearest(queries, refs, VECTOR).orderBy("qid", "rank").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in knn.nearest_pairs(queries, refs, VECTOR).select("qid", "rid", "d", "rank").orderBy("qid", "rank").collect()]


def test_votes_at_the_threshold(spark):
    queries = spark.createDataFrame([(0,), (1,)], "qid long")
    refs = spark.createDataFrame([(i, i < 3) for i in range(5)], "rid long, fraud boolean")
    found = spark.createDataFrame([(0, i) for i in range(5)] + [(1, 3), (1, 4)], "qid long, rid long")
    got = {r.qid: (r.votes, r.fraud_score, r.approved) for r in knn.votes(queries, found, refs).collect()}
    assert got == {0: (3, 0.6, False), 1: (0, 0.0, True)}


def test_missing_last_transactions_do_not_crowd_out(spark):
    q = [0.5] * 5 + [0.3, 0.3] + [0.5, 0.5] + [0.0, 0.0, 0.0] + [0.5, 0.5]
    near = [0.0 if i in (0, 2, 7, 13) else x for i, x in enumerate(q)]
    null = [-1.0 if i in (5, 6) else x for i, x in enumerate(q)]
    schema = ", ".join(f"{v} double" for v in VECTOR)
    refs = spark.createDataFrame([(i, *near, True) for i in range(5)] + [(5 + i, *null, False) for i in range(64)], f"rid long, {schema}, fraud boolean")
    queries = spark.createDataFrame([(0, *q)], f"qid long, {schema}")
    assert knn.votes(queries, knn.nearest(queries, refs, VECTOR), refs).first().fraud_score == 1.0


def test_index(spark, tmp_path):
    refs, queries = vectors(spark, 1500, 3, "rid"), vectors(spark, 60, 4, "qid")
    index = ix.build_index(refs, f"file://{tmp_path}/index", nlist=4, iters=2, sample=60)
    exact = knn.nearest(queries, refs, VECTOR).select("qid", "rid", "d", "rank")
    found = search.search(queries, index, 4).select("qid", "rid", "d", "rank")
    key = lambda rows: sorted((r.qid, r.rank, r.rid, r.d) for r in rows.collect())
    assert key(found) == key(exact)
    again = ix.open_or_build(spark, f"file://{tmp_path}/index", lambda: pytest.fail("there is an index"))
    assert (again.n, again.nlist) == (1500, 4)
    truth = {r.qid: r.votes for r in knn.votes(queries, exact, refs).collect()}
    tiers = search.two_tier(queries, again, SearchConfig(nprobe=1, nprobe_high=4, margin=5)).collect()
    assert {r.qid: r.votes for r in tiers} == truth and all(r.escalated for r in tiers)
    assert not any(r.escalated for r in search.two_tier(queries, again, SearchConfig(nprobe=1, nprobe_high=0)).collect())


def test_what_is_no_index_is_refused(spark, tmp_path):
    spark.range(1).selectExpr("99 AS version", "14 AS dims", "5 AS k", "1 AS nlist", "0L AS n").write.parquet(f"file://{tmp_path}/bad/meta")
    with pytest.raises(ValueError):
        ix.Index(spark, f"file://{tmp_path}/bad")


def test_empty_index_approves(spark, tmp_path):
    index = ix.build_index(vectors(spark, 1, 5, "rid").filter("rid < 0"), f"file://{tmp_path}/none", nlist=4, iters=1)
    got = score_requests(requests(spark, LEGIT, "{bad"), index, *load_constants()).orderBy("qid").collect()
    assert [(r.approved, r.fraud_score, r.is_fallback) for r in got] == [(True, 0.0, False), (True, 0.0, True)]


def test_json_sources(spark, tmp_path):
    import gzip

    rows = [{"vector": [0.1] * 14, "label": "fraud"}, {"vector": [0.2] * 14, "label": "legit"}]
    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        json.dump(rows, f)
    got = read_references(spark, str(tmp_path / "refs.json.gz"), 2).orderBy("rid").collect()
    assert [(r.d0, r.d13, r.fraud) for r in got] == [(0.1, 0.1, True), (0.2, 0.2, False)]
    (tmp_path / "short.json").write_text(json.dumps([{"vector": [0.1] * 3, "label": "fraud"}]))
    with pytest.raises(Exception, match="14 numbers"):
        read_references(spark, str(tmp_path / "short.json")).collect()
    (tmp_path / "eval.json").write_text(json.dumps({"entries": [{"request": LEGIT, "expected_approved": True}]}))
    entries = read_evaluation(spark, str(tmp_path / "eval.json"))
    assert not parse_requests(entries).first().is_fallback
    absent = {k: v for k, v in LEGIT.items() if k != "last_transaction"}
    (tmp_path / "absent.json").write_text(json.dumps({"entries": [{"request": absent, "expected_approved": True}]}))
    assert parse_requests(read_evaluation(spark, str(tmp_path / "absent.json"))).first().is_fallback


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SORTED", 50)
    monkeypatch.setattr(evaluate, "PARTS", 8)
    r = random.Random(6)
    x = [r.choice([r.random() * 1e6, 5.0, -3.0]) for _ in range(1000)]
    rows = spark.createDataFrame([(v,) for v in x], "x double")
    for p in (0, 1, 50, 99, 100):
        assert evaluate.order_statistic(rows, "x", p) == sorted(x)[min(999, 1000 * p // 100)]
    assert evaluate.order_statistic(rows.filter("x is null"), "x", 50) is None


def test_scores():
    assert evaluate.load_score(0, 0, 0, 100, 1.0) == pytest.approx(6000)
    assert evaluate.load_score(20, 0, 0, 100, 2500) == -6000
    assert SearchConfig.from_options({"nprobe": "x", "radius": "0.5"}) == SearchConfig(radius=0.5)
    assert SearchConfig.clamp(10_000, 4096) == 512 and SearchConfig(high_for_votes={3: 7}).high(3, 64) == 7


def test_scratch_tables_go_and_a_cleared_index_is_built_again(spark):
    from nearledger.plans import queries
    from nearledger.sources import store

    n = len(store.MADE)
    with store.scratch(spark):
        store.stored(spark.range(3), "a")
        assert len(store.MADE) == n + 1
    assert len(store.MADE) == n
    built = []
    make = lambda: (store.work_dir(spark), built.append(1))
    for _ in range(2):
        queries._built("test", spark, "x", make)
    assert len(built) == 1
    store.MADE.remove(queries.BUILT["test", id(spark), "x"][0])
    queries._built("test", spark, "x", make)
    assert len(built) == 2


def test_stored_tables_can_be_cleared(spark):
    from pathlib import Path

    from nearledger.sources import store

    rows = store.stored(spark.range(5), "clear")
    at = Path(store.MADE[-1].removeprefix("file://"))
    assert rows.count() == 5 and at.exists()
    kept, store.MADE[:] = store.MADE[:-1], store.MADE[-1:]
    store.clear(spark)
    store.MADE[:] = kept
    assert not at.exists()
