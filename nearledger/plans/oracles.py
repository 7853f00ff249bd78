"""SQL of the engine's queries."""

from __future__ import annotations

from .adapters import BUCKET, BUCKET_Q, CODED, HIGH_FOR_VOTES, INDEXED, NLIST, NPROBE, NPROBE_HIGH, PENALTY, RISK, SAMPLED, TX, VEC, D, assigned, centroid_means, distance, searched

C = ", ".join(f"c{i}" for i in range(14))


def _embeddings(refs: str = "true", k: int = 5) -> str:
    d = "list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, len(q.embedding) + 1), lambda i: (r.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (r.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))), lambda x, y: x + y)"
    return f"""near AS (SELECT q.vec_id AS qid, r.vec_id AS rid, {d} AS d, r.label < 4 AS fraud FROM embeddings q JOIN (SELECT * FROM embeddings WHERE {refs}) r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rank FROM near QUALIFY rank <= {k}),
asked AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 100 = 0)"""


def _votes(of: str = "nn", asked: str = "asked") -> str:
    return f"""SELECT a.qid, CAST(coalesce(v, 0) AS INTEGER) AS votes, coalesce(v, 0) / 5.0::DOUBLE AS fraud_score, coalesce(v, 0) < 3 AS approved
FROM {asked} a LEFT JOIN (SELECT qid, count(*) FILTER (fraud) AS v FROM {of} GROUP BY qid) n ON n.qid = a.qid"""


CHEAP = f"""{INDEXED}, {searched('cheap', str(NPROBE))}, summed AS (SELECT q.qid, coalesce(v, 0) AS votes, CASE WHEN n >= 5 THEN k END AS kth FROM q LEFT JOIN (SELECT qid, count(*) FILTER (fraud) AS v, count(*) AS n, max(d) AS k FROM cheap GROUP BY qid) c ON c.qid = q.qid)"""
TIERS = f"""{CHEAP}, again AS (SELECT q.* FROM q JOIN summed s ON s.qid = q.qid WHERE abs(votes - 3) <= 1), {searched('high', str(NPROBE_HIGH), 'again')},
tiers AS (SELECT s.qid, CAST(s.votes AS INTEGER) AS cheap_votes, abs(s.votes - 3) <= 1 AS escalated, CAST(CASE WHEN abs(s.votes - 3) <= 1 THEN coalesce(h.v, 0) ELSE s.votes END AS INTEGER) AS votes
  FROM summed s LEFT JOIN (SELECT qid, count(*) FILTER (fraud) AS v FROM high GROUP BY qid) h ON h.qid = s.qid)"""
PER_VOTE = f"""{CHEAP}, again AS (SELECT q.*, CASE s.votes {' '.join(f'WHEN {v} THEN {n}' for v, n in HIGH_FOR_VOTES.items())} ELSE {NPROBE_HIGH} END AS np FROM q JOIN summed s ON s.qid = q.qid WHERE abs(votes - 3) <= 1), {searched('high', 'q.np', 'again')},
tiers AS (SELECT s.qid, CAST(s.votes AS INTEGER) AS cheap_votes, abs(s.votes - 3) <= 1 AS escalated, CAST(CASE WHEN abs(s.votes - 3) <= 1 THEN coalesce(h.v, 0) ELSE s.votes END AS INTEGER) AS votes
  FROM summed s LEFT JOIN (SELECT qid, count(*) FILTER (fraud) AS v FROM high GROUP BY qid) h ON h.qid = s.qid)"""


def _iterated(n: int) -> str:
    """Views cent1 to cent<n>: centroids after each iteration over the sample."""
    out = []
    for k in range(n):
        old = f"cent{k}" if k else "seed"
        out.append(f"{assigned('sample', old, f'it{k}')}, moved{k} AS ({centroid_means(f'it{k}')}), cent{k + 1} AS (SELECT s.bucket, s.cell, {', '.join(f'coalesce(m.d{i}, s.d{i}) AS d{i}' for i in range(14))} FROM {old} s LEFT JOIN moved{k} m USING (bucket, cell))")
    return ", ".join(out)


SCAN = "scan AS (SELECT qid, CAST(sum(n) AS BIGINT) AS rows_scanned, count(*) AS cells FROM cellrank WHERE place < {} GROUP BY qid)"
JUDGED = f"""{TIERS}, {SCAN.format(NPROBE_HIGH)}, judged AS (SELECT t.*, t.votes < 3 AS approved, NOT q.fraud AS expected_approved, rows_scanned FROM tiers t JOIN q ON q.qid = t.qid JOIN scan ON scan.qid = t.qid),
conf AS (SELECT count(*) AS n, count(*) FILTER (NOT approved AND expected_approved) AS fp, count(*) FILTER (approved AND NOT expected_approved) AS fn FROM judged),
conf2 AS (SELECT *, fp + 3 * fn AS e, (fp + 3 * fn) / n AS eps, (fp + fn) / n AS fail FROM conf)"""
EXACT = f"exact AS (SELECT q.qid, v.qid AS rid, {distance('q', 'v')} AS d, v.fraud, row_number() OVER (PARTITION BY q.qid ORDER BY {distance('q', 'v')}, v.qid) AS rank FROM (SELECT * FROM vec WHERE qid % 100 = 0) q, vec v QUALIFY rank <= 5)"
QEXACT = EXACT.replace("exact AS (SELECT q.qid, v.qid AS rid", "exactv AS (SELECT q.qid, v.rid").replace("v.qid) AS rank", "v.rid) AS rank").replace(", vec v QUALIFY", ", val v QUALIFY")
TX_OK = "q.qid % 10 NOT IN (1, 3, 5, 7)"
SCORED = f"WITH {TIERS} SELECT q.qid, NOT ({TX_OK}) AS is_fallback, CASE WHEN {TX_OK} THEN t.votes ELSE 0 END < 3 AS approved, CASE WHEN {TX_OK} THEN t.votes ELSE 0 END / 5.0::DOUBLE AS fraud_score FROM q JOIN tiers t ON t.qid = q.qid"
ANSWER = "qid, {0} AS votes, {0} / 5.0::DOUBLE AS fraud_score, {0} < 3 AS approved"

ORACLES: dict[str, str] = {
    "vectorize_tx": f"WITH {VEC} SELECT qid, {D}, fraud FROM vec",
    "time_features": f"WITH {TX} SELECT qid, hour(requested_at)::DOUBLE / 23::DOUBLE AS hour, (isodow(requested_at) - 1)::DOUBLE / 6::DOUBLE AS weekday FROM tx",
    "last_tx_sentinel": f"WITH {VEC} SELECT d5 < 0 AS no_last, count(*) AS n, min(d5) AS least_d5, max(d6) AS most_d6 FROM vec GROUP BY 1",
    "unknown_merchant": f"WITH {TX} SELECT qid, NOT list_contains(known_merchants, merchant_id) AS unknown FROM tx",
    "mcc_lookup": f"WITH {TX} SELECT qid, mcc, {RISK} AS risk FROM tx",
    "clamp_values": "WITH x AS (SELECT o_orderkey, o_totalprice / 100000 - 1 AS x, o_orderkey % 3 AS y FROM orders), z AS (SELECT *, CASE WHEN y = 0 THEN CASE WHEN x > 0 THEN 1 WHEN x < 0 THEN 0 END ELSE x / y END AS z FROM x) SELECT o_orderkey, CAST(CASE WHEN x < 0 THEN 0 WHEN x > 1 THEN 1 ELSE x END AS DOUBLE) AS clamped, CAST(CASE WHEN z < 0 THEN 0 WHEN z > 1 THEN 1 ELSE z END AS DOUBLE) AS divided FROM z",
    "quantize": f"WITH {CODED} SELECT rid, {C} FROM code",
    "dequantize_roundtrip": f"WITH {CODED} SELECT rid AS qid, {D}, true AS same_d0, true AS same_d5 FROM val",
    "bucket_of": f"WITH {VEC} SELECT qid, {BUCKET} AS bucket FROM vec",
    "bucket_histogram": f"WITH {CODED} SELECT bucket, n, CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT bucket, count(*) AS n FROM code GROUP BY bucket)",
    "bucket_penalty": f"WITH {VEC} SELECT qid, bucket, CAST({PENALTY} AS DOUBLE) AS penalty FROM vec q, (SELECT CAST(unnest(range(16)) AS INTEGER) AS bucket)",
    "json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "payload_fallback": f"""WITH {TX} SELECT qid, NOT ok AS is_fallback, CASE WHEN ok THEN amount END AS amount, CASE WHEN ok THEN installments END AS installments, CASE WHEN ok THEN tx_count END AS tx_count,
      CASE WHEN ok THEN merchant_id END AS merchant_id, CASE WHEN ok THEN km_last END AS km_last, NOT ok AS approved, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fraud_score FROM (SELECT *, qid % 10 NOT IN (1, 3, 5, 7) AS ok FROM tx)""",
    "knn_exact": f"WITH {_embeddings()} SELECT qid, rid, d, CAST(rank AS INTEGER) AS rank FROM nn",
    "knn_vote": f"WITH {_embeddings()} {_votes()}",
    "knn_kth_distance": f"WITH {_embeddings()} SELECT qid, max(d) AS kth FROM nn GROUP BY qid",
    "knn_empty_refs": f"WITH {_embeddings('false')} {_votes()}",
    "knn_fewer_than_k": f"WITH {_embeddings('vec_id < 3')} {_votes()}",
    "knn_tx": f"WITH {VEC}, {EXACT} SELECT qid, rid, d, CAST(rank AS INTEGER) AS rank FROM exact",
    "coarse_candidates": f"WITH {CODED} SELECT qid, rid, CAST(rank AS INTEGER) AS rank FROM (SELECT q.rid AS qid, v.rid, row_number() OVER (PARTITION BY q.rid ORDER BY {distance('q', 'v')}, v.rid) AS rank FROM val q, val v WHERE q.rid % 100 = 0 QUALIFY rank <= 64)",
    "systematic_sample": f"WITH {SAMPLED} SELECT rid, bucket, rn, m FROM sample",
    "kmeans_seed": f"WITH {SAMPLED} SELECT * FROM seed",
    "kmeans_assign": f"WITH {SAMPLED}, {assigned('sample', 'seed', 'step0')} SELECT rid, bucket, cell FROM step0",
    "kmeans_step": f"WITH {SAMPLED}, {assigned('sample', 'seed', 'step0')} {centroid_means('step0')}",
    "index_rows": f"WITH {INDEXED} SELECT rid, bucket, cell, fraud FROM rows",
    "index_roundtrip": f"WITH {INDEXED} SELECT bucket, cell, n, {D} FROM cent",
    "ivf_probe_cells": f"WITH {INDEXED} SELECT qid, bucket, cell, CAST(place AS INTEGER) AS place, CAST(penalty AS DOUBLE) AS penalty, home FROM cellrank WHERE place < {NPROBE}",
    "ivf_topk": f"WITH {INDEXED}, {searched('s', str(NPROBE))} SELECT qid, rid, d, fraud, CAST(rank AS INTEGER) AS rank FROM s",
    "ivf_recall": f"WITH {INDEXED}, {QEXACT}, {searched('s', str(NPROBE))} SELECT count(*) AS n, count(s.rid) AS found, count(s.rid) / count(*) AS recall FROM exactv e LEFT JOIN s ON s.qid = e.qid AND s.rid = e.rid",
    "two_tier_per_vote": f"WITH {PER_VOTE} SELECT cheap_votes, escalated, {ANSWER.format('votes')} FROM tiers",
    "work_percentiles": f"WITH {INDEXED}, {SCAN.format(NPROBE)}, s AS (SELECT list_sort(list(rows_scanned)) AS a FROM scan), p AS (SELECT unnest([50, 99, 100])::DOUBLE AS percent) SELECT percent, a[least(len(a) - 1, CAST(floor(len(a) * percent / 100) AS BIGINT)) + 1]::DOUBLE AS value FROM s, p",
    "kmeans_iterations": f"WITH {SAMPLED}, {_iterated(3)} SELECT bucket, cell, {D} FROM cent3",
    "ivf_all_cells": f"WITH {INDEXED}, {QEXACT} SELECT qid, rid, d, CAST(rank AS INTEGER) AS rank FROM exactv",
    "search_max_scan": f"WITH {INDEXED}, cut AS (SELECT qid, bucket, cell FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY home DESC, bucket, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cellrank WHERE place < {NPROBE}) WHERE b < 300), {searched('s', str(NPROBE)).replace('sp AS (SELECT r.* FROM cellrank r JOIN q q', 'sp AS (SELECT r.* FROM cellrank r JOIN cut USING (qid, bucket, cell) JOIN q q')} SELECT qid, rid, d, CAST(rank AS INTEGER) AS rank FROM s",
    "rows_scanned": f"WITH {INDEXED}, {SCAN.format(NPROBE)} SELECT * FROM scan",
    "escalation_gate": f"WITH {CHEAP} SELECT qid, CAST(votes AS INTEGER) AS votes, abs(votes - 3) <= 1 AS by_margin, coalesce(kth >= 0.1, true) AS by_radius FROM summed",
    "two_tier": f"WITH {TIERS} SELECT cheap_votes, escalated, {ANSWER.format('votes')} FROM tiers",
    "confusion": f"WITH {JUDGED} SELECT * FROM conf2",
    "detection_score": f"WITH {JUDGED} SELECT round(1000 * log10(1 / greatest(eps, 0.001)) - 300 * log10(1 + e), 6) AS score FROM conf2",
    "vote_breakdown": f"WITH {JUDGED} SELECT cheap_votes, count(*) AS total, count(*) FILTER (escalated) AS escalated, count(*) FILTER (NOT approved AND expected_approved) AS fp, count(*) FILTER (approved AND NOT expected_approved) AS fn, coalesce(avg(CASE WHEN escalated THEN rows_scanned END), 0) AS mean_rows FROM judged GROUP BY cheap_votes",
    "index_percentile": "WITH s AS (SELECT list_sort(list(l_extendedprice)) AS a FROM lineitem), p AS (SELECT unnest([0, 50, 90, 99, 100])::DOUBLE AS percent) SELECT percent, a[least(len(a) - 1, CAST(floor(len(a) * percent / 100) AS BIGINT)) + 1] AS value FROM s, p",
    "approx_vs_exact": f"WITH {TIERS}, {EXACT}, ev AS (SELECT qid, count(*) FILTER (fraud) AS v FROM exact GROUP BY qid) SELECT count(*) AS n, count(*) FILTER (votes <> v) AS mismatches FROM tiers JOIN ev USING (qid)".replace(" WHERE qid % 100 = 0", ""),
    "score_batch": SCORED,
    "score_stream": SCORED,
}
assert BUCKET_Q and NLIST
