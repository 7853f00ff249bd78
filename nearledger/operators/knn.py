"""Exact nearest neighbours and their vote."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import K
from ..functions import scalars as S
from ..package import give_back, mapped
from ..sources.store import discard, stored

#: Queries in one broadcast block; references that the leaves are drawn from, and those of them in a leaf.
BLOCK, SAMPLED, LEAF = 1 << 17, 1 << 18, 64


def top_k(pairs: DataFrame, k: int, query: str = "qid", row: str = "rid") -> DataFrame:
    """The k pairs of least d per query, ties by row id, with rank from 1. Spark cuts groups to k rows before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy("d", row))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


class Best:
    """The k nearest rows of every query among those added, by distance and then row id, exactly.

    A matrix product in single precision, whose error has a proven bound, tells which pairs may count; the distances of those are summed in double precision
    in the order of dimensions. bound: no farther row counts (infinite: any may). own: row ids that don't count, one a query.
    """

    ROWS, QUERIES, HELD = 256, 512, 1 << 17

    def __init__(self, v: np.ndarray, k: int, bound: np.ndarray | None = None, own: np.ndarray | None = None):
        n = len(v)
        self.v, self.k, self.own = v, k, own
        self.bound = np.full(n, np.inf) if bound is None else bound.copy()
        self.axes = np.ascontiguousarray(v.T)
        self.square, self.most = (v * v).sum(1), float(np.sqrt((v * v).sum(1).max(initial=0)))
        self.d, self.rid, self.tag = np.full((n, k), np.inf), np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=bool)
        self.found, self.n = [], 0

    def reach(self, low: np.ndarray, high: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """The queries (of those at the places `of`) that a row between these corners may concern."""
        bound = (self.bound if of is None else self.bound[of]) * (1 + 1e-9) + 1e-12
        gap = np.zeros(len(bound))
        for i, axis in enumerate(self.axes):
            x = axis if of is None else axis[of]
            x = np.maximum(np.maximum(low[i] - x, x - high[i]), 0)
            gap += x * x
        near = np.flatnonzero(gap <= bound)
        return near if of is None else of[near]

    def visit(self, of: np.ndarray, r: np.ndarray, rid: np.ndarray, tag: np.ndarray | None = None, run: int = 256) -> None:
        """add() for the queries at the places `of` that the rows r may concern. Rows stand near their neighbours: they are passed over, or cut in four, by their corners."""
        of = self.reach(r.min(0), r.max(0), of) if len(r) else of[:0]
        if not len(of):
            return
        if len(r) <= run:
            self.add(of, r, rid, tag)
            return
        step = -(-len(r) // 4)
        for a in range(0, len(r), step):
            z = a + step
            self.visit(of, r[a:z], rid[a:z], None if tag is None else tag[a:z], run)

    def add(self, of: np.ndarray, r: np.ndarray, rid: np.ndarray, tag: np.ndarray | None = None) -> None:
        """Rows r that concern the queries at the places `of`."""
        dims, square = r.shape[1] if len(r) else 0, (r * r).sum(1)
        eps = 4 * (dims + 4) * 2.0**-24 * (self.most + float(np.sqrt(square.max(initial=0)))) ** 2
        rows = np.column_stack([-2 * r, square, np.ones(len(r))]).astype(np.float32)
        for a in range(0, len(of), self.QUERIES):
            at = of[a : a + self.QUERIES]
            cols = np.column_stack([self.v[at], np.ones(len(at)), self.square[at]]).astype(np.float32).T.copy()
            limit = (self.bound[at] + eps).astype(np.float32) + np.float32(eps)
            for lo in range(0, len(r), self.ROWS):
                near, need = rows[lo : lo + self.ROWS] @ cols, self.k + (self.own is not None)
                if np.isinf(limit).any() and len(near) >= need:
                    # the need-th least of the products bounds the k-th distance
                    least = np.partition(near, need - 1, axis=0)[need - 1].astype(np.float64) + 2 * eps
                    self.bound[at] = np.minimum(self.bound[at], least)
                    limit = (self.bound[at] + eps).astype(np.float32) + np.float32(eps)
                flat = np.flatnonzero(near <= limit)
                if not len(flat):
                    continue
                i, j = lo + flat // len(at), at[flat % len(at)]
                d = np.zeros(len(i))
                for t in range(dims):
                    x = r[i, t] - self.v[j, t]
                    d += x * x
                keep = d <= self.bound[j]
                if self.own is not None:
                    keep &= rid[i] != self.own[j]
                i, j = i[keep], j[keep]
                self.found.append((j, d[keep], rid[i], np.zeros(len(i), dtype=bool) if tag is None else tag[i]))
                self.n += len(i)
                if self.n >= self.HELD:
                    self.settle()
                    limit = (self.bound[at] + eps).astype(np.float32) + np.float32(eps)

    def settle(self) -> None:
        if not self.n:
            return
        q, d, rid, tag = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found, self.n = [], 0
        some = np.unique(q)
        held, place = np.nonzero(~np.isinf(self.d[some]))
        old = some[held]
        q, d, rid, tag = np.concatenate([q, old]), np.concatenate([d, self.d[old, place]]), np.concatenate([rid, self.rid[old, place]]), np.concatenate([tag, self.tag[old, place]])
        order = np.lexsort((rid, d, q))
        q, d, rid, tag = q[order], d[order], rid[order], tag[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, d, rid, tag, place = (x[place < self.k] for x in (q, d, rid, tag, place))
        self.d[q, place], self.rid[q, place], self.tag[q, place] = d, rid, tag
        self.bound[some] = np.minimum(self.bound[some], self.d[some, -1])

    def rows(self):
        """Places of queries, row ids, distances and tags of what is held."""
        self.settle()
        q, place = np.nonzero(~np.isinf(self.d))
        return q, self.rid[q, place], self.d[q, place], self.tag[q, place]


class Leaves:
    """Cells of a space by medians of a sample, so that near rows share one. Cells in order of their numbers lie near one another."""

    def __init__(self, sample: np.ndarray, size: int = LEAF):
        self.nodes, self.n = [], 0
        self.grow(sample, size)

    def grow(self, v: np.ndarray, size: int) -> int:
        at, split = len(self.nodes), None
        self.nodes.append(None)
        if len(v) > size:
            axis = int(np.argmax(v.std(0)))
            cut = float(np.median(v[:, axis]))
            below = v[:, axis] <= cut
            if below.all():
                below, cut = v[:, axis] < cut, float(np.nextafter(cut, -np.inf))
            split = (axis, cut, below) if below.any() else None
        if split is None:
            self.nodes[at] = (-1, 0.0, self.n, 0)
            self.n += 1
        else:
            self.nodes[at] = (split[0], split[1], self.grow(v[split[2]], size), self.grow(v[~split[2]], size))
        return at

    def of(self, v: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(v), dtype=np.int32), [(0, np.arange(len(v)))]
        while stack:
            at, rows = stack.pop()
            axis, cut, low, high = self.nodes[at]
            if axis < 0:
                out[rows] = low
            elif len(rows):
                below = v[rows, axis] <= cut
                stack += [(low, rows[below]), (high, rows[~below])]
        return out


def runs(keys: np.ndarray):
    """(from, to) of the runs of equal keys."""
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)).tolist() if len(keys) else []
    return zip([0, *ends], ends, strict=False)


def nearest(queries: DataFrame, refs: DataFrame, vector: Sequence[str] | str, k: int = K, exclude_self: bool = False, kept: bool = False) -> DataFrame:
    """qid, rid, d (squared), rank of the k nearest references of every query, exactly.

    kept: both are read from written tables by cheap expressions, so that they are not written again.
    queries: qid and the vector's columns (or one array column); refs: rid and the same. The references are stored in order of Leaves. A bounded sample of
    them serves for two things only: where the leaves lie, and a first bound of every query's k-th distance. Then all
    references are scanned, once a block of queries: a leaf that is farther off than a query's bound so far is passed over for it, and a task keeps k rows per query.
    """
    spark = queries.sparkSession
    array = isinstance(vector, str)
    names = [vector] if array else list(vector)
    held, asked = refs.select(F.col("rid").cast("long").alias("rid"), *names), queries.select(F.col("qid").cast("long").alias("qid"), *names)
    if not kept:
        held, asked = stored(held, "references"), stored(asked, "asked")
    n, blocks = held.count(), max(1, -(-asked.count() // BLOCK))
    sample = held.filter(F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-n // SAMPLED)))) == 0).toArrow()
    v, rid = _matrix([sample.column(c).combine_chunks() for c in names], array, sample.num_rows), sample.column("rid").to_numpy()
    tree = Leaves(v)
    leaf = tree.of(v)
    order = np.argsort(leaf, kind="stable")
    first = spark.sparkContext.broadcast((tree, v[order], rid[order], leaf[order]))
    parts, leaves = max(1, min(tree.n, n // 20_000)), tree.n
    del sample, v, rid, leaf, order, tree
    give_back()
    kinds = ", ".join(f"{c} {t}" for c, t in held.dtypes)

    def route(batches):
        tree = first.value[0]
        for b in batches:
            leaf = tree.of(_matrix(b.columns[1:], array, b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array((leaf.astype(np.int64) * parts // leaves).astype(np.int32))], names=[*b.schema.names, "leaf", "part"])

    placed = mapped(held, route, f"{kinds}, leaf int, part int").repartition(parts, "part").sortWithinPartitions("leaf").drop("part")
    placed = stored(placed, "leaves")

    def limits(batches):
        _, v, rid, leaf = first.value
        for b in batches:
            qid, q = b.column(0).to_numpy(), _matrix(b.columns[1:], array, b.num_rows)
            best = Best(q, k, own=qid if exclude_self else None)
            # the query's own leaf first, so that others are passed over
            home = first.value[0].of(q) if len(q) else np.zeros(0, dtype=np.int32)
            bounds = list(runs(leaf))
            for a, z in bounds:
                own = np.flatnonzero(home == leaf[a])
                if len(own):
                    best.add(own, v[a:z], rid[a:z])
            best.settle()
            for a, z in bounds:
                of = best.reach(v[a:z].min(0), v[a:z].max(0))
                of = of[home[of] != leaf[a]]
                if len(of):
                    best.add(of, v[a:z], rid[a:z])
            best.settle()
            width = q.shape[1] if len(q) else 0
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * width), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat, pa.array(best.bound)], names=["qid", "v", "bound"])

    bounded = stored(mapped(asked, limits, "qid long, v array<double>, bound double"), "bounded")
    found = []
    for block in range(blocks):
        got = bounded.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow()
        sent = spark.sparkContext.broadcast((got.column("qid").to_numpy(), _matrix([got.column("v").combine_chunks()], True, got.num_rows), got.column("bound").to_numpy()))
        del got
        give_back()

        def search(batches, sent=sent):
            qid, q, bound = sent.value
            best = Best(q, k, bound, qid if exclude_self else None)
            for b in batches:
                rid, r = b.column(0).to_numpy(), _matrix(b.columns[1:-1], array, b.num_rows)
                for a, z in runs(b.column(b.num_columns - 1).to_numpy()) if len(qid) else ():
                    of = best.reach(r[a:z].min(0), r[a:z].max(0))
                    if len(of):
                        best.add(of, r[a:z], rid[a:z])
            q, rid, d, _ = best.rows()
            for a in range(0, len(q), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (qid[q], rid, d)], names=["qid", "rid", "d"])

        found.append(mapped(placed, search, "qid long, rid long, d double"))
    if not kept:
        discard(held)
    pairs = found[0]
    for p in found[1:]:
        pairs = pairs.unionByName(p)
    return top_k(pairs, k)


def _matrix(columns, array: bool, n: int) -> np.ndarray:
    if array:
        flat = columns[0].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(n, -1) if n else np.zeros((0, 0))
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64) if n else np.zeros((0, len(columns)))


def nearest_pairs(queries: DataFrame, refs: DataFrame, vector: Sequence[str], k: int = K) -> DataFrame:
    """The same as nearest(), as one expression over all pairs; for a bounded query set only."""
    q = queries.select("qid", *[F.col(c).alias(f"q_{c}") for c in vector])
    d = S.squared_distance([F.col(f"q_{c}") for c in vector], [F.col(c) for c in vector])
    return top_k(refs.select("rid", *vector).crossJoin(F.broadcast(q)).select("qid", "rid", d.alias("d")), k)


def votes(queries: DataFrame, neighbours: DataFrame, refs: DataFrame, fraud: Column | None = None) -> DataFrame:
    """qid, votes, fraud_score, approved. Queries without neighbours have no votes; the score is always over K."""
    fraud = F.col("fraud") if fraud is None else fraud
    named = neighbours.select("qid", "rid").join(refs.select("rid", fraud.alias("_fraud")), "rid")
    count = named.groupBy("qid").agg(F.sum(F.when(F.col("_fraud"), 1).otherwise(0)).alias("votes"))
    return decide(queries.select("qid").join(count, "qid", "left"))


def decide(rows: DataFrame) -> DataFrame:
    """votes (null: none) to votes, fraud_score, approved."""
    n = F.coalesce("votes", F.lit(0)).cast("int")
    return rows.select(*[c for c in rows.columns if c != "votes"], n.alias("votes"), (n / F.lit(5.0)).alias("fraud_score"), (n < 3).alias("approved"))
