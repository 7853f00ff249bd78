"""Benchmark decontamination: a broadcast set of hashed benchmark n-grams against every window of every text.

The distinct windows of the benchmark go out in blocks of a checked size; each block is one scan of the
documents, so memory is bounded whatever the benchmark's size. In a scan, words become small integers (0: no benchmark word), all windows of a
text are hashed at once in numpy, a bit table throws out nearly all of them, and what remains is compared
exactly. No document text is shuffled.

Edge cases: null or wordless texts have no words and no hits; an item without words has no window, one of fewer than
n words is one window; equal items all count; a null item_id hits but is listed nowhere; an empty benchmark or an
empty documents table gives zero hits or no rows; repeated document rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, plain_words, slices, table, written

N = 10
#: Benchmark bytes in one broadcast block. Opened, a block takes some 40 bytes for each of these, so about 160 MB in a worker.
BLOCK_BYTES = 4_000_000
FILTER_BITS = 20
#: Odd multipliers of the window hash.
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

REPORT = "doc_id long, row_hash long, n_words long, spans array<struct<start:int,end:int>>, items array<long>"


class Windows:
    """The windows of some items: for each window length a filter and the exact windows with the items they come from."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int):
        self.ids: dict[bytes, int] = {}
        self.by_length: dict[int, tuple[np.ndarray, dict[bytes, list]]] = {}
        exact: dict[int, dict[bytes, list]] = {}
        for item, text in items:
            words = plain_words(text)
            codes = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], dtype=np.uint64)
            length = min(n, len(codes))
            for i in range(len(codes) - length + 1 if length else 0):
                of = exact.setdefault(length, {}).setdefault(codes[i : i + length].tobytes(), [])
                if item not in of:
                    of.append(item)
        for length, windows in exact.items():
            filled = np.zeros(1 << FILTER_BITS, dtype=bool)
            for w in windows:
                filled[self.hashes(np.frombuffer(w, dtype=np.uint64), length) >> np.uint64(64 - FILTER_BITS)] = True
            self.by_length[length] = filled, windows

    @staticmethod
    def hashes(codes: np.ndarray, length: int) -> np.ndarray:
        n = len(codes) - length + 1
        h = np.zeros(n, dtype=np.uint64)
        for k in range(length):
            h += codes[k : k + n] * MULTIPLIERS[k % 64] + (h >> np.uint64(29))
        return h

    def hits(self, text: bytes) -> tuple[int, list[tuple[int, int]], list]:
        """Words, merged spans of hit words (end exclusive), items."""
        words = plain_words(text)
        codes = np.fromiter(map(self.ids.get, words, repeat(0)), np.uint64, len(words))
        found, items = [], set()
        for length, (filled, windows) in self.by_length.items():
            if len(codes) < length:
                continue
            for i in np.flatnonzero(filled[self.hashes(codes, length) >> np.uint64(64 - FILTER_BITS)]).tolist():
                of = windows.get(codes[i : i + length].tobytes())
                if of is not None:
                    found.append((i, i + length))
                    items.update(of)
        return len(words), merge(found), sorted(x for x in items if x is not None)


class Block:
    """A block of the benchmark as it is sent out; a worker opens it once, not for each task."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int):
        self.items, self.n = items, n

    def open(self) -> Windows:
        if not hasattr(self, "windows"):
            self.windows = Windows(self.items, self.n)
        return self.windows


def merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(bench: DataFrame) -> int:
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // BLOCK_BYTES))


def contamination(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """One row per document: doc_id, row_hash (of the text), n_words, spans of hit words, items (ids, sorted, distinct)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    n_blocks, parts = _blocks(bench), []
    held = bench.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.pmod(F.xxhash64("text"), F.lit(n_blocks)).alias("block"))
    for block in range(n_blocks):
        items = [(r[0], bytes(r[1])) for r in held.filter(F.col("block") == block).select("item_id", "text").collect()]
        sent = spark.sparkContext.broadcast(Block(items, n))

        def scan(batches, sent=sent):
            windows = sent.value.open()
            for b in batches:
                out = [windows.hits(x) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([x[2] for x in out], pa.list_(pa.int64()))],
                    names=["doc_id", "row_hash", "n_words", "spans", "items"],
                )

        parts.append(mapped(rows, scan, REPORT))
    if n_blocks == 1:
        return parts[0]
    # A document's hits in several blocks meet; equal rows carry equal hits, so they meet without harm and are told apart by their count.
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = written(whole, "decontamination-blocks")
    hits = whole.filter(F.size("spans") > 0).groupBy("doc_id", "row_hash").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("all_items"))
    counts = whole.groupBy("doc_id", "row_hash", "n_words").agg((F.count(F.lit(1)) / n_blocks).cast("int").alias("times"))
    joined = counts.join(hits.withColumnsRenamed({"doc_id": "d", "row_hash": "r"}), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("row_hash").eqNullSafe(F.col("r")), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def settle(batches):
        for b in batches:
            spans = [[{"start": s, "end": e} for s, e in merge((x["start"], x["end"]) for x in row)] for row in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), b.column(4)], names=["doc_id", "row_hash", "n_words", "spans", "items"])

    return mapped(joined.select("doc_id", "row_hash", "n_words", F.coalesce("all_spans", none).alias("spans"), F.coalesce("all_items", F.expr("cast(array() as array<bigint>)")).alias("items"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_t")).drop("_t"), settle, REPORT)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = N, drop_documents: bool = False) -> DataFrame:
    """The documents without benchmark passages, all columns kept. A text with nothing but blanks and signs left goes; with drop_documents, every hit document goes.

    The spans of all blocks are found on uncut texts, merged, and cut once, so the result does not depend on the size of a block. One block is cut as it is
    scanned; of several, the hits, by document, meet the texts in a join. Null, empty and wordless texts stay as they are.
    """
    spark, schema = docs.sparkSession, docs.schema
    at = docs.columns.index("text")

    def cleaned(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        arrays = list(batch.columns)
        texts, keep = arrays[at].cast(pa.binary()).to_pylist(), []
        for i, spans in enumerate(found):
            if spans:
                texts[i] = cut(texts[i], spans)
            keep.append(not spans or (not drop_documents and WORD.search(texts[i]) is not None))
        arrays[at] = pa.array(texts, pa.binary()).cast(arrays[at].type)
        return pa.RecordBatch.from_arrays(arrays, names=schema.names).filter(pa.array(keep, pa.bool_()))

    if _blocks(bench) == 1:
        items = bench.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary")).collect()
        sent = spark.sparkContext.broadcast(Block([(r[0], bytes(r[1])) for r in items], n))

        def scan(batches):
            windows = sent.value.open()
            for b in slices(batches):
                yield cleaned(b, [windows.hits(x)[1] if x is not None else [] for x in b.column(at).cast(pa.binary()).to_pylist()])

        return mapped(docs, scan, schema)
    hits = contamination(docs, bench, n).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "row_hash"])
    hits = written(hits.select(F.col("doc_id").alias("__dc_id"), F.col("row_hash").alias("__dc_hash"), F.col("spans").alias("__dc_spans")), "decontamination-hits")
    met = docs.join(hits, F.col("doc_id").cast("long").eqNullSafe(F.col("__dc_id")) & (F.xxhash64("text") == F.col("__dc_hash")), "left")

    def cut_out(batches):
        for b in batches:
            spans = [[(x["start"], x["end"]) for x in row or ()] for row in b.column(b.num_columns - 1).to_pylist()]
            yield cleaned(pa.RecordBatch.from_arrays(b.columns[:-1], names=schema.names), spans)

    return mapped(met.select(*[F.col(f"`{c}`") for c in docs.columns], "__dc_spans"), cut_out, schema)


def _sha(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s.n, i, array_to_string(w[i : i + s.n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n) s
), hit AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
