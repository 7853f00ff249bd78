"""SimHash near-dedup: vantage-point trees over fingerprints, exact within their radius.

Texts become 64-bit fingerprints in one scan; from there on only fingerprints move. Equal fingerprints are one
entry. A routing tree of vantage points, built on a bounded sample, sends every entry to one
shard, and also to a nearer shard where the triangle bound lets a partner lie on the other side: at a vantage point p with radius m, an
entry with d in (m, m + r] may link to one with d <= m, so it visits the inner branch too. Every pair within r
thus meets in some shard. A shard grows its own tree over all its entries and compares what falls in one leaf and in
neighbouring rings around one more point. It gives back a spanning star for each of its components, never all pairs, and the stars are joined by
alternating large-star and small-star steps on written tables.

Edge cases: null, empty and blank texts have fingerprint zero, linked like any other; a text with fewer words than a shingle
is one shingle; rows with a null doc_id get their group's smallest id (null if it has none); repeated rows each get a row; an empty table gives no
rows; other columns are ignored. Long texts are taken in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_words, join_groups, mapped, slices, small, table, written

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Entries for the routing tree's sample, entries that a shard should hold, sampled entries that a shard needs at least.
SAMPLE, SHARD, LEAST = 65_536, 4_096, 16
#: Words hashed at a time, and comparisons made at a time.
BLOCK, PAIRS = 65_536, 1 << 20
#: Bits of each byte value.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes, repeats included."""
    words = blank_words(text)
    if not words:
        return 0
    counts, n, h = np.zeros((8, 8), dtype=np.int64), max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = (ends - [len(w) + 1 for w in part])[: max(1, len(part) - shingle + 1)].tolist()
        stops = (ends - 1)[min(shingle, len(part)) - 1 :].tolist()
        hashes = np.fromiter([h(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64, count=len(starts))
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(octets[:, k], minlength=256) @ BITS
    bits = (2 * counts > n).astype(np.uint8)  # row k: byte k of a little-endian number, high bit first
    return int.from_bytes(np.packbits(bits, axis=1).tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_hash (of the text) and fp, the fingerprint as a signed long."""

    def scan(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(x, shingle) for x in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "row_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return mapped(rows, scan, "doc_id long, row_hash long, fp long")


class Tree:
    """A vantage-point tree. Inner nodes have a point and a radius; leaves are numbered."""

    def __init__(self, fps: np.ndarray, size: int, reach: int, seed: int = 7):
        self.reach, self.nodes, self.leaves = reach, [], 0
        self.draw = np.random.default_rng(seed)
        self.root = self.grow(fps, size)

    def grow(self, fps: np.ndarray, size: int) -> int:
        split = self.split(fps) if len(fps) > size else None
        self.nodes.append(None)
        at = len(self.nodes) - 1
        if split is None:
            self.nodes[at] = (0, 0, -1, self.leaves)
            self.leaves += 1
        else:
            point, radius, d = split
            self.nodes[at] = (point, radius, self.grow(fps[d <= radius], size), self.grow(fps[d > radius], size))
        return at

    def split(self, fps: np.ndarray):
        """Of a few points and radii near the median, the pair that sends the fewest entries both ways."""
        best = None
        for point in self.draw.choice(fps, min(8, len(fps)), replace=False):
            d = np.bitwise_count(fps ^ point)
            rings = np.bincount(d, minlength=65 + self.reach)
            inner = np.cumsum(rings)
            for radius in range(64):
                share = inner[radius] / len(fps)
                if 0.3 <= share <= 0.7:
                    both = (inner[radius + self.reach] - inner[radius]) / len(fps)
                    # levels that are still to come cost as much again
                    worth = both + abs(share - 0.5)
                    if best is None or worth < best[0]:
                        best = worth, point, radius, d
        return best and best[1:]

    def route(self, fps: np.ndarray):
        """(leaf, places in fps) for every leaf; a place is in several leaves where partners may be."""
        stack = [(self.root, np.arange(len(fps)))]
        while stack:
            at, rows = stack.pop()
            point, radius, inner, outer = self.nodes[at]
            if inner < 0:
                yield outer, rows
                continue
            d = np.bitwise_count(fps[rows] ^ np.uint64(point))
            for child, own in ((inner, d <= radius + self.reach), (outer, d > radius)):
                if own.any():
                    stack.append((child, rows[own]))


class Union:
    """Components of places; each is named by its smallest place. used: the pairs that joined them, a spanning forest."""

    def __init__(self, n: int):
        self.of, self.used = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            new = x != y
            if not new.any():
                return
            x, y, a, b = x[new], y[new], a[new], b[new]
            high, one = np.unique(np.maximum(x, y), return_index=True)
            self.of[high] = np.minimum(x, y)[one]
            self.used.append((a[one], b[one]))
            while (up := self.of[self.of]).tobytes() != self.of.tobytes():
                self.of = up


def link(fps: np.ndarray, reach: int, size: int = SHARD) -> Union:
    """The components of some distinct fingerprints."""
    union = Union(len(fps))
    for _, rows in Tree(fps, size, reach).route(fps) if len(fps) > size else [(0, np.arange(len(fps)))]:
        own = fps[rows]
        d = np.bitwise_count(own ^ own[0]) if len(own) else own
        order = np.argsort(d, kind="stable")
        rows, own, d = rows[order], own[order], d[order]
        at, step = 0, max(1, PAIRS // max(1, len(own)))
        while at < len(own):
            # rings around one point: a partner's distance differs by the reach at most
            to = min(at + step, len(own))
            end = int(np.searchsorted(d, int(d[to - 1]) + reach, side="right"))
            i, j = np.nonzero(np.bitwise_count(own[at:to, None] ^ own[None, at:end]) <= reach)
            keep = i < j
            union.add(rows[at + i[keep]], rows[at + j[keep]])
            at = to
    return union


def links(entries: DataFrame, reach: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect what is within reach: a star for each component of each shard. entries: distinct fp, written."""
    spark, n = entries.sparkSession, entries.count()
    every = max(1, -(-n // SAMPLE))
    sample = np.array([r[0] for r in entries.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(2 * SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    tree = Tree(np.sort(sample), max(LEAST, SHARD // every), reach)
    sent = spark.sparkContext.broadcast(tree)

    def route(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for leaf, rows in sent.value.route(fps.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, dtype=np.int32)), pa.array(fps[rows])], names=["shard", "fp"])

    def stars(shard: pa.Table) -> pa.Table:
        fps = np.sort(shard.column("fp").to_numpy())
        union = link(fps.view(np.uint64), reach)
        linked = np.flatnonzero(union.of != np.arange(len(fps)))
        return pa.table({"a": fps[linked], "b": fps[union.of[linked]]})

    return mapped(entries.select("fp"), route, "shard int, fp long").groupBy("shard").applyInArrow(stars, "a long, b long")


def _by_node(edges: DataFrame, name: str) -> DataFrame:
    """Edges with the smallest neighbour of their first node."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), name)
    return join_groups(edges, least, "a", "n")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge: root is the smallest node of its component. Large-star and small-star steps in turn."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "simhash-edges")
    state = None
    while True:
        count, mix = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not count or (count, mix) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = count, mix
        both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "simhash-both")
        large = _by_node(both, "simhash-large").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "simhash-star")
        small = _by_node(large, "simhash-small").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.*").filter("a <> b").distinct(), "simhash-edges")


def rooted(rows: DataFrame, reach: int = RADIUS) -> DataFrame:
    """fp, first_id, n (rows), root of the fingerprints in written rows: root is the smallest that links reach."""
    entries = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-entries")
    roots = components(links(entries, reach)).withColumnRenamed("node", "fp")
    return written(entries.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, row_hash, fp, component_id (the smallest doc_id that links reach)."""
    rows = written(fingerprints(docs, shingle), "simhash-documents")
    named = rooted(rows, reach)
    groups = written(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "simhash-groups")
    known = written(join_groups(named, groups, "root", "size").select("fp", "n", "component_id"), "simhash-known")
    return join_groups(rows, known, "fp", "n").select("doc_id", "row_hash", "fp", "component_id")


def text_links(docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS) -> DataFrame:
    """Edges (a, b) of text hashes, written: every text whose fingerprint is linked to another text's, with the smallest hash of its component."""
    rows = written(fingerprints(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), shingle), "simhash-documents")
    named = rooted(rows, reach).select("fp", "n", "root")
    texts = written(rows.select("row_hash", "fp").distinct(), "simhash-hashes")
    placed = written(join_groups(texts, named, "fp", "n").select("row_hash", "root"), "simhash-placed")
    least = written(placed.groupBy("root").agg(F.min("row_hash").alias("b"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "simhash-least")
    return written(join_groups(placed, least, "root", "size").filter("row_hash <> b").select(F.col("row_hash").alias("a"), "b"), "simhash-linked")


#: Similarity mode: shared five-word shingles decide.
WORDS, SIMILARITY = 5, 0.8
#: Shingles that are told to be common; hashes that a task holds, that a part counts, entries that a shard should hold.
COMMON, HELD, COUNTED, ENTRIES = 2_000_000, 1_000_000, 2_000_000, 250_000
#: Odd multipliers of the shingle hash.
ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)
SHARED = "token long, text long, size int, place int, n long, centre boolean, hub long, star boolean"


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, as signed numbers."""
    w = blank_words(text)
    size = min(words, len(w))
    n = len(w) - size + 1 if w else 0
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h += own[k : k + n] * ODD[k % 64]
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def common_shingles(texts: DataFrame, words: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the commonest shingles in two rows or more, COMMON at most. size: bytes of all texts."""
    parts = min(60_000, max(1, -(-size // (6 * COUNTED))))
    share = -(-COMMON // parts)

    def split(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(held)
        part = (h.view(np.uint64) % np.uint64(parts)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        h, ends = h[order], np.cumsum(np.bincount(part, minlength=parts)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([h[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)], pa.binary())], names=["part", "h"])

    def scan(batches):
        held, n = [], 0
        for b in slices(batches):
            for x in b.column(0).to_pylist():
                held.append(shingle_hashes(x, words))
                n += len(held[-1])
                if n >= HELD:
                    yield split(held)
                    held, n = [], 0
        if held:
            yield split(held)

    def count(part: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([np.frombuffer(x, dtype=np.int64) for x in part.column("h").to_pylist()]))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        c = np.diff(first, append=len(h))
        h, c = h[first][c > 1], c[c > 1]
        if len(h) > share:
            most = np.lexsort((h, -c))[:share]
            h, c = h[most], c[most]
        return pa.table({"h": pa.array([h.tobytes()], pa.binary()), "c": pa.array([np.minimum(c, 1 << 30).astype(np.int32).tobytes()], pa.binary())})

    got = mapped(texts.select("text"), scan, "part int, h binary").groupBy("part").applyInArrow(count, "h binary, c binary").collect()
    h, c = (np.concatenate([np.zeros(0, dtype=t), *(np.frombuffer(r[k], dtype=t) for r in got)]) for k, t in ((0, np.int64), (1, np.int32)))
    order = np.argsort(h)
    return h[order], c[order]


def within(similarity: float, size, place, size_b, place_b) -> np.ndarray:
    """Whether two texts whose first shared shingle is at these places may still share enough."""
    return (1 + similarity) * np.minimum(size - place, size_b - place_b) >= similarity * (size + size_b) - 1e-6


def shared_prefixes(texts: DataFrame, words: int, similarity: float, size: int) -> DataFrame:
    """A row for each shingle of a text's prefix that another text's prefix has too. Each shingle has a centre, that of its n texts with the shingle at the first place; hub is the centre's text, star whether the two may be similar."""
    sent = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, words, size))
    shards = max(1, int(size / 6 * (1 - similarity) / ENTRIES))

    def scan(batches):
        common, counts = sent.value
        for b in slices(batches):
            tokens, ids, sizes, seen = [], [], [], set()
            for text, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text in seen:
                    continue
                seen.add(text)
                h = shingle_hashes(x, words)
                n, c = len(h), np.zeros(len(h), dtype=np.int32)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    c = np.where(common[at] == h, counts[at], 0)
                tokens.append(h[np.argsort(c, kind="stable")][: n - int(np.ceil(similarity * n - 1e-9)) + 1] if n else np.zeros(1, dtype=np.int64))
                ids.append(text)
                sizes.append(n)
            if not ids:
                continue
            lengths = [len(t) for t in tokens]
            token = np.concatenate(tokens)
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
            shard = (token.view(np.uint64) % np.uint64(shards)).astype(np.int32)
            columns = [shard, token, np.repeat(np.array(ids, dtype=np.int64), lengths), np.repeat(np.array(sizes, dtype=np.int32), lengths), place]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "token", "text", "size", "place"])

    def meet(shard: pa.Table) -> pa.Table:
        token, text, size, place = (shard.column(x).to_numpy() for x in ("token", "text", "size", "place"))
        # the centre has the fewest rarer shingles, as an original has among its copies; of several, every shingle draws its own
        mixed = (token ^ text).view(np.uint64) * ODD[0]
        order = np.lexsort((mixed, place, token))
        token, text, size, place = token[order], text[order], size[order], place[order]
        once = np.concatenate([[True], (token[1:] != token[:-1]) | (text[1:] != text[:-1])])[: len(token)]
        token, text, size, place = token[once], text[once], size[once], place[once]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
        n = np.diff(first, append=len(token))
        hub, many = np.repeat(first, n), np.repeat(n, n)
        centre = hub == np.arange(len(token))
        star = ~centre & within(similarity, size, place, size[hub], place[hub])
        keep = many > 1
        columns = [token, text, size, place, many, centre, text[hub], star]
        return pa.table({name.split()[0]: x[keep] for name, x in zip(SHARED.split(", "), columns, strict=True)})

    return mapped(texts.select("row_hash", "text"), scan, "shard int, token long, text long, size int, place int").groupBy("shard").applyInArrow(meet, SHARED)


def unjoined_pairs(entries: DataFrame, similarity: float, shards: int) -> DataFrame:
    """Pairs (a, b) of texts at one shingle that may be similar and have different roots, each of them. entries: token, text, size, place, root."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        token, text, size, place, root = (t.column(x).to_numpy() for x in ("token", "text", "size", "place", "root"))
        order = np.lexsort((root, token))
        token, text, size, place, root = token[order], text[order], size[order], place[order], root[order]
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (root[1:] != root[:-1])])[: len(token)])
        runs = np.diff(first, append=len(token))
        # a row meets the rows of its shingle behind its own root's, one after the other
        row, other, found, n = np.arange(len(token)), np.repeat(first + runs, runs), [], 0
        while True:
            live = other < len(token)
            row, other = row[live], other[live]
            live = token[row] == token[other]
            row, other = row[live], other[live]
            if len(row):
                near = within(similarity, size[row], place[row], size[other], place[other])
                found.append(np.stack([text[row[near]], text[other[near]]]))
                n += found[-1].shape[1]
                other = other + 1
            if n >= PAIRS or (n and not len(row)):
                both = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
                found, n = [], 0
            if not len(row):
                return

    shard = F.pmod("token", F.lit(shards)).cast("int").alias("shard")
    return entries.select(shard, "token", "text", "size", "place", "root").groupBy("shard").applyInArrow(pairs, "a long, b long").distinct()


def verified(edges: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of texts, written, that are similar, by their whole texts."""
    ends = written(edges.select(F.explode(F.array("a", "b")).alias("row_hash")).distinct(), "similar-ends")

    def cut(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(x, words) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["row_hash", "shingles"])

    wanted = texts.select("row_hash", "text").join(small(ends), "row_hash", "left_semi").dropDuplicates(["row_hash"])
    shingles = written(mapped(wanted, cut, "row_hash long, shingles array<long>"), "similar-shingles")
    both = edges.join(shingles.select(F.col("row_hash").alias("a"), F.col("shingles").alias("sa")), "a").join(shingles.select(F.col("row_hash").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return written(both.filter(shared + 1e-6 >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "similar-linked")


def similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, links: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, row_hash, root, component_id, the smallest doc_id that pairs of texts with Jaccard similarity of at least
    `similarity` over distinct shingles of `words` words reach. Equal texts are similar, also empty ones.

    Exact but for colliding 64-bit hashes. With shingles in one order for all texts, common ones last, texts that are similar share one within
    their prefixes, the first fifth at 0.8 (prefix filtering). First each such shingle's texts are held against its centre,
    the one with the fewest rarer shingles; then all pairs at a shingle that are still in different components are, so that no pair goes unseen. Both are
    verified on whole texts. links: further edges (a, b) of text hashes, written, that count as they are. Texts that are nearly similar to many others (templates with over four fifths in common) cost their pairs.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = written(texts.select("doc_id", "row_hash"), "similar-documents")
    once = written(rows.groupBy("row_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "similar-texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = written(shared_prefixes(texts, words, similarity, size), "similar-shared")
    stars = written(shared.filter("star").select(F.least("text", "hub").alias("a"), F.greatest("text", "hub").alias("b")).distinct(), "similar-stars")
    linked = verified(stars, texts, words, similarity)
    if links is not None:
        linked = linked.unionByName(links)
    roots = components(linked).withColumnRenamed("node", "text")
    crowded = shared.filter("n > 2 and not centre").join(roots, "text", "left").withColumn("root", F.coalesce("root", "text"))
    rest = written(unjoined_pairs(crowded, similarity, max(1, -(-shared.count() // ENTRIES))), "similar-rest")
    if not rest.isEmpty():
        linked = linked.unionByName(verified(rest, texts, words, similarity))
        roots = components(linked).withColumnRenamed("node", "text")
    roots = roots.withColumnRenamed("text", "row_hash")
    named = written(once.join(roots, "row_hash", "left").withColumn("root", F.coalesce("root", "row_hash")), "similar-roots")
    groups = written(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "similar-groups")
    known = written(join_groups(named, groups, "root", "size").select("row_hash", "n", "root", "component_id"), "similar-known")
    return join_groups(rows, known, "row_hash", "n").select("doc_id", "row_hash", "root", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, that with the smallest doc_id (then text hash); of rows repeated whole, one. All columns kept.

    Fingerprints within RADIUS bits link documents, by text_links(); the exact join of similar() adds the pairs that they miss. A group is what links of
    both kinds reach.
    What is looked up in the texts are the documents that go, as written tables: small ones are broadcast by their
    count, larger ones joined by key.
    """
    groups = written(similar(docs, words, similarity, text_links(docs)), "near-groups")
    who = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_hash")
    first = written(groups.groupBy("root").agg(F.min(who).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-first")
    gone = join_groups(groups, first, "root", "n").filter(~(who == F.col("f"))).select("doc_id", "row_hash").distinct()
    twice = groups.groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "row_hash")
    gone, twice = (written(x.withColumnsRenamed({"doc_id": "__sh_id", "row_hash": "__sh_hash"}), n) for x, n in ((gone, "near-gone"), (twice, "near-twice")))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__sh_id")) & (text_hash == F.col("__sh_hash"))
    left = docs.join(small(gone), same, "left_anti")
    if twice.isEmpty():
        return left
    once = left.join(small(twice), same, "left_semi").withColumn("__sh_text", text_hash).dropDuplicates(["doc_id", "__sh_text"]).drop("__sh_text")
    return left.join(small(twice), same, "left_anti").unionByName(once)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
