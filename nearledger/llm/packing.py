"""Best-fit packing of token sequences by patterns that non-negative least squares fits to the length histogram.

Three steps. (1) Texts become pieces of at most `capacity` ids; each piece knows its rank among
the pieces of equal length in its partition. (2) The length histogram, `capacity` counts whatever the corpus' size, goes to the driver: patterns of up to three
documents over length bins are enumerated, their repeat counts fitted by non-negative least squares and rounded, and
what remains is packed best-fit by decreasing length, all on counts. (3) Every piece finds its sequence and offset
from its length and rank. Texts are read once and never shuffled; only pieces (a few numbers each) are.

Edge cases: a null text is empty and is the end id alone; a null doc_id is kept as it is; repeated rows are packed
as often as they occur; a document of exactly `capacity` ids is one piece; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, slices, table, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bins of the pattern fit and documents in a pattern.
BINS, PATTERN = 128, 3
#: Chunks whose ids a worker remembers; words that the tokenizer gets at a time, which takes some hundred times their length.
CACHE, NEW = 500_000, 5_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def vocabulary(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Ids, as little-endian 32-bit bytes, of chunks of text between ASCII blanks; the tokenizer works out the chunks that are new.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its chunks. It also
    lower-cases and splits between letters and signs, so chunks are looked up in lower case and the signs at their end apart.
    New words go to the tokenizer together; each ends with a token that bears the vocabulary's end of word.
    """

    SPLIT = regex.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(vocabulary), {}
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def encode(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, chunks: set[bytes]) -> None:
        split = {c: m.groups() for c in chunks if b"'" not in c and (m := self.SPLIT.fullmatch(c))}
        new = [w for w in {w for w, _ in split.values()} if w not in self.known]
        for words in (new[at : at + NEW] for at in range(0, len(new), NEW)):
            ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(words):
                data = ids.tobytes()
                self.known.update((w, data[4 * a : 4 * b]) for w, a, b in zip(words, [0, *stops], stops, strict=False))
            else:
                self.known.update((w, self.encode(w)) for w in words)
        for c in chunks - split.keys():
            self.known[c] = self.encode(c)
        for c, (word, tail) in split.items():
            if tail:
                if tail not in self.known:
                    self.known[tail] = self.encode(tail)
                self.known[c] = self.known[word] + self.known[tail]

    def of(self, text: bytes) -> bytes:
        if b"<|" in text:  # special tokens are told by their case
            return b"".join(map(self.encode, text.split()))
        if len(self.known) > CACHE:
            self.known.clear()
        chunks = text.translate(LOWER).split()
        ids = list(map(self.known.get, chunks))
        if None in ids:
            self.learn({c for c, x in zip(chunks, ids, strict=True) if x is None})
            ids = map(self.known.__getitem__, chunks)
        return b"".join(ids)


@lru_cache(1)
def encoder(vocabulary: str) -> Ids:
    """One for all tasks of a worker."""
    return Ids(vocabulary)


def pieces(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part and rank (place among pieces of this length and part). To be written before use."""
    with open(vocabulary_path or vocabulary(), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        ids, part, ranks = encoder(sent.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = ids.of(text) + end
                for k, at in enumerate(range(0, len(got), 4 * capacity)):
                    x = got[at : at + 4 * capacity]
                    n = len(x) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(x), part, ranks[n]))
                    ranks[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), cut, PIECES)


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Lawson-Hanson: x >= 0 that minimises |a x - y|."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    slope = a.T @ y
    limit = 1e-9 * max(1.0, np.abs(slope).max(initial=0))
    for _ in range(rounds):
        free = np.where(passive, -np.inf, slope)
        if not free.size or free.max() <= limit:
            break
        passive[free.argmax()] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], y, rcond=None)[0]
            low = passive & (s <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x += step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
        slope = a.T @ (y - a @ x)
    return x


def patterns(bins: int, most: int) -> list[tuple[int, ...]]:
    """All ways to fill `bins` with two to `most` falling parts, and the full one."""
    out = [(bins,)]

    def fill(head: tuple[int, ...], left: int) -> None:
        if len(head) + 1 <= most and head and left <= head[-1]:
            out.append((*head, left))
        if len(head) + 2 <= most:
            for x in range(min(head[-1] if head else bins - 1, left - 1), 0, -1):
                if x * (most - len(head) - 1) + x < left:
                    break
                fill((*head, x), left - x)

    fill((), bins)
    return out


class Plan:
    """Sequences as groups of equal content: how many, runs of (length, times), room left."""

    def __init__(self, histogram: np.ndarray, capacity: int = CAPACITY, bins: int = BINS, most: int = PATTERN):
        self.capacity, self.left = capacity, histogram.astype(np.int64).copy()
        self.by_room: dict[int, list[tuple[int, tuple]]] = {}
        self.rooms: list[int] = []
        if self.left[capacity]:
            self.put(int(self.left[capacity]), ((capacity, 1),), 0)
            self.left[capacity] = 0
        self.fitted(min(bins, capacity), most)
        self.best_fit()

    def put(self, count: int, runs: tuple, room: int) -> None:
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append((count, runs))

    def take(self, room: int) -> tuple[int, tuple]:
        group = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return group

    def fitted(self, bins: int, most: int) -> None:
        width = self.capacity / bins
        of = np.minimum(np.ceil(np.arange(self.capacity + 1) / width).astype(int), bins)
        held = np.bincount(of, weights=self.left, minlength=bins + 1)[1:]
        if not held.any():
            return
        shapes = patterns(bins, most)
        a = np.zeros((bins, len(shapes)))
        for j, shape in enumerate(shapes):
            for b in shape:
                a[b - 1, j] += 1
        fit = np.rint(nnls(a, held)).astype(np.int64)
        there = np.flatnonzero(self.left).tolist()
        lengths = {b: [n for n in range(self.capacity, 0, -1) if of[n] == b and self.left[n]] for b in range(1, bins + 1)}
        for j in np.argsort(-fit, kind="stable"):
            times = {b: shapes[j].count(b) for b in shapes[j]}
            count = min(int(fit[j]), *(sum(int(self.left[n]) for n in lengths[b]) // k for b, k in times.items()))
            if count <= 0:
                continue
            drawn = [self.draw(lengths[b], count) for b in shapes[j][:-1]]
            while count:  # equal contents at a time; the last document is the longest that still fits
                runs = tuple((d[-1][0], 1) for d in drawn)
                room = self.capacity - sum(x for x, _ in runs)
                last = self.longest(there, room)
                n = min([count, *(d[-1][1] for d in drawn), *([int(self.left[last])] if last else [])])
                if last:
                    self.left[last] -= n
                self.put(n, (*runs, (last, 1)) if last else runs, room - last)
                for d in drawn:
                    d[-1][1] -= n
                    if not d[-1][1]:
                        d.pop()
                count -= n

    def longest(self, there: list[int], room: int) -> int:
        """The longest of the lengths in stock that is within room; 0 if there is none. Drops what has run out on its way."""
        k = bisect_right(there, room) - 1
        while k >= 0 and not self.left[there[k]]:
            there.pop(k)
            k -= 1
        return there[k] if k >= 0 else 0

    def draw(self, lengths: list[int], count: int) -> list[list[int]]:
        """Take the longest of a bin, as [length, how many], last first."""
        out = []
        while count:
            n = lengths[0]
            k = min(count, int(self.left[n]))
            if k:
                out.append([n, k])
                self.left[n] -= k
                count -= k
            if not self.left[n]:
                lengths.pop(0)
        return out[::-1]

    def best_fit(self) -> None:
        for n in range(self.capacity, 0, -1):
            c = int(self.left[n])
            while c:
                k = bisect_left(self.rooms, n)
                if k == len(self.rooms):
                    per = self.capacity // n
                    if c // per:
                        self.put(c // per, ((n, per),), self.capacity - n * per)
                    if c % per:
                        self.put(1, ((n, c % per),), self.capacity - n * (c % per))
                    break
                room = self.rooms[k]
                count, runs = self.take(room)
                used = min(c, count)
                if used < count:
                    self.put(count - used, runs, room)
                self.put(used, (*runs, (n, 1)), room - n)
                c -= used
            self.left[n] = 0

    def slots(self) -> np.ndarray:
        """Rows of length, first rank, ranks, times, first sequence, offset; by length and rank. Of n ranks from r, the q-th is in sequence first + q // times, at offset + (q % times) * length."""
        rows, base, used = [], 0, [0] * (self.capacity + 1)
        for room in sorted(self.by_room):
            for count, runs in self.by_room[room]:
                at = 0
                for n, times in runs:
                    rows.append((n, used[n], count * times, times, base, at))
                    used[n] += count * times
                    at += n * times
                base += count
        self.sequences = base
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    held = written(pieces(docs, vocabulary_path, capacity, end_id), "packing-pieces")
    counts = written(held.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[n] = c
    sent = docs.sparkSession.sparkContext.broadcast(Plan(histogram, capacity).slots())
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))

    def place(batches):
        slots = sent.value
        keys = slots[:, 0] << 44 | slots[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            s = slots[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            q = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s[:, 4] + q // s[:, 3]), pa.array(s[:, 5] + q % s[:, 3] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = held.join(first, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))
    return mapped(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
