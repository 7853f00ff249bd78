"""Quality classifier: a generalised additive model with pairwise interactions.

One scan turns each whole text into a short row of numbers. The model is fitted on the driver to at most `max_train` labelled rows (a documented
bound, chosen by hash of the id): features are cut into quantile bins, and shallow trees on one feature at a time,
boosted in cycles, add up to one lookup table per feature; the strongest pairs get small two-way tables the same way.
Scoring is one addition of table entries per feature and pair, for a whole batch at once.

Edge cases: null, empty and blank texts have all-zero features and a score like any other; without usable labels the score
is 0.5, with labels of one kind it is (n + 1) / (n + 2) or 1 / (n + 2) for all; labels without an id, a text or a value and labels other than 0 and 1 are
left out, as are repeated labels that contradict each other; repeated rows each get a row; other columns are never read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_WORDS, crc_mod, mapped, slices, table, written

MAX_TRAIN = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "symbols", "digits", "blanks", "other_bytes", "stops", "pipes", "shouts", "brackets",
    "distinct_words", "commonest_word", "twin_words", "distinct_pairs", "repeated_lines", "words_per_line", "closed_lines", "odd_endings", "short_words", "long_words",
)
#: Bytes whose share is a feature.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbols": b"#$%&*~^=+@_\\", "digits": b"0123456789", "blanks": b" \t\n\x0b\x0c\r",
    "other_bytes": bytes(range(0x80, 0x100)), "stops": b".,;:", "pipes": b"|", "shouts": b"!?", "brackets": b"<>{}[]()",
}
MASKS = np.array([[c in chars for chars in CLASSES.values()] for c in range(256)], dtype=np.float64)
CLOSED = b".!?:;\"')"
#: A word that ends in one of these has an odd ending: neither a letter or digit nor a usual closing sign.
ODD_ENDS = bytes(c for c in range(0x80) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c in b".,;:!?\"')"))
#: Words in a window of the repetition features, which thereby mean the same for texts of any length.
WINDOW = 200


def features(text: bytes) -> list[float]:
    """FEATURES of a whole text."""
    words = text.translate(BLANK_WORDS).split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    octets = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    shares = octets @ MASKS / len(text)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    distinct = pairs = most = 0.0
    for at in range(0, n, WINDOW):
        part = words[at : at + WINDOW]
        own = set(part)
        distinct += len(own)
        pairs += len(set(zip(part, part[1:], strict=False))) if len(part) > 1 else 1
        if len(own) < len(part):
            counts: dict[bytes, int] = {}
            for w in part:
                counts[w] = counts.get(w, 0) + 1
            most += max(counts.values())
        else:
            most += 1
    windows = -(-n // WINDOW)
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    ends = sum(1 for x in lines if x[-1] in CLOSED)
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), float(lengths.mean()), *shares.tolist(),
        distinct / n, most / n, sum(map(eq, words, words[1:])) / n, pairs / max(1, n - windows),
        1 - len(set(lines)) / len(lines), n / len(lines), ends / len(lines),
        sum(1 for w in words if w[-1] in ODD_ENDS) / n, float((lengths <= 3).mean()), float((lengths >= 20).mean()),
    ]


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and x, the array of FEATURES."""

    def scan(batches):
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), scan, "doc_id long, x array<double>")


class Additive:
    """Bins, lookup tables of features and pairs, and their boosted fit."""

    BINS, PAIR_BINS, PAIRS = 48, 8, 6

    def __init__(self, x: np.ndarray, y: np.ndarray, cycles: int = 120, pair_cycles: int = 40, rate: float = 0.15):
        n, f = len(y), len(FEATURES)
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.BINS + 1)[1:-1])) if n else np.zeros(0) for k in range(f)]
        self.coarse = [e[:: max(1, -(-len(e) // (self.PAIR_BINS - 1)))] for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        p = (y.sum() + 1) / (n + 2) if n else 0.5
        self.base = float(np.log(p / (1 - p)))
        if not n or y.min() == y.max():
            return
        bins, coarse = self.binned(x, self.edges), self.binned(x, self.coarse)
        score = np.full(n, self.base)
        for _ in range(cycles):
            for k in range(f):
                step = rate * self.tree(*self.sums(bins[k], len(self.tables[k]), y, score))
                self.tables[k] += step
                score += step[bins[k]]
        gains = sorted(((self.gain(coarse[i], coarse[j], y, score), i, j) for i in range(f) for j in range(i)), reverse=True)
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for _, i, j in gains[: self.PAIRS]]
        for _ in range(pair_cycles):
            for i, j, grid in self.pairs:
                g, h = (s.reshape(grid.shape) for s in self.sums(coarse[i] * grid.shape[1] + coarse[j], grid.size, y, score))
                step = rate * self.grid_tree(g, h)
                grid += step
                score += step[coarse[i], coarse[j]]

    @staticmethod
    def binned(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]

    @staticmethod
    def sums(bins: np.ndarray, size: int, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return np.bincount(bins, y - p, size), np.bincount(bins, p * (1 - p), size)

    @staticmethod
    def value(g, h):
        return np.clip(g / (h + 1.0), -4, 4)

    @classmethod
    def tree(cls, g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
        """A tree of some depth over ordered bins, as a value for each bin."""
        out = np.full(len(g), cls.value(g.sum(), h.sum()))
        if depth and len(g) > 1:
            a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1)
            k = int(gain.argmax()) + 1
            if gain[k - 1] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
                out[:k], out[k:] = cls.tree(g[:k], h[:k], depth - 1), cls.tree(g[k:], h[k:], depth - 1)
        return out

    @classmethod
    def grid_tree(cls, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The better of cutting rows and then columns, or columns and then rows."""
        best = None
        for turned in (False, True):
            a, b = (g.T, h.T) if turned else (g, h)
            for k in range(1, max(2, len(a))):
                parts = [cls.tree(a[s].sum(0), b[s].sum(0), 1) for s in (slice(0, k), slice(k, None)) if len(a[s])]
                whole = np.vstack([np.repeat(v[None], len(a[s]), 0) for v, s in zip(parts, (slice(0, k), slice(k, None)), strict=False)])
                worth = float((2 * a * whole - b * whole**2).sum())
                if best is None or worth > best[0]:
                    best = worth, whole.T if turned else whole
        return best[1]

    def gain(self, i: np.ndarray, j: np.ndarray, y: np.ndarray, score: np.ndarray) -> float:
        """What a free two-way table would add beyond its margins."""
        shape = int(i.max()) + 1, int(j.max()) + 1
        g, h = (s.reshape(shape) for s in self.sums(i * shape[1] + j, shape[0] * shape[1], y, score))
        worth = lambda a, b: float((a**2 / (b + 1)).sum())
        return worth(g, h) - worth(g.sum(0), h.sum(0)) - worth(g.sum(1), h.sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(x):
            for t, b in zip(self.tables, self.binned(x, self.edges), strict=True):
                out += t[b]
            coarse = self.binned(x, self.coarse) if self.pairs else []
            for i, j, grid in self.pairs:
                out += grid[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-out))


def usable(labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, y of labelled rows whose crc32(doc_id) mod 3 is not 1, max_train of them at most (by hash)."""
    y = F.col("quality")
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), y.cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & y.isin(0, 1) & (crc_mod(F.col("doc_id"), 3) != 1))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z").drop("z")
    every = max(1, -(-rows.count() * 10 // (9 * max_train)))
    return rows.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(every)) == 0).limit(max_train)


def train(rows: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Additive:
    """Fit to the usable labels of rows of feature_rows(), max_train of them at most (by hash)."""
    got = rows.join(F.broadcast(usable(labels, max_train)), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return Additive(x, got.column("y").to_numpy().astype(np.float64))


def score(rows: DataFrame, model: Additive) -> DataFrame:
    """doc_id, score for rows of feature_rows()."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(x))], names=["doc_id", "score"])

    return mapped(rows, scan, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents with a score of at least `least`, all columns kept. Features for the fit are those of documents with usable labels alone; for the decision every text is scanned, never shuffled."""
    some = written(usable(labels, max_train).select(F.col("doc_id").alias("labelled")), "quality-labelled")
    known = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id").cast("long") == F.col("labelled"), "left_semi")
    model = train(written(feature_rows(known), "quality-features"), labels, max_train)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def scan(batches):
        for b in slices(batches):
            x = np.array([features(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(sent.value.score(x) >= least))

    return mapped(docs, scan, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(feature_rows(table(spark, sf_dir, "documents")), "quality-features")
    scored = score(rows, train(rows, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
