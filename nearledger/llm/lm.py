"""Language-model scoring with a log-bilinear model, trained in numpy by noise-contrastive estimation.

Counts of all training words are gathered first. Every word above a count threshold has vectors of its own, as context and as output,
32,000 words at most; words next to each other in the order of their reversed bytes, which share endings, form classes, the commonest words a class each. A
word's probability is that of its class times its own inside the class, both log-bilinear in the three tokens before it. A class also has a tail, one
more output that stands for its rarer words, also never seen ones; they share it by their counts. Every word thus has a probability and they add up to one.

Texts are coded once. Each partition trains a copy on all of its training texts; of the copies, a word's vectors are averaged by how often each has
met the word, with an ordinary aggregation, so the fit covers the whole corpus and the driver sees one set of parameters, bounded
by the vocabulary. Scoring multiplies blocks of contexts with all class vectors, and those of a class's tokens with all of its words, and normalises both.

The corpus may have any number of words: those above another threshold, HEAD at most, go to every worker with their counts; occurrences of rarer ones leave
the scan as (row, word, n) and meet their counts in a join.

Edge cases: null and empty texts are the end token alone; without training texts all probabilities are those of no
counts (base 0) and a uniform model; a null doc_id counts as empty text for the split; repeated rows each count and
each get a row; an empty table gives no rows; other columns are ignored. Scores depend slightly on how the input is split.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_words, crc_mod, crc_mod_local, mapped, table, written

#: Most words whose counts go to every worker; most words with vectors, and the count that they need; words with a class each; words of a class.
HEAD, NEURAL, LEAST, OWN, SIZE = 300_000, 32_000, 30, 64, 192
#: Context tokens, dimensions, noise samples a batch, tokens a batch, passes over the corpus, learning rate.
CONTEXT, DIM, NOISE, BATCH, ROUNDS, RATE = 3, 16, 48, 4096, 2, 0.05
#: Tokens that are trained on or scored together; rows of class scores at a time; neighbouring tokens that stay together in a batch.
SLICE, SCORED, RUN = 262_144, 512, 32
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Fixed point of averaged parameters, which makes their sum independent of its order.
POINT = 1 << 12
END = 0


class Vocabulary:
    """What goes to the workers: words of the head with their counts, units (the end, words with vectors, tails of classes), corpus totals. Its size is bounded by HEAD."""

    def __init__(self, head: list[tuple[bytes, int]], texts: int):
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        self.words, self.counts = b" ".join(w for w, _ in head), np.array([c for _, c in head], dtype=np.int64)
        self.vectors = min(NEURAL, int((self.counts >= LEAST).sum()))
        self.own = min(OWN, self.vectors)
        grouped = sorted(range(self.own, self.vectors), key=lambda k: head[k][0][::-1])
        groups = max(1, -(-len(grouped) // SIZE))
        cuts = [round(k * len(grouped) / groups) for k in range(groups + 1)]
        #: Least reversed word of every group but the first.
        self.bounds = [head[grouped[k]][0][::-1] for k in cuts[1:-1]]
        self.first = np.array([1 + self.own + k + i for i, k in enumerate(cuts)])  # a group's first unit; its last one is its tail
        self.n_units, self.n_classes = int(self.first[-1]), 1 + self.own + groups
        self.classes = np.concatenate([np.arange(1 + self.own), np.repeat(np.arange(1 + self.own, self.n_classes), np.diff(self.first))]).astype(np.uint16)
        self.units = np.empty(len(head), dtype=np.uint16)
        self.units[: self.own] = 1 + np.arange(self.own)
        for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            self.units[grouped[a:b]] = self.first[g] + np.arange(b - a)
        self.units[self.vectors :] = [self.tail(w) for w, _ in head[self.vectors :]]
        self.mass, self.types = np.zeros(self.n_units), np.zeros(self.n_units)
        self.mass[END] = texts
        self.mass[self.units[: self.vectors]] = self.counts[: self.vectors]
        self.total = self.distinct = 0

    def tail(self, word: bytes) -> int:
        """The tail of the class that a word without vectors falls into."""
        return int(self.first[bisect(self.bounds, word[::-1]) + 1]) - 1

    def settle(self, tails: list[tuple[int, int, int]]) -> None:
        """Take in the counts and the numbers of words without vectors, by tail."""
        for unit, c, n in tails:
            self.mass[unit], self.types[unit] = c, n
        self.total = int(self.mass.sum())
        self.distinct = self.vectors + int(self.types.sum()) + (self.mass[END] > 0)

    def open(self) -> Vocabulary:
        """Tables that a worker makes once."""
        if not hasattr(self, "place"):
            words = self.words.split()
            self.place = dict(zip(words, range(len(words)), strict=True))
            self.logs = np.log10(self.counts + 0.5)
            self.tail_logs = np.log10(self.mass + 0.5 * (self.types + 1))
            #: A word's share of its tail; a word with vectors has none.
            self.share = np.where(np.arange(len(words)) < self.vectors, 0.0, self.logs - self.tail_logs[self.units])
        return self

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places in the head; -1: not there."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int32, count=len(words))

    def coded(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        """Units of the words and of the end."""
        out = np.empty(len(words) + 1, dtype=np.uint16)
        out[:-1] = self.units[places] if len(self.units) else 0
        rare = np.flatnonzero(places < 0)
        if len(rare):
            out[rare] = [self.tail(words[i]) for i in rare.tolist()]
        out[-1] = END
        return out


def gathered(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sums of their rows."""
    if not len(at):
        return at, rows
    order = np.argsort(at, kind="stable")
    at = at.take(order)
    last = np.flatnonzero(np.append(at[1:] != at[:-1], True))
    n = np.diff(last, prepend=-1)
    first = last - n + 1
    if 4 * len(last) < len(at):
        return at.take(last), np.add.reduceat(rows.take(order, 0), first, axis=0)
    # most places stand alone, and only the others are added up
    out, many = rows.take(order.take(last), 0), np.flatnonzero(n > 1)
    if len(many):
        size = n.take(many)
        starts = np.cumsum(size) - size
        out[many] = np.add.reduceat(rows.take(order.take(np.repeat(first.take(many) - starts, size) + np.arange(size.sum())), 0), starts, axis=0)
    return at.take(last), out


def stream(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row with CONTEXT ends before each, so that a token's context is simply what stands before it; and which places are their tokens."""
    lengths = np.array([len(x) for x in texts])
    stops = np.cumsum(lengths + CONTEXT - 1) + 1
    real = np.zeros(stops[-1] + RUN, dtype=bool)
    units = np.zeros(len(real), dtype=np.uint16)
    for x, stop in zip(texts, stops.tolist(), strict=True):
        units[stop - len(x) : stop] = x
        real[stop - len(x) : stop] = True
    return units, real


class LogBilinear:
    """With h = sum_i m_i * r_(context i): a class scores b_c + q_c . h, a unit inside its class a_u + w_u . h. Biases are the last columns of q and w."""

    NAMES = ("r", "m", "q", "w")

    def __init__(self, words: Vocabulary, seed: int = 11):
        draw, self.words, u, c = np.random.default_rng(seed), words, words.n_units, words.n_classes
        by_class = np.bincount(words.classes, words.mass, c) + 1
        grouped = np.arange(u) > words.own
        by_unit = np.where(grouped, words.mass + 0.5, 0.0)
        chances = by_class / by_class.sum(), by_unit / by_unit.sum()
        self.upto = [np.cumsum(x) for x in chances]
        logs = [np.log(np.maximum(x, 1e-300)).astype(np.float32) for x in chances]
        self.chance = [x + np.float32(np.log(NOISE)) for x in logs]
        normal = lambda n: draw.normal(0, 0.1, (n, DIM))
        self.parts = {"r": normal(u), "m": np.ones((CONTEXT, DIM)), "q": np.column_stack([normal(c), logs[0]]), "w": np.column_stack([normal(u), np.where(grouped, logs[1], 0)])}
        self.parts = {k: p.astype(np.float32) for k, p in self.parts.items()}
        #: Of each row, the sums of its gradients' squares: the mean over its vector, and of its bias.
        self.squares = {k: np.full((2, len(p)), 1e-8, dtype=np.float32) for k, p in self.parts.items()}
        #: How often each unit was met, and whether as noise.
        self.met, self.noise = np.zeros(u, dtype=np.int64), np.zeros(u, dtype=bool)

    def load(self, parts: dict[str, np.ndarray]) -> None:
        self.parts = {k: p.copy() for k, p in parts.items()}

    def climb(self, name: str, rows, gradient: np.ndarray) -> None:
        """An AdaGrad step for some rows, with one rate for a row's vector and one for its bias."""
        part, (of_vector, of_bias) = self.parts[name], self.squares[name]
        squares = of_vector.take(rows)
        squares += np.einsum("nd,nd->n", gradient[:, :DIM], gradient[:, :DIM]) / DIM
        of_vector[rows] = squares
        gradient[:, :DIM] *= (RATE / np.sqrt(squares))[:, None]
        if gradient.shape[1] > DIM:
            squares = of_bias.take(rows)
            squares += gradient[:, DIM] ** 2
            of_bias[rows] = squares
            gradient[:, DIM] *= RATE / np.sqrt(squares)
        gradient += part.take(rows, 0)
        part[rows] = gradient

    def contrast(self, h: np.ndarray, own: np.ndarray, name: str, level: int, draw: np.random.Generator) -> np.ndarray:
        """Noise-contrastive estimation at one level; the batch shares its noise. Climbs the outputs and returns what goes on to h, whose last column is 1."""
        outputs, chance, n = self.parts[name], self.chance[level], len(own)
        noise = np.minimum(np.searchsorted(self.upto[level], draw.random(NOISE), side="right"), len(outputs) - 1).astype(np.uint16)
        out_own, out_noise = outputs.take(own, 0), outputs.take(noise, 0)
        real = np.einsum("nd,nd->n", h, out_own)
        real -= chance.take(own)
        real = 0.5 - 0.5 * np.tanh(0.5 * real)  # 1 - sigma
        against = 0.5 * out_noise.T
        against[DIM] -= 0.5 * chance.take(noise)
        false = h @ against
        np.tanh(false, out=false)  # 2 sigma - 1
        rows = np.empty((n + NOISE, DIM + 1), dtype=np.float32)
        np.multiply((real / n)[:, None], h, out=rows[:n])
        rows[n:] = (false.T @ h + np.ones(n, dtype=np.float32) @ h) * (-0.5 / n)
        at, rows = gathered(np.concatenate([own, noise]), rows)
        out_noise *= -0.5
        to_h = false @ out_noise
        to_h += out_noise.sum(0)
        out_own *= real[:, None]
        to_h += out_own
        self.climb(name, at, rows)
        if level:
            self.noise[noise] = True
        return to_h[:, :DIM]

    def train(self, units: np.ndarray, real: np.ndarray, draw: np.random.Generator) -> None:
        """One step over runs of neighbouring tokens, each a row with the CONTEXT tokens before it. real: which tokens count."""
        m, (runs, width) = self.parts["m"], units.shape
        seen = self.parts["r"].take(units.ravel(), 0).reshape(runs, width, DIM)
        before = [seen[:, CONTEXT - 1 - i : width - 1 - i] for i in range(CONTEXT)]
        by = np.repeat(m[:, None], width - CONTEXT, axis=1)  # as wide as a run, which makes one long inner loop
        added = before[0] * by[0]
        for i in range(1, CONTEXT):
            added += before[i] * by[i]
        h = np.ones((runs, width - CONTEXT, DIM + 1), dtype=np.float32)
        h[:, :, :DIM] = added
        at = np.flatnonzero(real.ravel())
        if not len(at):
            return
        own, h = units[:, CONTEXT:].ravel().take(at), h.reshape(-1, DIM + 1).take(at, 0)
        to_h = self.contrast(h, self.words.classes.take(own), "q", 0, draw)
        some = np.flatnonzero(own > self.words.own)
        if len(some):
            to_h[some] += self.contrast(h.take(some, 0), own.take(some), "w", 1, draw)
        to_h /= len(at)
        whole = np.zeros((runs * (width - CONTEXT), DIM), dtype=np.float32)
        whole[at] = to_h
        whole = whole.reshape(runs, width - CONTEXT, DIM)
        to_m, to_r = np.empty_like(m), np.zeros_like(seen)
        for i in range(CONTEXT):
            to_m[i] = np.einsum("nkd,nkd->d", whole, before[i])
            to_r[:, CONTEXT - 1 - i : width - 1 - i] += whole * by[i]
        self.climb("m", np.arange(CONTEXT), to_m)
        self.climb("r", *gathered(units.ravel(), to_r.reshape(-1, DIM)))

    def learn(self, texts: list[np.ndarray], draw: np.random.Generator) -> int:
        """Train on whole coded texts, in batches of shuffled runs of tokens; how many tokens."""
        units, real = stream(texts)
        starts = draw.permutation(np.arange(CONTEXT, len(units) - RUN + 1, RUN))
        for at in range(0, len(starts), BATCH // RUN):
            some = starts[at : at + BATCH // RUN, None]
            self.train(units[some + np.arange(-CONTEXT, RUN)], real[some + np.arange(RUN)], draw)
        self.met += np.bincount(units[real], minlength=len(self.met))
        return int(real.sum())

    def of_texts(self, texts: list[np.ndarray]) -> list[float]:
        """Normalised log10 probabilities of whole coded texts, by their units."""
        units, real = stream(texts)
        places, lengths = np.flatnonzero(real), np.array([len(x) for x in texts])
        logs = np.concatenate([self.log10(units, places[at : at + SLICE]) for at in range(0, len(places), SLICE)])
        return np.add.reduceat(logs, np.cumsum(lengths) - lengths).tolist()

    def log10(self, units: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the units at some places of a stream."""
        r, m, q, w = (self.parts[k] for k in self.NAMES)
        own, first = units.take(places), self.words.first
        classes, moved = self.words.classes.take(own), [r * m[i] for i in range(CONTEXT)]
        h, out = np.ones((len(places), DIM + 1), dtype=np.float32), np.empty(len(places))
        for at in range(0, len(places), SCORED):
            some, here = places[at : at + SCORED], h[at : at + SCORED]
            before = moved[0].take(units.take(some - 1), 0)
            for i in range(1, CONTEXT):
                before += moved[i].take(units.take(some - 1 - i), 0)
            here[:, :DIM] = before
            out[at : at + SCORED] = _log_share(here, q, classes[at : at + SCORED])
        order = np.argsort(classes, kind="stable")
        edges = np.searchsorted(classes[order], np.arange(self.words.n_classes + 1))
        for g in range(len(first) - 1):
            rows, of = order[edges[1 + self.words.own + g] : edges[2 + self.words.own + g]], w[first[g] : first[g + 1]]
            for at in range(0, len(rows), SCORED):
                some = rows[at : at + SCORED]
                out[some] += _log_share(h.take(some, 0), of, own.take(some) - first[g])
        return out / np.log(10)


def _log_share(h: np.ndarray, outputs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of each row's own output, the natural log of its share of all outputs' exponentials."""
    y = h @ outputs.T
    # no exponential overflows or vanishes where all scores lie within 60
    longest = lambda x: float(np.einsum("nd,nd->n", x, x).max())
    if not longest(h) * longest(outputs) < 3600:
        y -= y.max(1)[:, None]
    mine = y.ravel().take(np.arange(0, y.size, y.shape[1]) + own)
    np.exp(y, out=y)
    return mine - np.log(y @ np.ones(y.shape[1], dtype=np.float32))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary) and c over whole texts; each task adds up its own first, some words at a time."""

    def batch(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def count(batches):
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(blank_words(text))
                if len(counts) > COUNTED:
                    yield batch(counts)
                    counts.clear()
        yield batch(counts)

    return mapped(texts.select("text"), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, texts: int, head: int = HEAD) -> tuple[Vocabulary, int]:
    """The vocabulary and the count from which words are in its head. counts: written."""
    # counts in steps of one, and finer than a hundredth above 4096
    step = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(64 * F.log2(F.col("c") / 4096.0))).cast("long")
    least, have = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r["step"]):
        have += r["n"]
        if have > head:
            break
        least = r["least"]
    least = least or 1 << 62
    words = Vocabulary([(bytes(r[0]), r[1]) for r in counts.filter(F.col("c") >= least).collect()], texts)
    sent = counts.sparkSession.sparkContext.broadcast(words)

    def tails(batches):
        known, mass, types = sent.value.open(), Counter(), Counter()
        for b in batches:
            for word, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if known.place.get(word, known.vectors) >= known.vectors:
                    unit = known.tail(word)
                    mass[unit] += c
                    types[unit] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (mass, mass.values(), types.values())], names=["unit", "c", "n"])

    by_tail = mapped(counts.select("word", "c"), tails, "unit long, c long, n long").groupBy("unit").agg(F.sum("c"), F.sum("n")).collect()
    words = Vocabulary([(w, int(c)) for w, c in zip(words.words.split(), words.counts, strict=True)], texts)
    words.settle([tuple(r) for r in by_tail])
    return words, least


CODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, units binary, word binary, n long"


def coded(texts: DataFrame, words: Vocabulary) -> DataFrame:
    """Rows of documents (word null) with their units, and of their words outside the head. To be written before use: row ids hold for one run.

    base and share lack the logs of the counts of words outside the head."""
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        known, part, row = sent.value.open(), TaskContext.get().partitionId(), 0
        log_all = np.log10(known.total + 0.5 * (known.distinct + 1))
        log_end = np.log10(known.mass[END] + 0.5)
        names = [f.split()[0] for f in CODED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int64()]
        for b in batches:
            ids, data = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ids), 1000):
                rows, sizes, rare, times = [], [], [], []
                for doc_id, text in zip(ids[lo : lo + 1000], data[lo : lo + 1000].to_pylist(), strict=True):
                    split = blank_words(text)
                    places = known.places(split)
                    units, n = known.coded(split, places), len(split) + 1
                    out, inside = np.flatnonzero(places < 0), places[places >= 0]
                    base = known.logs.take(inside).sum() + log_end - n * log_all
                    share = known.share.take(inside).sum() - known.tail_logs.take(units.take(out)).sum()
                    rows.append((part << 40 | row, doc_id, crc_mod_local(doc_id, 5) == 1, n, n - len(out) - (known.mass[END] == 0), base, share, units.tobytes()))
                    words = Counter([split[i] for i in out.tolist()])
                    sizes.append(len(words))
                    rare += words.keys()
                    times += words.values()
                    row += 1
                if rows:
                    some = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
                    yield pa.RecordBatch.from_arrays([*some, *[pa.nulls(len(rows), t) for t in types[8:]]], names=names)
                if rare:
                    rid = pa.array(np.repeat(np.arange(row - len(sizes), row) + (part << 40), sizes))
                    yield pa.RecordBatch.from_arrays([rid, *[pa.nulls(len(rare), t) for t in types[1:8]], pa.array(rare, types[8]), pa.array(times, types[9])], names=names)

    return mapped(texts.select("doc_id", "text"), run, CODED)


def _slices(batches, column: int):
    """Lists of (batch row, units) of SLICE tokens or so, with their batches' rows in order."""
    held, n = [], 0
    for b in batches:
        for row, units in enumerate(b.column(column).to_pylist()):
            held.append((b, row, np.frombuffer(units, dtype=np.uint16)))
            n += len(held[-1][2])
            if n >= SLICE:
                yield held
                held, n = [], 0
    if held:
        yield held


VALUES = [f"v{i}" for i in range(2 * DIM + 1)]


def fit(texts: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
    """Train on all rows of coded texts (column units). Per round, each partition goes on from the same parameters. The next start is, for a unit, the mean of the
    copies weighted by how often they met it; for classes, weighted by tokens."""
    spark, model = texts.sparkSession, LogBilinear(words)
    sent = spark.sparkContext.broadcast(words)
    for k in range(rounds):
        start = spark.sparkContext.broadcast(model.parts)

        def train(batches, start=start, k=k):
            own, draw, tokens = LogBilinear(sent.value), np.random.default_rng([k, TaskContext.get().partitionId()]), 0
            own.load(start.value)
            for held in _slices(batches, 0):
                tokens += own.learn([units for *_, units in held], draw)
            if tokens:
                p, weight = own.parts, own.met + own.noise
                at = np.flatnonzero(weight)
                zeros = lambda n, d: np.zeros((n, d), dtype=np.float32)
                c = len(p["q"])
                rows = np.concatenate([np.column_stack([p["w"][at], p["r"][at]]), np.column_stack([p["q"], zeros(c, DIM)]), np.column_stack([p["m"], zeros(CONTEXT, DIM + 1)])]).astype(np.float64)
                n = np.concatenate([weight[at], np.full(c + CONTEXT, tokens)])
                key = np.concatenate([at, len(weight) + np.arange(c + CONTEXT)]).astype(np.int32)
                values = np.rint(rows * n[:, None] * POINT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), *[pa.array(values[:, i]) for i in range(len(VALUES))]], names=["k", "n", *VALUES])

        copies = mapped(texts.select("units"), train, "k int, n long, " + ", ".join(f"{v} long" for v in VALUES))
        got = copies.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in VALUES]).toArrow()
        if got.num_rows:
            key, n = got.column("k").to_numpy(), got.column("n").to_numpy().astype(np.float64)
            mean = (np.column_stack([got.column(v).to_numpy() for v in VALUES]) / (n[:, None] * POINT)).astype(np.float32)
            p, u, c = {x: y.copy() for x, y in model.parts.items()}, words.n_units, words.n_classes
            of = key < u
            p["w"][key[of]], p["r"][key[of]] = mean[of, : DIM + 1], mean[of, DIM + 1 :]
            of = (key >= u) & (key < u + c)
            p["q"][key[of] - u] = mean[of, : DIM + 1]
            of = key >= u + c
            p["m"][key[of] - u - c] = mean[of, :DIM]
            model.load(p)
    return model


def scored(rows: DataFrame, model: LogBilinear) -> DataFrame:
    """The rows of documents of coded(), with model, their log10 probability by units, instead of the units."""
    sent = rows.sparkSession.sparkContext.broadcast((model.words, model.parts))
    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "share", "units"]

    def run(batches):
        known, parts = sent.value
        lbl = LogBilinear(known)
        lbl.load(parts)
        for b in batches:
            logs: list[float] = []
            for held in _slices([b], len(names) - 1):
                logs += lbl.of_texts([units for *_, units in held])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(logs, pa.float64())], names=[*names[:-1], "model"])

    return mapped(rows.select(*names), run, CODED[: CODED.index(", units")] + ", model double")


def score(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = _texts(docs)
    seen = texts.filter(crc_mod(F.col("doc_id"), 5) != 1)
    counts = written(word_counts(seen), "lm-counts")
    words, least = vocabulary(counts, seen.count(), head)
    whole = written(coded(texts, words), "lm-coded")
    rows = whole.filter("word is null")
    model = fit(rows.filter("not held_out"), words, rounds)
    c = F.coalesce("c", F.lit(0))
    rare = (
        whole.filter("word is not null").select("rid", "word", "n").join(counts.filter(F.col("c") < least), "word", "left")
        .groupBy("rid").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return scored(rows, model).join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("model") + F.col("share") + logs).alias("score"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
