"""Licence scan: exact phrases, and short notices found with bounded edits.

A notice of m characters that may differ in k edits is split into k + 1 pieces, one of which must occur exactly
(pigeonhole). One automaton finds the pieces of all notices in one pass over the normalised text; around each hit the
regex library checks the notice with at most k edits and gives the span. Texts are scanned whole, in one narrow step without a shuffle.

Edge cases: null, empty and wordless texts give no words, places or labels and score 0; overlapping places of a
phrase all count; repeated rows each give a row; a null doc_id stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, plain_words, table

#: Phrases that count as they stand, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices found with edits: (words, label, edits).
NOTICES = (
    ("this work is licensed under the gnu general public license", "gpl-notice", 4),
    ("under the terms of the gnu general public license", "gpl-notice", 4),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("licensed under the apache license version 2 0", "apache-2.0-notice", 3),
    ("licensed under cc by nc 4 0", "cc-by-nc-notice", 1),
    ("licensed under cc by sa 4 0", "cc-by-sa-notice", 1),
    ("creative commons attribution", "creative-commons", 2),
    ("permission is hereby granted free of charge to any person", "mit-notice", 5),
    ("licensed under the mit license", "mit-notice", 3),
    ("redistribution and use in source and binary forms", "bsd-notice", 4),
    ("mozilla public license", "mpl", 2),
    ("dedicated to the public domain", "public-domain", 2),
    ("all rights reserved", "all-rights-reserved", 1),
)

REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans array<struct<label:string,start:int,end:int,edits:int>>, score double"
SPAN = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """Offset and text of the edits + 1 pieces."""
    cuts = [round(k * len(notice) / (edits + 1)) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def words_before(text: str, places: list[int]) -> list[int]:
    """Blanks before each place, by one look at the text."""
    if not places:
        return []
    points = np.frombuffer(text.encode(), dtype=np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.searchsorted(np.flatnonzero(points == 0x20), places).tolist()


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices=NOTICES):
        import ahocorasick

        self.phrases, self.notices = {f" {k} ": v for k, v in phrases.items()}, notices
        self.patterns = [regex.compile(rf"(?e)(?<= )(?:{regex.escape(n)}){{e<={k}}}(?= )") for n, _, k in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _, edits) in enumerate(notices):
            for at, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.seeds.add_word(piece, (len(piece), of))
        self.seeds.make_automaton()

    def places(self, text: str) -> list[tuple[int, str]]:
        """Word index and label of each place of a phrase."""
        out = []
        for phrase, label in self.phrases.items():
            at = text.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = text.find(phrase, at + 1)
        return list(zip(words_before(text, [x for x, _ in out]), [x for _, x in out], strict=True))

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int]]:
        """Label, first word, end word and edits of each notice."""
        windows: dict[int, list[list[int]]] = {}
        for end, (n, of) in self.seeds.iter(text):
            for i, at in of:
                edits, start = self.notices[i][2], end + 1 - n - at
                a, b = max(0, start - edits - 1), min(len(text), start + len(self.notices[i][0]) + edits + 1)
                own = windows.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
                else:
                    own.append([a, b])
        out = []
        for i, own in windows.items():
            for a, b in own:
                for m in self.patterns[i].finditer(text, a, b):
                    out.append((self.notices[i][1], m.start(), m.end(), sum(m.fuzzy_counts)))
        starts, ends = words_before(text, [x[1] for x in out]), words_before(text, [x[2] for x in out])
        return [(label, a - 1, b, k) for (label, _, _, k), a, b in zip(out, starts, ends, strict=True)]

    def scan(self, data: bytes) -> tuple:
        words = plain_words(data)
        text = f" {b' '.join(words).decode('utf-8', 'replace')} "  # an edit is a character, not a byte
        base, spans = self.places(text), self.fuzzy(text)
        starts = [x[0] for x in base]
        most = {label: edits + 1 for _, label, edits in self.notices}
        score = 1.0 if base else max((1 - x[3] / most[x[0]] / 2 for x in spans), default=0.0)
        return len(words), len(base), min(starts, default=None), max(starts, default=None), sorted({x[1] for x in base}), sorted(set(spans), key=lambda x: (x[1], x[0])), score


@cache
def scanner() -> Scanner:
    return Scanner()


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, spans (label, start and end word, edits), score."""

    def scan(batches):
        find = scanner().scan
        for b in batches:
            got = list(zip(*map(find, b.column(1).to_pylist()), strict=True)) or [()] * 7
            spans = [[dict(zip(("label", "start", "end", "edits"), s, strict=True)) for s in row] for row in got[5]]
            long = [pa.array(c, pa.int64()) for c in got[:4]]
            yield pa.RecordBatch.from_arrays([b.column(0), *long, pa.array(got[4], pa.list_(pa.string())), pa.array(spans, pa.list_(SPAN)), pa.array(got[6], pa.float64())], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), scan, REPORT)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda s: s["label"]))))
    return license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), "score"
    )
