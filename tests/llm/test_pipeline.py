"""Each stage of the pipeline against a plain version, on the driver's small table."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from nearledger.llm import quality
from nearledger.llm.common import written

from ..compare import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def strip(line):
    return line.strip(" \t\r\x0b\x0c")


def plain_lines(docs):
    """Earlier equal lines and lines within one edit go, all of them compared by deletions."""
    first, kept = {}, {}
    for d, text in docs:
        for i, x in enumerate(text.split("\n")):
            if len(strip(x)) >= 20:
                first.setdefault(strip(x), (d, i))
    by_key = defaultdict(list)
    for x, at in first.items():
        by_key["text", x].append((at, x))
        for i in range(len(x)):
            by_key["at", len(x), i, x[:i] + x[i + 1 :]].append((at, x))
            by_key["text", x[:i] + x[i + 1 :]].append((at, x))
    near = set()
    for key, same in by_key.items():
        least = min(same)
        if key[0] == "at":
            near |= {x for at, x in same if at > least[0]}
        else:
            for at, x in same:  # the text itself against longer ones
                own = x == key[1]
                if any(b < at for b, y in same if (y == key[1]) != own):
                    near.add(x)
    for d, text in docs:
        lines = text.split("\n")
        left = [x for i, x in enumerate(lines) if strip(x) not in first or (first[strip(x)] == (d, i) and strip(x) not in near)]
        after = "\n".join(left)
        if len(left) == len(lines) or (len(after) >= corpus_pipeline.SCRAPS * len(text) and after.strip(" \t\n\x0b\x0c\r")):
            kept[d] = after
    return kept


def plain_near(docs, words=5, similarity=0.8):
    sets = {}
    for d, text in docs:
        w = lower(text).split()
        sets[d] = frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
    up = {d: d for d in sets}
    ids = sorted(sets)
    for k, d in enumerate(ids):
        for e in ids[:k]:
            a, b = sets[d], sets[e]
            if up[d] != up[e] and min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                low, high = sorted((up[d], up[e]))
                up = {x: low if u == high else u for x, u in up.items()}
    return {d for d in ids if up[d] == d}


def plain_cut(docs, bench, n=10):
    windows, out = defaultdict(set), {}
    for text in bench:
        w = [lower(x) for x in WORD.findall(text)]
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows[min(n, len(w))].add(tuple(w[i : i + min(n, len(w))]))
    for d, text in docs:
        places = list(WORD.finditer(text))
        w, hit = [lower(m[0]) for m in places], set()
        for size, of in windows.items():
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in of:
                    hit.update(range(i, i + size))
        after, at, k = "", 0, 0
        while k < len(w):
            if k not in hit:
                k += 1
                continue
            end = k
            while end + 1 in hit:
                end += 1
            after += text[at : places[k].start()]
            at, k = places[end].end(), end + 1
        after += text[at:]
        if not hit or WORD.search(after):
            out[d] = after
    return out


def test_stages_against_plain_versions(spark):
    sf = str(DATA)
    rows = lambda df: sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    good = written(stage["quality"](spark, docs, sf), "t")
    scores = {r.doc_id: r.score for r in quality.op8_quality(spark, sf).collect()}
    assert rows(good) == [(d, x) for d, x in rows(docs) if scores[d] >= 0.5]
    assert 0.5 * docs.count() < good.count() < docs.count()

    lined = written(stage["repeated_lines"](spark, good, sf), "t")
    want = plain_lines(rows(good))
    assert dict(rows(lined)) == want
    assert {r.doc_id: r.n_chars for r in lined.collect()} == {d: len(x) for d, x in want.items()}

    single = written(stage["near_duplicates"](spark, lined, sf), "t")
    assert {d for d, _ in rows(single)} == plain_near(rows(lined))
    # on its whole table the stage leaves no pair of the asked similarity either
    assert {d for d, _ in rows(stage["near_duplicates"](spark, good, sf))} == plain_near(rows(good))

    clean = written(stage["benchmark_passages"](spark, single, sf), "t")
    bench = [r.text or "" for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert dict(rows(clean)) == plain_cut(rows(single), bench)

    packed = stage["packing"](spark, clean, sf).collect()
    length, by_doc = defaultdict(int), defaultdict(int)
    for r in sorted(packed, key=lambda r: r.offset):
        assert length[r.sequence_id] == r.offset
        length[r.sequence_id] += r.length
        by_doc[r.doc_id] += r.length
    assert by_doc.keys() == {d for d, _ in rows(clean)} and max(length.values()) <= 4096
