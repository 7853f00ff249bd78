"""Operators that SQL can't express against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash

from nearledger.llm import registry

from ..compare import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLANK, PLAIN = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, name):
    return registry.QUERIES[name](spark, str(DATA)).collect()


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def test_license_scan(spark, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in run(spark, "op1_license_scan"):
        words = PLAIN.findall(docs[r.doc_id].translate(LOWER))
        places = [(i, v) for i in range(len(words)) for k, v in phrases.items() if words[i : i + len(k.split())] == k.split()]
        starts = [i for i, _ in places]
        base = sorted({v for _, v in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base))
        assert set(base) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_simhash(spark, docs):
    def fingerprint(text):
        words = BLANK.findall(text.translate(LOWER))
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = run(spark, "op4_simhash")
    fps = {i: fingerprint(t) for i, t in docs.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    up = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for i in docs:
            for j in docs:
                if up[i] > up[j] and bin(fps[i] ^ fps[j]).count("1") <= 2:
                    up[i], changed = up[j], True
    assert {r.doc_id: r.component_id for r in got} == up


def test_pii(spark, docs):
    kinds = [
        ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
        ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
    ]

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    for r in run(spark, "op5_pii"):
        out = []
        for kind, p in kinds:
            for m in p.finditer(docs[r.doc_id]):
                d = re.sub("[^0-9]", "", m.group())
                if {"ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}.get(kind, lambda: True)():  # noqa: B023
                    out.append(f"{kind}:{m.start()}:{m.end()}")
        assert r.base_sha256 == hashlib.sha256(",".join(out).encode()).hexdigest()
        assert set(out) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in out) for k, _ in kinds]


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, text in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            x = ids[k : k + 4096]
            want[i, k // 4096] = k, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())
    got = run(spark, "op6_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    by: dict = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert by.setdefault(r.sequence_id, 0) == r.offset
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 4096
    assert len(by) <= 1.02 * -(-sum(by.values()) // 4096) + 1


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in run(spark, "op8_quality")}
    assert all(r.held_out == (crc(i, 3) == 1) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 10 and np.mean([a == b for a, b in held]) > 0.9


def test_lm_base_scores(spark, docs):
    words = {i: BLANK.findall(t.translate(LOWER)) + ["\n"] for i, t in docs.items()}
    counts = Counter(w for i, x in words.items() if crc(i, 5) != 1 for w in x)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in run(spark, "op9_lm_score")}
    assert got.keys() == docs.keys()
    for i, x in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 5) == 1, len(x), sum(w in counts for w in x), n)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel=1e-9)
    held = [i for i in docs if crc(i, 5) == 1]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
