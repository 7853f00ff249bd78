"""The pipeline's stages against brute force."""

import random

import pytest

from nearledger.llm import simhash


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def components(texts):
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if up[i] != up[j] and jaccard(texts[i], texts[j]) >= 0.8:
                up = [up[j] if x == up[i] else x for x in up]
    return [min(k for k, x in enumerate(up) if x == u) for u in up]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.component_id for r in sorted(simhash.similar(docs).collect())]


def words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def family(r, n, copies):
    """Pages of one template, 0.75 alike, and copies of some of them."""
    head, tail = words(r, 180), words(r, 170)
    pages = [[*head, *words(r, 55), *tail] for _ in range(n)]
    for k in range(copies):
        page = list(pages[k])
        at = 185 + r.randrange(20)
        page[at : at + 24] = words(r, 24)
        pages.append(page)
    r.shuffle(pages)
    return [" ".join(p) for p in pages]


@pytest.mark.parametrize("common", [2_000_000, 50])
def test_copies_inside_a_template_family(spark, monkeypatch, common):
    monkeypatch.setattr(simhash, "COMMON", common, raising=False)
    texts = family(random.Random(5), 120, 30)
    want = components(texts)
    assert sum(i != c for i, c in enumerate(want)) == 30
    assert found(spark, texts) == want


def test_copies_with_any_kind_of_edit(spark):
    r, texts, pairs = random.Random(8), [], []
    for k in range(120):
        page = words(r, 400)
        other, part = list(page), r.randrange(70, 96)
        if k % 3 == 0:
            other += words(r, part)  # a footer
        elif k % 3 == 1:
            at = r.randrange(300)
            other[at : at + part // 2] = words(r, part // 2)  # a paragraph
        else:
            for at in range(0, 400, 4000 // part):
                other[at] = words(r, 1)[0]  # single words
        pairs.append(jaccard(" ".join(page), " ".join(other)))
        texts += [" ".join(page), " ".join(other)]
    assert all(sum(x >= 0.8 for x in pairs[k::3]) >= 20 for k in range(3)) and min(pairs) < 0.8
    assert found(spark, texts) == [2 * (i // 2) if pairs[i // 2] >= 0.8 else i for i in range(len(texts))]


def test_fingerprints_link_what_shingles_do_not(spark):
    """The stage's groups are those of fingerprints within two bits, too."""
    r = random.Random(3)
    base, tail = words(r, 31) * 20, words(r, 12)
    texts = [" ".join(base), " ".join([*base, *tail]), " ".join(words(r, 60))]
    a, b = (simhash.fingerprint(x.encode()) for x in texts[:2])
    assert (a ^ b).bit_count() <= 2 and jaccard(*texts[:2]) < 0.8
    docs = spark.createDataFrame([*enumerate(texts), (3, None), (4, " ")], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == [0, 2, 3]
