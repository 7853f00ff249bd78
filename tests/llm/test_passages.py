"""Benchmark passages are cut out alike in one block and in many."""

import random

from nearledger.llm import decontaminate


def test_removal_in_blocks_is_the_same(spark, monkeypatch):
    r = random.Random(2)
    text = [f"w{i}" for i in range(26)]
    pages = [" ".join(text)] + [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(pages), (99, None)], "doc_id long, text string")
    passages = [" ".join(text[:12]), " ".join(text[7:20])] + [" ".join(r.choice("abc") for _ in range(r.randrange(14))) for _ in range(30)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    key = lambda d: sorted(map(str, d.collect()))
    whole = [key(decontaminate.remove_spans(docs, items, drop_documents=drop)) for drop in (False, True)]
    assert any("w20 w21" in x and "w19" not in x for x in whole[0])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert [key(decontaminate.remove_spans(docs, items, drop_documents=drop)) for drop in (False, True)] == whole
