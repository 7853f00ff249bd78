import pytest

#: Texts that operators must stand: null, empty, blanks, one word, repeats, ties, all kinds of characters, very long lines and texts.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "word"), (5, "word"), (5, "word"), (None, "word"), (None, None), (6, "Two words"), (7, "äöü ß 日本語 😀 é  x"),
    (8, "a" * 50_000), (9, "the quick brown fox jumps over the lazy dog\n" * 3_000), (10, "x y z " * 20_000), (11, "\u0000\u0001 nul"), (12, "!!! ??? ..."), (13, "line one is long enough here\r\nline one is long enough here\r\n"),
]
CLASHING = ["key", "digest", "fp", "n", "rid", "order", "line", "line_no", "row_hash", "word", "start", "end", "spans", "score", "x", "part", "rank", "length", "_d", "_r", "_n", "id", "found", "halves", "_n_exact", "_n_near", "_n_lines", "line_counts", "doc", "gone", "block", "n_words", "page_id"]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with columns of documents and names that clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    rows = [(i, t, "en", "s", len(t) if t else None, *[None if k % 2 else "c" for k in range(len(CLASHING))]) for i, t in ODD]
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id = -1")
