"""What the operators share: words, tables, joins that survive hot keys."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..package import mapped  # noqa: F401  these four for the operators
from ..sources.store import discard  # noqa: F401
from ..sources.store import stored as written  # noqa: F401
from ..sources.store import work_dir as fresh_dir  # noqa: F401

#: A side of at most so many narrow rows (some 50 MB as a hash table) may be broadcast once it is written and counted.
BROADCAST_ROWS = 500_000
#: A key with at least one row in so many is hot, so there are no more hot keys than this and their rows may be broadcast.
HOT_SHARE = 1000
#: [^\x20\x09-\x0D]+ over bytes: every ASCII blank becomes a space, A-Z becomes a-z.
BLANK_WORDS = bytes(0x20 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, a-z and every byte of a non-ASCII character.
PLAIN_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 0x20 for c in range(256))


def blank_words(text: bytes) -> list[bytes]:
    """Lower-cased words between blanks. split(b" ") with a filter, since bytes.split() has the same ASCII blanks."""
    return text.translate(BLANK_WORDS).split()


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN_WORDS).split()


def slices(batches, rows: int = 500):
    """The batches in parts of so many rows, so that a kernel never holds a whole one's texts as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(rows: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if its count allows it; beyond that, the join shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores before it as long as there is such a column."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def crc_mod_local(doc_id, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """Inner join of rows with groups (one row a key, of one or several columns; weight: how many rows have it), for keys of any heat.

    Keys with a thousandth of all rows or more, a thousand at most, are broadcast;
    the rest is an ordinary join. Both inputs should be written tables: they are read more than once.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    large = groups.filter(hot & (F.col(weight) > 1)).withColumn("_hot", F.lit(True))
    names = [c for c in groups.columns if c not in ([key] if isinstance(key, str) else key)]
    marked = rows.join(F.broadcast(large), key, "left")
    small = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(groups.filter(~(hot & (F.col(weight) > 1))), key)
    out = [*rows.columns, *names]
    return marked.filter(F.col("_hot").isNotNull()).select(*out).unionByName(small.select(*out))
