"""Line dedup by a deletion-neighbourhood join. DataFrame and SQL functions only.

A line goes if an earlier one (by doc_id, then line number) is equal to it or within one edit: one character more, less or
other. Lines are compared without blanks at their ends; lines of fewer than `least_chars` characters stay as they are.

1. Every line leaves the scan as an MD5 key and four hashes of its halves. One edit leaves one half as it was, so only
   lines that share a half's hash with another line can have a partner; the rest, nearly all, is done here.
2. Lines that are left give all their one-character deletions as hashed keys of 128 bits. The keys are running exclusive-ors over hashes of
   characters and their places, so a line of n characters costs n rows, not n texts, and no length overflows. Two keys are kept
   apart: deletion at a place (lines of equal length that share it differ in that character alone) and the deletion's whole text (shared
   with a line that is one shorter).
3. A key's earliest line stands for the key, by a minimum that is partly formed before the shuffle; each other line meets only that one.
   The edit distance is then verified on the texts.

The plan is the same at every size: suspects meet the lines by a sort-merge join, hot halves and variants alone (a thousand at most each) are broadcast. Lines' texts are shuffled once,
to meet the suspects, and whole texts once, to meet what goes.

Edge cases: null and empty texts and blank lines stay as they are; an occurrence at the same doc_id and line number as the earliest (repeated
rows) stays too; null ids come first; rows of one doc_id with different texts are told apart by their texts; extra columns of any name are kept; an empty table
gives an empty one; a line may be as long as a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, free_name, join_groups, table, written

LEAST_CHARS = 20

AT, LONG, SELF = 0, 1, 2

NEWLINE = "\n"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


HALVES = ["first_0", "last_0", "first_1", "last_1"]


def _halves(line: Column, n: Column) -> list[Column]:
    """Hashes of the halves: of a pair with at most one edit, whose shorter line has L characters, the first L // 2 or the last L - L // 2 agree."""
    out = []
    for short in (n, n - 1):
        half = F.floor(short / 2).cast("int")
        rest = (short - half).cast("int")
        out += [F.xxhash64(F.lit("first"), short, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit("last"), short, F.right(line, rest))]
    return [x.alias(name) for x, name in zip(out, HALVES, strict=True)]


def _order(doc_id: Column, line_no: Column) -> Column:
    """Place of a line among all, as one number that aggregates in place; null ids first."""
    return (F.coalesce(doc_id, F.lit(-(1 << 63))).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")).cast("decimal(38,0)")


def _place(order: Column) -> tuple[Column, Column]:
    """doc_id (the least number for null) and line number of an order."""
    each = F.lit(1 << 31).cast("decimal(10,0)")
    line_no = F.pmod(order, each).cast("decimal(10,0)")
    return F.call_function("div", order - line_no, each).cast("long"), line_no.cast("int")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash (of the text), line_no (from 0) and line (trimmed) of all lines that count."""
    split = F.split(F.coalesce("text", F.lit("")), NEWLINE, -1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.posexplode(split).alias("line_no", "line"))
    return rows.withColumn("line", trimmed(F.col("line")))


def _long(rows: DataFrame, least_chars: int) -> DataFrame:
    return rows.filter(F.length("line") >= least_chars)


def suspects(first: DataFrame) -> DataFrame:
    """doc, line_no, id, edit_late, edit_early of lines that share a half with another line, and where an edit may be. first: written, one row per distinct line."""
    doc, line_no = _place(F.col("order"))
    placed = first.select("id", doc.alias("doc"), line_no.cast("long").alias("line_no"), *HALVES)
    halves = placed.select("id", "doc", "line_no", F.posexplode(F.array(*HALVES)).alias("which", "half")).select("half", "id", "doc", (F.col("line_no") * 4 + F.col("which")).alias("place"))
    # a line's four hashes differ, so a half that occurs twice is shared
    shared = written(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "line-halves")
    which = F.col("place") % 4
    hit = join_groups(halves, shared, "half", "n").groupBy("doc", F.floor(F.col("place") / 4).cast("int").alias("line_no"), "id").agg(
        F.max(which.isin(0, 2)).alias("edit_late"), F.max(which.isin(1, 3)).alias("edit_early")
    )
    hit = written(hit, "line-suspects")
    discard(shared)
    return hit


def within_one(x: Column, y: Column) -> Column:
    """Whether two texts are within one edit: what follows their first difference agrees. That place is found by halving, since levenshtein() takes
    quadratic time, also with a threshold."""
    n, m = F.length(x), F.length(y)
    middle = lambda a: F.floor((a["low"] + a["high"] + 1) / 2).cast("int")
    agrees = lambda a: F.left(x, middle(a)) == F.left(y, middle(a))
    start = F.struct(F.lit(0).alias("low"), F.least(n, m).alias("high"))
    halved = lambda a, _: F.when(a["low"] == a["high"], a).when(agrees(a), F.struct(middle(a).alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), (middle(a) - 1).alias("high")))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halved)["low"]
    rest = lambda line, skip: F.substring(line, at + 1 + skip, F.greatest(n, m))
    return F.when(n == m, rest(x, 1) == rest(y, 1)).when(n == m + 1, rest(x, 1) == rest(y, 0)).when(n + 1 == m, rest(x, 0) == rest(y, 1)).otherwise(False)


def near_lines(first: DataFrame, rows: DataFrame) -> DataFrame:
    """order and id of lines with an earlier line within one edit. first: written, one row per distinct line; rows: lines() of the documents."""
    hit = suspects(first)
    # the text of a line is fetched where it stands first
    doc = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")
    placed = rows.select(doc, "line_no", F.xxhash64("line").alias("id"), "line", _order(F.col("doc_id"), F.col("line_no")).alias("order"))
    texts = placed.join(hit.hint("merge"), ["doc", "line_no", "id"]).select("order", "id", "edit_late", "edit_early", "line")
    texts = written(texts.dropDuplicates(["order", "id"]), "line-texts")
    discard(hit)

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(parts, "order", "id")  # a character becomes up to three rows; the windows below go by these: rows of characters are not shuffled again
    chars = dealt.select("order", "id", "edit_late", "edit_early", F.regexp_extract_all("line", F.lit("(?s)."), 0).alias("chars"))
    mixed = lambda seed, at, c: F.xxhash64(F.lit(seed), at, c)
    total = lambda seed, back: F.aggregate(F.transform("chars", lambda c, i: mixed(seed, i - back, c)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    # summed up before the characters become rows
    chars = chars.withColumns({"n_chars": F.size("chars"), **{f"whole_{s}": total(s, 0) for s in (1, 2)}, **{f"moved_{s}": total(s, 1) for s in (1, 2)}})
    whole = chars.select(*[c for c in chars.columns if c != "chars"], F.posexplode("chars").alias("i", "c"))
    upto = Window.partitionBy("order", "id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = {s: mixed(s, F.col("i"), F.col("c")) for s in (1, 2)}
    both = {s: here[s].bitwiseXOR(mixed(s, F.col("i") - 1, F.col("c"))) for s in (1, 2)}
    # what stands before a character, at its place, and what follows it, moved up by one
    left = whole.withColumns({f"left_{s}": F.bit_xor(both[s]).over(upto).bitwiseXOR(here[s]).bitwiseXOR(F.col(f"moved_{s}")) for s in (1, 2)})
    wanted = (F.col("edit_late") & (F.col("i") >= F.floor((F.col("n_chars") - 1) / 2))) | (F.col("edit_early") & (F.col("i") <= F.floor(F.col("n_chars") / 2)))

    def make(kind: int, tag: str, *of: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(tag), *of).alias("v"), F.xxhash64(*reversed(of), F.lit(tag)).alias("w"), F.lit(kind).cast("byte").alias("kind"))

    # AT: a character taken out at a place; LONG: the text that this leaves; SELF: the text of the line itself
    n, a, b = F.col("n_chars"), F.col("left_1"), F.col("left_2")
    keys = F.filter(
        F.array(
            F.when(wanted, make(AT, "at", n, F.col("i"), a, b)),
            F.when(wanted, make(LONG, "text", n - 1, a, b)),
            F.when(F.col("i") == 0, make(SELF, "text", n, F.col("whole_1"), F.col("whole_2"))),
        ),
        lambda x: x.isNotNull(),
    )
    variants = written(left.select("order", "id", F.explode(keys).alias("k")).select("k.v", "k.w", "k.kind", "order", "id"), "line-variants")
    # nearly all variants occur once, so that what a task holds of each is kept small; a line that has one twice meets itself below, in vain
    least = variants.groupBy("v", "w").agg(
        F.min(F.when(F.col("kind") != SELF, F.col("order"))).alias("long"), F.min(F.when(F.col("kind") == SELF, F.col("order"))).alias("self"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    least = written(least, "line-variants-met")
    # lines that share a place differ there alone; a longer line meets the text that it leaves, and that text the earliest longer one
    by = F.when(F.col("kind") == LONG, F.col("self")).otherwise(F.col("long"))
    pairs = join_groups(variants, least, ["v", "w"], "n").withColumn("by", by).filter(F.col("by") < F.col("order"))
    pairs = written(pairs.select("order", "id", "by").distinct(), "line-pairs")
    discard(variants, least)
    side = texts.select("order", "id", "line")
    checked = pairs.join(side, ["order", "id"]).join(side.select(F.col("order").alias("by"), F.col("line").alias("by_line")), "by")
    return checked.filter(within_one(F.col("line"), F.col("by_line"))).select("order", "id").distinct()


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, near: bool = True) -> DataFrame:
    """doc_id, row_hash, line_no, near (not equal to an earlier line, but within an edit) of each line that goes."""
    rows = _long(lines(docs), least_chars)
    keyed = written(rows.select("doc_id", "row_hash", "line_no", _key(F.col("line")).alias("key"), F.xxhash64("line").alias("id"), *_halves(F.col("line"), F.length("line"))), "line-keys")
    first = keyed.groupBy("key").agg(F.min(_order(F.col("doc_id"), F.col("line_no"))).alias("order"), F.count(F.lit(1)).alias("n"), F.max("id").alias("id"), *[F.max(h).alias(h) for h in HALVES])
    first = written(first, "line-first")
    repeated = first.select("key", "order", "id", "n")
    if near:
        gone = written(near_lines(first, rows).withColumn("gone", F.lit(True)), "line-near")
        repeated = repeated.join(gone, ["order", "id"], "left").filter("n > 1 or gone").withColumn("gone", F.coalesce("gone", F.lit(False)))
    else:
        repeated = repeated.filter("n > 1").withColumn("gone", F.lit(False))
    repeated = written(repeated.select("key", F.col("order").alias("first_order"), "n", "gone"), "line-gone")
    discard(first)
    met = join_groups(keyed.select("doc_id", "row_hash", "line_no", "key"), repeated, "key", "n")
    is_first = _order(F.col("doc_id"), F.col("line_no")) == F.col("first_order")
    return met.filter(F.col("gone") | ~is_first).select("doc_id", "row_hash", "line_no", is_first.alias("near"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, near: bool = True) -> DataFrame:
    """The documents without repeated lines, all columns kept, and as the last column a struct: n_lines, n_exact, n_near and left, the
    share of the text's characters that stay (1 for an empty text). It is called line_counts, or that with underscores where documents have such a column."""
    drops = dropped_lines(docs, least_chars, near).groupBy("doc_id", "row_hash").agg(
        F.collect_set("line_no").alias("gone"), F.countDistinct(F.when(F.col("near"), F.col("line_no"))).alias("n_near")
    )
    drops = written(drops, "line-drops")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))  # so that no name clashes
    before = F.col("doc.text")
    met = rows.join(drops, F.col("doc.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(before) == F.col("row_hash")), "left")
    met = met.withColumn("lines", F.split(F.coalesce(before, F.lit("")), NEWLINE, -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    met = met.withColumn("after", F.when(F.col("gone").isNull(), before).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), NEWLINE)))
    n_gone, n_near = F.coalesce(F.size("gone"), F.lit(0)).cast("long"), F.coalesce("n_near", F.lit(0)).cast("long")
    n_gone = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n_gone).cast("long")
    left = F.when(F.col("gone").isNull(), F.lit(1.0)).otherwise(F.length("after") / F.length(before))
    counts = F.struct(F.size("lines").cast("long").alias("n_lines"), (n_gone - n_near).alias("n_exact"), n_near.alias("n_near"), left.alias("left"))
    return met.select(*[(F.col("after") if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns], counts.alias(free_name("line_counts", docs.columns)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    counts = [F.col(out.columns[-1])[c].alias(c) for c in ("n_lines", "n_exact", "n_near")]
    return out.select("doc_id", *counts, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP7_SQL = r"""
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), l AS (
  SELECT doc_id, i AS line_no, a[i + 1] AS raw, trim(a[i + 1], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM (SELECT doc_id, a, unnest(range(len(a))) AS i FROM s)
), f AS (
  SELECT line, min((doc_id, line_no)) AS o, length(line) AS n FROM l WHERE length(line) >= 20 GROUP BY line
), h AS (
  SELECT line, o, n, m, 'p' || m || ':' || line[: m // 2] AS k FROM (SELECT *, unnest([n, n - 1]) AS m FROM f)
  UNION ALL SELECT line, o, n, m, 's' || m || ':' || line[n - (m - m // 2) + 1 :] FROM (SELECT *, unnest([n, n - 1]) AS m FROM f)
), p AS (
  SELECT DISTINCT a.line AS x, b.line AS y FROM h a JOIN h b ON a.k = b.k AND b.o < a.o AND abs(a.n - b.n) <= 1
), near AS (
  SELECT DISTINCT x FROM p WHERE CASE
    WHEN length(x) = length(y) THEN len(list_filter(range(1, length(x) + 1), lambda i: x[: i - 1] = y[: i - 1] AND x[i + 1 :] = y[i + 1 :])) > 0
    WHEN length(x) > length(y) THEN len(list_filter(range(1, length(x) + 1), lambda i: x[: i - 1] || x[i + 1 :] = y)) > 0
    ELSE len(list_filter(range(1, length(y) + 1), lambda i: y[: i - 1] || y[i + 1 :] = x)) > 0 END
), d AS (
  SELECT l.doc_id, l.line_no, l.raw, f.line IS NOT NULL AND f.o <> (l.doc_id, l.line_no) AS exact, near.x IS NOT NULL AND f.o = (l.doc_id, l.line_no) AS near
  FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near ON l.line = near.x
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT exact AND NOT near), '')) AS text_sha256
FROM d GROUP BY doc_id
"""
