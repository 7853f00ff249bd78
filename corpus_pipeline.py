"""From raw documents to packed training sequences: quality, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. run() writes each stage's rows to the shared folder and reads them again as the next one's.

Edge cases: a null, empty or blank text is scored like any other by the classifier, loses no lines, is a near duplicate of any other such
text, has no benchmark passages and is packed as its end id; null ids come first among lines and last among near duplicates; of rows repeated whole, one stays;
other columns, of any name, go along; an empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearledger.llm.common import table, written
from nearledger.llm.decontaminate import remove_spans
from nearledger.llm.line_dedup import dedup_lines
from nearledger.llm.packing import pack
from nearledger.llm.quality import keep_good
from nearledger.llm.simhash import keep_one


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; texts stay as they are."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


#: A document that keeps less than this share of its characters after line dedup is a copy of earlier ones: what is left are scraps.
SCRAPS = 0.1


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of an earlier document, or within an edit of one, go. A document of which only blanks or less than SCRAPS is left goes with them;
    one that loses nothing stays as it is, also if it is null, empty or blank."""
    out = dedup_lines(docs)
    left = F.col(out.columns[-1])["left"]
    return _counted(out.filter((left == 1) | ((left >= SCRAPS) & F.col("text").rlike(r"[^\x20\x09-\x0D]"))).select(*[F.col(f"`{c}`") for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by fingerprints and by shared shingles, the document with the smallest id stays."""
    return keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document of which no word is left goes."""
    return _counted(remove_spans(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their places in the sequences."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
