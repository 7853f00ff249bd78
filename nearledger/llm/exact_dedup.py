"""Exact dedup on a persistent digest index. DataFrame and SQL functions only.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one
candidate per digest before anything else is shuffled, the candidates that the index lacks
are found by a sort-merge anti-join, and only those are appended.

Edge cases: a null text counts as empty; texts of blanks only are equal to it; a null doc_id
loses against any other among equally long texts and may stay if it is alone; rows repeated with the same
doc_id form one group and each of them that bears the kept id is kept; an empty batch adds nothing and
yields an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, join_groups, table, written

#: What normalisation deletes: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text without blanks), n_points (code points of the original text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("n_points"),
    )


class DigestIndex:
    """The persistent index: digest, keep_id, n_points, batch. Opened again by its path, also in another session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        try:
            self.buckets = spark.read.parquet(f"{path}/meta").first()[0]
        except AnalysisException:
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/meta")
            self.buckets = buckets
        self.name = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()[:20]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, n_points BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/entries'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame, name: str) -> DataFrame:
        """Index a batch (from digests(), written) and return its groups: digest, keep_id, n_points, group_size, new.

        The row of most code points, then of the smallest doc_id, stands for its digest; a digest that
        is in the index already keeps the document that it has there. Adding a batch again adds nothing.
        """
        first = F.min(F.struct((-F.col("n_points")).alias("m"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i")))
        groups = written(
            batch.groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("f.i").alias("keep_id"), (-F.col("f.m")).alias("n_points"), "group_size"),
            "exact-groups",
        )
        groups.join(self.entries().hint("merge"), "digest", "left_anti").select(
            "digest", "keep_id", "n_points", F.lit(name).alias("batch")
        ).repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        held = self.entries().select("digest", F.col("keep_id").alias("held_id"), F.col("n_points").alias("held_points"), "batch")
        return groups.join(held.hint("merge"), "digest").select(
            "digest", F.col("held_id").alias("keep_id"), F.col("held_points").alias("n_points"), "group_size", (F.col("batch") == name).alias("new")
        )


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str = "all") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (rows of this batch), kept, digest, n_points."""
    rows = written(digests(docs), "exact-digests")
    groups = written(index.add(rows, batch).withColumnRenamed("n_points", "keep_points"), "exact-kept")
    kept = F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return join_groups(rows, groups, "digest", "group_size").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "n_points")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, fresh_dir(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return exact_dedup(table(spark, sf_dir, "documents"), index).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), k AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""
