"""Exact deduplication against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest, that outlives
a run.  A batch is summed to one row for each digest, which also merges copies
before any shuffle, and meets the index in a sort-merge anti-join in which the
index side is not shuffled.  Digests that the index lacks are appended.

Texts are equal when they are identical after deleting white space.  Of equal
texts within a batch the row with the most code points stays, then the
smallest id (a null id comes last), then one of the repeated rows.  A text
that an earlier batch brought in is dropped whole.  A null text counts as
empty, and all empty texts are equal.  An empty batch changes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.llm.columns import SPACE, join_groups, named, own, whole
from shopgrain.sources import files
from shopgrain.sources.shared import materialize


def text_digest(text: str) -> Column:
    """SHA-256 of the text without white space, as lower-case hex."""
    return F.sha2(F.regexp_replace(whole(named(text)), SPACE, ""), 256)


@dataclass(frozen=True)
class DigestIndex:
    """Digests of all texts kept so far, under one folder on shared storage."""

    spark: SparkSession
    table: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None) -> DigestIndex:
        """The index at ``path``, made there if it is new.

        ``buckets`` holds for a new index only (default: the shuffle
        partitions of the session); a later run uses what is stored.
        """
        layout = f"{path}/layout"
        if not files.exists(spark, f"{layout}/_SUCCESS"):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(n).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(layout)
        n = spark.read.parquet(layout).first()["buckets"]
        table = "digests_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{path}/digests'"
        )
        return cls(spark, table, n)

    def known(self, batch: str) -> DataFrame:
        """Digests of earlier batches; what a failed try of this batch has left does not count."""
        return self.spark.table(self.table).filter(F.col("batch") != batch).select("digest", "keep_id")

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Add digests (digest, keep_id); those that a failed try of the batch has added stay single."""
        there = self.spark.table(self.table).select("digest")
        new = fresh.hint("merge").join(there, "digest", "left_anti")
        rows = new.select("digest", "keep_id", F.lit(batch).alias("batch"))
        # One file for each bucket: the rows are dealt as the table's buckets are.
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)


def verdicts(
    docs: DataFrame, index: DigestIndex, batch: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256; the batch enters the index.

    ``keep_id`` is the id of the row that stays, maybe of an earlier batch;
    ``group_size`` counts the equal texts of this batch, its own included.
    """
    rows = materialize(docs.select(
        named(id_column).alias("doc_id"), F.length(whole(named(text_column))).alias("n"),
        text_digest(text_column).alias("digest"), F.monotonically_increasing_id().alias("row"),
    ))
    best = F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = materialize(groups.select("digest", "group_size", "best.doc_id", "best.row"))
    known = index.known(batch).withColumnRenamed("keep_id", "known_id").withColumn("old", F.lit(True))
    judged = groups.hint("merge").join(known, "digest", "left").select(
        "digest", "group_size",
        F.when(F.col("old"), F.col("known_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.when(F.col("old").isNull(), F.col("row")).alias("keep_row"),
    )
    judged = materialize(judged)
    index.append(groups.select("digest", F.col("doc_id").alias("keep_id")), batch)
    return join_groups(rows, judged, "digest", "group_size").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def unique(
    docs: DataFrame, index: DigestIndex, batch: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents that stay, all columns whole; the batch enters the index.

    Copies meet in an aggregation that merges them before the shuffle, so a
    text is sent once from each task, however many copies there are.
    """
    digest, order, row = own(docs, "digest", "order", "row")
    cols = [named(c) for c in docs.columns]
    keyed = docs.select(
        text_digest(text_column).alias(digest),
        F.struct(
            (-F.length(whole(named(text_column)))).alias("n"), named(id_column).isNull().alias("none"),
            named(id_column).alias("id"), F.xxhash64(*cols).alias("hash"),
        ).alias(order),
        F.struct(*cols).alias(row),
    )
    # Digests are written before they meet the index: an anti-join would be moved below the aggregation.
    groups = materialize(keyed.groupBy(digest).agg(F.min(order).alias(order)).select(
        F.col(digest).alias("digest"), F.col(order)["id"].alias("keep_id")
    ))
    fresh = materialize(groups.hint("merge").join(index.known(batch).select("digest"), "digest", "left_anti"))
    index.append(fresh, batch)
    best = keyed.groupBy(digest).agg(F.min_by(row, order).alias(row))
    return best.join(fresh.select(F.col("digest").alias(digest)), digest).select(f"{row}.*")
