"""Token counts with a digest cache.

Counts are stored under the digest of the content and the digest of the
tokenizer (its file and library), bucketed by content.  A run reduces its
documents to distinct contents, keeps those that the cache lacks, encodes
each of them once, appends the counts, and joins all documents to the cache.

A null text counts as empty and has no tokens.  Equal texts share one entry
and each row gets its own line.  An empty table gives no rows and leaves the
cache as it was.  Texts are encoded whole; a task holds a batch at a time.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.llm.columns import join_groups, named, whole
from shopgrain.llm.tokens import count_pieces, file_digest
from shopgrain.sources import files
from shopgrain.sources.shared import materialize

LIMIT = 4096


@dataclass(frozen=True)
class TokenCache:
    """Stored counts of one tokenizer, under a folder on shared storage that all tokenizers share."""

    spark: SparkSession
    table: str
    buckets: int
    tokenizer_path: str
    tokenizer: str

    @classmethod
    def open(cls, spark: SparkSession, path: str, tokenizer_path: str, buckets: int | None = None) -> TokenCache:
        """The cache at ``path``, made there if it is new; ``buckets`` holds for a new one only."""
        layout = f"{path}/layout"
        if not files.exists(spark, f"{layout}/_SUCCESS"):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(n).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(layout)
        n = spark.read.parquet(layout).first()["buckets"]
        table = "token_counts_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, tokenizer STRING, n_tokens BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{path}/counts'"
        )
        version = f"sentencepiece {importlib.metadata.version('sentencepiece')} {file_digest(tokenizer_path)}"
        return cls(spark, table, n, tokenizer_path, hashlib.sha256(version.encode()).hexdigest())

    def counts(self) -> DataFrame:
        mine = self.spark.table(self.table).filter(F.col("tokenizer") == self.tokenizer)
        return mine.select("digest", "n_tokens")

    def add(self, missing: DataFrame) -> None:
        """Encode distinct missing contents (digest, text) and store their counts."""
        path = self.tokenizer_path

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = pa.array(count_pieces(path, b.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("digest"), n], ["digest", "n_tokens"])

        counted = missing.mapInArrow(encode, "digest string, n_tokens bigint")
        rows = counted.select("digest", F.lit(self.tokenizer).alias("tokenizer"), "n_tokens")
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)


def count_tokens(
    docs: DataFrame, cache: TokenCache, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; distinct misses enter the cache."""
    text = whole(named(text_column))
    keyed = docs.select(named(id_column).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    rows = materialize(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    # Copies are merged before the shuffle, then one text of each digest meets the cache.  An anti-join would be
    # moved below the aggregation and send every copy.
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    met = distinct.hint("merge").join(cache.counts(), "digest", "left")
    cache.add(met.filter("n_tokens IS NULL").select("digest", "text"))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size"))
    groups = materialize(sizes.join(cache.counts(), "digest"))
    return join_groups(rows, groups, "digest", "size").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
