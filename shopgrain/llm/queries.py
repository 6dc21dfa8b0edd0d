"""Registered queries of the text operators: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.llm import (
    binary_output, conversation_trie, exact_dedup, main_text, mixing, near_join, packing, pseudonyms, quality_rules,
    sharding, spelling_variants, token_counts, toxicity,
)
from shopgrain.sources.shared import shared_dir

SHARDS = 16
#: For the registered query only; a real run takes its key from a secret store.
PSEUDONYM_KEY = "registered query"
PACKING_TOKENIZER = "word_bpe_49k.json"
COUNTING_TOKENIZER = "piece_bpe_32k.model"
BINARY_TOKENIZER = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of this call's own on the shared storage."""
    return f"{shared_dir(spark)}/shopgrain-{name}-{uuid.uuid4().hex}"


def op1_pseudonyms(spark: SparkSession, path: str) -> DataFrame:
    rows = _table(spark, path, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(rows, PSEUDONYM_KEY)


def op2_main_text(spark: SparkSession, path: str) -> DataFrame:
    pages = _table(spark, path, "pages").select("page_id", "url", "html")
    return main_text.extracted(pages)


def op3_sharding(spark: SparkSession, path: str) -> DataFrame:
    maps = sharding.SlotMaps(spark, _folder(spark, "slot-maps"))
    rows = sharding.shard(_table(spark, path, "documents"), maps, SHARDS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op4_mixing(spark: SparkSession, path: str) -> DataFrame:
    return mixing.plan(_table(spark, path, "documents")).drop("copies")


def op5_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    rows = quality_rules.judge(_table(spark, path, "documents"))
    return rows.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op6_packing(spark: SparkSession, path: str) -> DataFrame:
    pieces = packing.pack(_table(spark, path, "documents"), public_tokenizers.path(PACKING_TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


def op7_ngram_jaccard_join(spark: SparkSession, path: str) -> DataFrame:
    return near_join.join(_table(spark, path, "documents"))


def op8_token_counts(spark: SparkSession, path: str) -> DataFrame:
    tokenizer = public_tokenizers.path(COUNTING_TOKENIZER)
    cache = token_counts.TokenCache.open(spark, _folder(spark, "token-counts"), tokenizer)
    return token_counts.count_tokens(_table(spark, path, "documents"), cache)


def op9_binary_output(spark: SparkSession, path: str) -> DataFrame:
    return binary_output.write_rows(_table(spark, path, "documents"), public_tokenizers.path(BINARY_TOKENIZER))


def op10_exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    index = exact_dedup.DigestIndex.open(spark, _folder(spark, "digests"))
    return exact_dedup.verdicts(_table(spark, path, "documents"), index, "documents")


def op11_toxicity(spark: SparkSession, path: str) -> DataFrame:
    return toxicity.judge(_table(spark, path, "documents"), _table(spark, path, "labels"))


def op12_spelling_variants(spark: SparkSession, path: str) -> DataFrame:
    return spelling_variants.variants(_table(spark, path, "documents"))


def op13_conversation_trie(spark: SparkSession, path: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, path, "conversations"))


QUERIES = {
    "op1_pseudonyms": op1_pseudonyms,
    "op2_main_text": op2_main_text,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_binary_output": op9_binary_output,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_trie": op13_conversation_trie,
}
