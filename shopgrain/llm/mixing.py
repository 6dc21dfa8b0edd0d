"""Mixing sources to target weights.

Words are summed for each source, a repetition rate is derived from its
target, and every document is emitted floor(rate) times plus once more with a
probability equal to the fraction.  That draw is a hash of the seed and the
id, so reruns agree wherever a document lies.

The size of a document is its number of words, a null text has none.  Sources
stand in code point order, a null source last as one of its own; a source
without words gets no target and its documents are not taken.  Repeated ids
share their draw.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.llm.columns import WORD, named, own, whole
from shopgrain.sources.shared import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
BROADCAST_SOURCES = 100_000


def n_words(text: str) -> Column:
    return F.regexp_count(whole(named(text)), F.lit(WORD)).cast("long")


def source_sizes(sized: DataFrame) -> DataFrame:
    """source, source_size: partial sums in every task, so a source may hold any share of the rows."""
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size, target, rate of each source.

    The targets are weight x level, cut at ``most`` times the source's size.
    The level that shares all words is found from the sources in the order in
    which they reach their cut: the cuts of those before are given, the rest
    is shared by the weights of those from here on, and the first source that
    this level does not cut ends the search.  One row per source is windowed,
    never a row per document.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")
    )
    cut = F.col("source_size").cast("double") * F.lit(float(most))
    rows = sizes.withColumn("weight", weight).withColumn("cut", cut)
    rows = rows.withColumn("ratio", F.col("cut") / F.col("weight"))
    by_cut = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_cut.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (
        F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cut").over(before), F.lit(0.0))
    ) / F.sum("weight").over(by_cut.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level)
    # From the right source on levels only fall, and all of them pass the test: the right one is the highest.
    right = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    target = F.least(F.col("cut"), F.coalesce(F.col("weight") * right, F.col("cut")))
    rows = rows.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", "target", rate.alias("rate"))


def draw(id_column: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the id: 52 bits of a digest."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(id_column: Column, rate: Column, seed: str = SEED) -> Column:
    """How often a document is emitted."""
    sure = F.floor(rate)
    return (sure + (draw(id_column, seed) < rate - sure).cast("long")).cast("long")


def with_rates(docs: DataFrame, rates: DataFrame, source: str) -> DataFrame:
    """Documents beside the other columns of their source's row; ``rates`` comes from files.

    The rates are broadcast while there are at most BROADCAST_SOURCES sources.
    Beyond that each source's row is joined by source and one of 64 salts, so
    that a source with a large share is dealt to 64 tasks.
    """
    theirs, salt, other_salt = own(docs, "rate_source", "salt", "other_salt")
    rates = rates.withColumnRenamed("source", theirs)
    same = named(source).eqNullSafe(named(theirs))
    if rates.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(rates), same).drop(theirs)
    salted = docs.withColumn(salt, F.pmod(F.xxhash64(*[named(c) for c in docs.columns]), F.lit(64)))
    many = rates.withColumn(other_salt, F.explode(F.sequence(F.lit(0), F.lit(63))))
    return salted.join(many, same & (named(salt) == named(other_salt))).drop(theirs, salt, other_salt)


def plan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document, and its source's rate and copies."""
    sized = materialize(docs.select(
        named(id_column).alias("doc_id"), n_words(text_column).alias("size"), named(source_column).alias("source"),
    ))
    rates = materialize(targets(source_sizes(sized), weights, share, most))
    rows = with_rates(sized, rates, "source").withColumn("copies", copies(F.col("doc_id"), F.col("rate"), seed))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
    )


def mixed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """The mix itself: every document as often as it is emitted, columns as they were; no text is shuffled."""
    sized = docs.select(n_words(text_column).alias("size"), named(source_column).alias("source"))
    n, rate = own(docs, "copies", "rate")
    rates = materialize(targets(source_sizes(sized), weights, share, most).select("source", F.col("rate").alias(rate)))
    rows = with_rates(docs, rates, source_column).withColumn(n, copies(named(id_column), named(rate), seed))
    rows = rows.filter(named(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), named(n))))
    return rows.select(*[named(c) for c in docs.columns])
