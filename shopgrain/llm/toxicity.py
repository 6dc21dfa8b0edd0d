"""Toxicity from a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text is a set of hashed n-grams of its lower-case characters, white space
runs read as one space.  Over all labelled texts each n-gram gets the log of
the ratio of its shares in toxic and in clean texts.  The n-grams whose ratio
stands out most from chance are the features, their ratio is their value, and
a logistic regression over them is fitted on a bounded sample of the labelled
texts.  A text's score is that model's probability of the label toxic.

Labels are used only from rows whose ``crc32`` of the id as text is not
divisible by HOLD_OUT; several labels of one id count by their majority, a tie
as toxic, null labels and labels without id not at all.  A null text counts as
empty and a null id as the empty string; neither is skipped.  An empty text
has no n-grams and gets the model's score for that.  Every row gets its own
line, repeated rows train and score as often as they stand there.  Texts are
read whole, in blocks that overlap.  Without labels of both kinds every score
is the share of toxic labels (0 without any).  An empty table gives no rows.
Columns are taken by name, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.columns import named, whole
from shopgrain.sources.shared import materialize

SIZES = (3, 4, 5)
#: n-grams are told apart by this many bits of a hash.
BITS = 20
FEATURES = 4096  # at most 2**16
#: Bound of the sample of labelled rows that the regression is fitted on; ratios are counted over all of them.
SAMPLE = 20_000
HOLD_OUT = 5
#: Up to this many labelled ids are broadcast; beyond that labels and texts are shuffled by id.
BROADCAST_LABELS = 1_000_000
#: Characters that are looked at together; bounds memory for long texts.
BLOCK = 1 << 20

PENALTY = 1e-3
STEPS = 300
RATE = 0.02


def grams(text: str, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Hashed n-grams of the whole text, block by block, with repetitions."""
    chars = " " + " ".join(text.lower().split()) + " "
    if len(chars) < 3:
        return
    widest = max(SIZES)
    for at in range(0, len(chars), block):
        part = chars[at:at + block + widest - 1]
        last = at + block >= len(chars)
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        h = codes
        for n in range(2, widest + 1):
            if len(codes) < n:
                break
            h = h[:-1] * np.uint64(1_000_003) + codes[n - 1:]
            if n in SIZES:
                # A block owns the n-grams that start in it.
                mine = h if last else h[:block]
                yield (((mine + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def gram_set(text: str, block: int = BLOCK) -> np.ndarray:
    parts = list(grams(text, block))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


@dataclass(frozen=True)
class Model:
    """Features (buckets) with their log-count ratio times their fitted weight, and a bias, in log odds."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.buckets] = self.weights
        return out

    def log_odds(self, text: str, table: np.ndarray, block: int = BLOCK) -> float:
        """``table`` is :meth:`table`, made once for many texts."""
        hits = []
        for part in grams(text, block):
            found = part[table[part] != 0]
            if len(found):
                hits.append(np.unique(found))
        if not hits:
            return self.bias
        return float(table[np.unique(np.concatenate(hits))].sum() + self.bias)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned from."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % HOLD_OUT == 0


def training_rows(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic",
) -> DataFrame:
    """doc_id, text, toxic of the labelled rows that may be learned from."""
    ids = labels.select(named(id_column).alias("doc_id"), named(label_column).cast("double").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    if ids.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        ids = F.broadcast(ids)
    return docs.select(named(id_column).alias("doc_id"), whole(named(text_column)).alias("text")).join(ids, "doc_id")


def gram_counts(train: DataFrame) -> DataFrame:
    """bucket, n_toxic, n_clean: in how many toxic and clean texts each n-gram stands; bucket -1 counts the texts.

    Each task adds up its own texts and sends one line for each bucket it has met.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                n[toxic, gram_set(text)] += 1
                n[toxic, -1] += 1
        met = np.flatnonzero(n.sum(axis=0))
        bucket = np.where(met == 1 << BITS, -1, met)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(n[1, met]), pa.array(n[0, met])], ["bucket", "n_toxic", "n_clean"]
        )

    parts = train.select("text", "toxic").mapInArrow(count, "bucket long, n_toxic long, n_clean long")
    return parts.groupBy("bucket").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def ratios(counts: DataFrame, n_toxic: int, n_clean: int, features: int = FEATURES) -> DataFrame:
    """bucket, ratio of the n-grams whose log-count ratio is largest against its own standard error."""
    share = (F.col("n_toxic") + 1) / F.lit(n_toxic + 2) / ((F.col("n_clean") + 1) / F.lit(n_clean + 2))
    rows = counts.filter("bucket >= 0").withColumn("ratio", F.log(share))
    error = F.sqrt(1 / (F.col("n_toxic") + 1) + 1 / (F.col("n_clean") + 1))
    return rows.orderBy(F.desc(F.abs("ratio") / error), "bucket").limit(features).select("bucket", "ratio")


def sample(train: DataFrame, n_rows: int, buckets: np.ndarray, size: int = SAMPLE) -> pa.Table:
    """toxic and found (places of its features as 16-bit numbers) of at most ``size`` labelled rows.

    The rows are chosen by a hash and so the same each time.
    """
    place = F.xxhash64("doc_id", "text")
    limit = min(2**64 * size // max(n_rows, 1), 2**64 - 1) - 2**63
    chosen = train.select("toxic", "text", place.alias("place")).filter(F.col("place") <= limit)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = np.full(1 << BITS, -1, np.int32)
        feature[buckets] = np.arange(len(buckets), dtype=np.int32)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                hit = feature[gram_set(text)]
                found.append(hit[hit >= 0].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("toxic"), pa.array(found, pa.binary())], ["place", "toxic", "found"]
            )

    rows = chosen.mapInArrow(look_up, "place long, toxic int, found binary")
    # The filter leaves about ``size`` rows; the limit makes that a bound.
    return rows.orderBy("place", "toxic").limit(size).select("toxic", "found").toArrow()


def fitted(rows: pa.Table, values: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a penalised logistic regression; a feature's value is its log-count ratio."""
    y = rows.column("toxic").to_numpy().astype(float)
    found = [np.frombuffer(f, np.uint16) for f in rows.column("found").to_pylist()]
    cols = np.concatenate(found).astype(np.int32)
    at = np.repeat(np.arange(len(y), dtype=np.int32), [len(f) for f in found])
    x = values[cols]
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w = np.append(np.zeros(len(values)), np.log(share / (1 - share)))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        odds = np.bincount(at, weights=x * w[cols], minlength=len(y)) + w[-1]
        miss = (0.5 + 0.5 * np.tanh(0.5 * odds)) - y
        slope = np.bincount(cols, weights=x * miss[at], minlength=len(values)) / len(y) + PENALTY * w[:-1]
        slope = np.append(slope, miss.mean())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        w = w - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def trained(train: DataFrame, features: int = FEATURES, size: int = SAMPLE) -> Model:
    """The model of labelled rows (doc_id, text, toxic)."""
    counts = materialize(gram_counts(train))
    total = counts.filter("bucket = -1").first()
    n_toxic, n_clean = (total["n_toxic"], total["n_clean"]) if total else (0, 0)
    if not n_toxic or not n_clean:
        share = min(max(n_toxic / max(n_toxic + n_clean, 1), 1e-12), 1 - 1e-12)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    best = ratios(counts, n_toxic, n_clean, features).collect()
    buckets = np.array([r["bucket"] for r in best], np.int64)
    values = np.array([r["ratio"] for r in best])
    weights, bias = fitted(sample(train, n_toxic + n_clean, buckets, size), values)
    return Model(buckets, weights * values, bias)


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(named(id_column).alias("doc_id"), whole(named(text_column)).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            odds = np.array([model.log_odds(t, table) for t in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(0.5 + 0.5 * np.tanh(0.5 * odds))], ["doc_id", "score"]
            )

    out = rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out, score all rows."""
    return scored(docs, trained(training_rows(docs, labels)))
