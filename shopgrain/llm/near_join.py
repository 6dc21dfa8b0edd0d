"""Similarity join of texts on word shingles by chosen paths.

Two texts are linked when their sets of five-word shingles have a Jaccard
similarity of at least the threshold.  Texts with equal sets are merged first
and stand for their copies.  Each set is embedded by MinHash; a run sends
every set to the bucket of one sampled coordinate and value, and splits a
bucket that is too large by a further coordinate, which the path so far
chooses, up to DEPTH coordinates.  Two sets at the threshold stay together in
a run with a probability of at least threshold**DEPTH; as many runs are made
as the target recall asks.

Buckets are compared whole: first by short signatures, which drop what is far
off (by five standard deviations, so this too is part of the recall), then by
the exact sets of those texts that are left.  What is still too large after
the last split, as a group of near copies is, is compared block by block, each
pair of blocks in a task of its own.  A pair that meets in several runs counts
in the first of them.  A task returns for each text its number of links and
one link to the root of its local group, never the pairs, so results grow
with the texts; groups are then joined by alternating star contractions.

A text without words, null and empty ones included, has no links and is a
class of its own.  A text of fewer than five words links to texts of the same
words.  Repeated rows and equal ids are rows like others.  An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopgrain.llm.columns import join_groups, named, own, whole
from shopgrain.llm.shingles import MinHash, mix, set_digest, shingle_set
from shopgrain.sources.shared import materialize

THRESHOLD = 0.8
RECALL = 0.9998
DEPTH = 3
COORDINATES = 128
BUCKET = 64
BLOCK = 128


def runs_for(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with the target probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def sketches(
    docs: DataFrame, runs: int, depth: int = DEPTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, text_key, digest (null without words), sig, and the path keys of every run and depth."""
    text = whole(named(text_column))
    rows = docs.select(named(id_column).alias("doc_id"), F.md5(text).alias("text_key"), text.alias("text"))
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("text_key", T.StringType()), T.StructField("digest", T.BinaryType()),
        T.StructField("sig", T.BinaryType()), T.StructField("paths", T.ArrayType(T.LongType())),
    ])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(COORDINATES)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(at, 512)
                sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
                least = np.stack([minhash.values(s) for s in sets])
                paths = path_keys(least, runs, depth)
                bounds = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * paths.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("text_key"),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in least.astype(np.uint8)], pa.binary()),
                        pa.ListArray.from_arrays(bounds, pa.array(paths.ravel())),
                    ],
                    ["doc_id", "text_key", "digest", "sig", "paths"],
                )

    return rows.mapInArrow(sketch, schema)


def path_keys(least: np.ndarray, runs: int, depth: int) -> np.ndarray:
    """Keys of the buckets on each set's path, run by run and, within a run, from the root down."""
    every = np.arange(len(least))
    out = np.empty((len(least), runs, depth), np.uint64)
    for run in range(runs):
        key = np.full(len(least), run + 1, np.uint64)
        at = np.full(len(least), run % COORDINATES)
        for level in range(depth):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (at.astype(np.uint64) << np.uint64(32)) + least[every, at])
            out[:, run, level] = key
            at = (key % np.uint64(COORDINATES)).astype(np.int64)
    return out.reshape(len(least), runs * depth).astype(np.int64)


def leaves(sets: DataFrame, runs: int, depth: int = DEPTH, bucket: int = BUCKET) -> DataFrame:
    """digest, run, leaf, members: where each set ends up in each run; buckets of one are left out.

    Level by level, buckets are counted with partial sums; only sets of
    buckets above ``bucket`` go on to the next level.
    """
    each = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(
        r.alias("run"), F.slice(F.col("paths"), r * depth + 1, F.lit(depth)).alias("keys"),
    ))
    rows = materialize(sets.select("digest", F.inline(each)))
    found = None
    for level in range(depth):
        keyed = rows.withColumn("leaf", F.col("keys")[level])
        sizes = keyed.groupBy("leaf").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        met = materialize(keyed.join(materialize(sizes), "leaf"))
        done = met if level == depth - 1 else met.filter(F.col("members") <= bucket)
        done = done.select("digest", "run", "leaf", "members")
        found = done if found is None else found.unionByName(done)
        rows = met.filter(F.col("members") > bucket).drop("leaf", "members")
    return found


TASK = ["leaf", "low", "high"]


def tasks(sets: DataFrame, found: DataFrame, runs: int, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Rows of comparisons: a set beside its task (leaf, low block, high block), and all its leaves.

    A bucket of up to ``bucket`` sets is one task.  A larger one is dealt into
    blocks and each pair of blocks is a task.
    """
    mine = found.groupBy("digest").agg(F.collect_list(F.struct("run", "leaf", "members")).alias("l"))
    by_run = F.map_from_entries(F.transform("l", lambda x: F.struct(x["run"], x["leaf"])))
    all_leaves = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0)))
    rows = mine.withColumn("m", by_run).select("digest", "l", all_leaves.alias("leaves"))
    rows = rows.join(sets.select("digest", "copies", "text_key", "sig"), "digest")
    rows = rows.select("digest", "copies", "text_key", "sig", "leaves", F.inline("l"))
    blocks = F.when(F.col("members") <= bucket, 1).otherwise(F.ceil(F.col("members") / block)).cast("int")
    rows = rows.withColumn("blocks", blocks)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("digest", "leaf"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "run", "block", "digest", "copies", "text_key", "sig", "leaves",
    )


Emit = Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]]


def by_task(rows: DataFrame, emit: Emit, schema: T.StructType) -> DataFrame:
    """Give batches of whole tasks, and where each begins, to ``emit``; rows are dealt and sorted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            starts = task_starts(batch)
            rest = batch.slice(starts[-1])
            yield from emit(batch, starts)
        if rest is not None and rest.num_rows:
            yield from emit(rest, np.append(task_starts(rest), rest.num_rows))

    dealt = rows.repartition(*TASK).sortWithinPartitions(*TASK)
    return dealt.mapInArrow(run, schema)


def task_starts(batch: pa.RecordBatch) -> np.ndarray:
    """Rows with which a task begins."""
    new = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        new[1:] = False
        for c in TASK:
            values = batch.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def open_pairs(batch: pa.RecordBatch) -> np.ndarray:
    """Which pairs of a task's sets are compared here: not in an earlier run, and of both its blocks."""
    run, low, high = (batch.column(c)[0].as_py() for c in ("run", "low", "high"))
    n = batch.num_rows
    open_ = np.triu(np.ones((n, n), bool), 1)
    if run:
        places = batch.column("leaves").flatten().to_numpy().reshape(n, -1)[:, :run]
        for r in range(run):
            p = places[:, r]
            open_ &= ~((p[:, None] == p[None, :]) & (p != 0)[:, None])
    if low != high:
        block = batch.column("block").to_numpy()
        open_ &= block[:, None] != block[None, :]
    return open_


def likely(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of tasks whose set may be similar to another one of the task, by their signatures."""
    n = COORDINATES
    least = n * threshold - 5 * math.sqrt(n * threshold * (1 - threshold))
    kept = [f for f in rows.schema.fieldNames() if f != "sig"]
    schema = T.StructType([rows.schema[f] for f in kept])

    def emit(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        chosen: list[np.ndarray] = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a < 2:
                continue
            task = batch.slice(a, b - a)
            sig = np.frombuffer(b"".join(task.column("sig").to_pylist()), np.uint8).reshape(b - a, n)
            near = open_pairs(task)
            for i in range(b - a - 1):
                near[i, i + 1 :] &= (sig[i] == sig[i + 1 :]).sum(1) >= least
            some = np.flatnonzero(near.any(0) | near.any(1))
            if len(some):
                chosen.append(some + a)
        if chosen:
            yield batch.select(kept).take(pa.array(np.concatenate(chosen)))

    return by_task(rows, emit, schema)


def links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """digest, linked (rows of other sets it is linked to), root: for each set of each task that has a link."""
    schema = T.StructType([
        T.StructField("digest", T.BinaryType()), T.StructField("linked", T.LongType()),
        T.StructField("root", T.BinaryType()),
    ])

    def emit(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a < 2:
                continue
            task = batch.slice(a, b - a)
            near = similar(task.column("text").to_pylist(), open_pairs(task), threshold)
            if not near.any():
                continue
            near |= near.T
            digests, copies = task.column("digest").to_pylist(), task.column("copies").to_numpy()
            roots = local_roots(near)
            for i in np.flatnonzero(near.any(1)):
                out[0].append(digests[i])
                out[1].append(int(copies[near[i]].sum()))
                out[2].append(digests[roots[i]])
        if out[0]:
            kinds = [pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["digest", "linked", "root"]
            )

    return by_task(rows, emit, schema)


def similar(texts: list[str], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have exact Jaccard similarity of the threshold or more."""
    sets = [shingle_set(t) for t in texts]
    sizes = np.array([len(s) for s in sets], np.int64)
    both = np.zeros(pairs.shape, np.int64)
    if pairs.sum() <= 4 * len(texts):
        for i, j in zip(*np.nonzero(pairs), strict=True):
            a, b = sets[i], sets[j]
            at = np.searchsorted(a, b)
            both[i, j] = np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b)
    else:
        # Shared shingles only, some thousands at a time, as the product of a 0/1 matrix with itself.
        names, of = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(of, minlength=len(names)) > 1
        column = np.cumsum(shared) - 1
        use = shared[of]
        of, owner = column[of[use]], owner[use]
        order = np.argsort(of, kind="stable")
        of, owner = of[order], owner[order]
        for low in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(of, [low, low + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[a:b], of[a:b] - low] = 1
            both += np.rint(part @ part.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    return pairs & (both >= threshold * union - 1e-9)


def local_roots(near: np.ndarray) -> np.ndarray:
    """The first member of each member's group."""
    roots = np.full(len(near), -1)
    for start in range(len(near)):
        if roots[start] < 0:
            todo = [start]
            roots[start] = start
            while todo:
                new = np.flatnonzero(near[todo.pop()] & (roots < 0))
                roots[new] = start
                todo += new.tolist()
    return roots


def components(edges: DataFrame) -> DataFrame:
    """node, root of undirected edges (a, b): the least node of each connected group.

    Stars are contracted in turns (every node's larger neighbours, then its
    smaller ones, move to the least node around it) until nothing moves, which
    takes a logarithmic number of rounds.  Minima are partial sums, and the
    joins read files on both sides, so a node with many neighbours is split.
    """
    def around(e: DataFrame) -> DataFrame:
        return materialize(e.groupBy("a").agg(F.min("b").alias("m")))

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return tuple(row)

    def clean(e: DataFrame) -> DataFrame:
        return materialize(e.filter("a != b").distinct())

    now = clean(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    last = None
    while (is_now := state(now)) != last:
        last = is_now
        both = materialize(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = both.join(around(both), "a").filter("b > a")
        large = clean(large.select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        small = large.join(around(large), "a")
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = clean(moved.unionByName(small.select("a", F.col("m").alias("b"))))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, digest), and for each digest its copies, linked rows and class.

    The class is the smallest id of its documents; ``class_key`` is a text of
    the document with that id.
    """
    runs = runs_for(threshold, recall)
    rows = materialize(sketches(docs, runs, DEPTH, id_column, text_column))
    # Equal sets have equal signatures and paths; which text stands for them does not matter.
    sets = materialize(rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))).alias("first"),
        F.first("sig").alias("sig"), F.first("paths").alias("paths"),
    ).select("digest", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("text_key"),
             "sig", "paths"))
    found = materialize(leaves(sets, runs))
    near = materialize(likely(tasks(sets, found, runs), threshold))
    # One text for each key that a comparison needs; copies are merged before the shuffle.
    text = whole(named(text_column))
    texts = docs.groupBy(F.md5(text).alias("text_key")).agg(F.first(text).alias("text"))
    wanted = near.select("text_key").distinct()
    chosen = materialize(texts.join(wanted, "text_key"))
    linked = materialize(links(near.join(chosen, "text_key"), threshold))
    counts = linked.groupBy("digest").agg(F.sum("linked").alias("linked"))
    groups = components(linked.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    groups = groups.select(F.col("node").alias("digest"), "root")
    facts = materialize(
        sets.select("digest", "copies", "first_id", "text_key").join(counts, "digest", "left")
        .join(groups, "digest", "left")
        .select("digest", "copies", "first_id", "text_key", F.coalesce("linked", F.lit(0)).alias("linked"),
                F.coalesce("root", "digest").alias("root"))
    )
    first = F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("text_key"))
    heads = facts.groupBy("root").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size")).select(
        "root", F.col("first.first_id").alias("class_id"), F.col("first.text_key").alias("class_key"), "size",
    )
    return rows.select("doc_id", "text_key", "digest"), materialize(
        join_groups(facts.drop("first_id", "text_key"), materialize(heads), "root", "size").drop("size")
    )


def join(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, class_id, n_links of every document; copies count as links."""
    rows, facts = classes(docs, threshold, recall, id_column, text_column)
    found = join_groups(rows.filter("digest IS NOT NULL"), facts, "digest", "copies")
    alone = rows.filter("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.select("doc_id", "class_id", (F.col("linked") + F.col("copies") - 1).alias("n_links")).unionByName(alone)


def one_of_each(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One document of each class, the one with the smallest id, columns as they were.

    Repeated rows of one id and text count as one document.
    """
    rows, facts = classes(docs, threshold, recall, id_column, text_column)
    key, ident, order, row = own(docs, "text_key", "id_key", "order", "row")
    cols = [named(c) for c in docs.columns]

    def id_key(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))

    keyed = docs.select(
        F.md5(whole(named(text_column))).alias(key), id_key(named(id_column)).alias(ident),
        F.xxhash64(*cols).alias(order), F.struct(*cols).alias(row),
    )
    single = keyed.groupBy(key, ident).agg(F.min_by(row, order).alias(row))
    heads = facts.select(F.col("class_key").alias(key), id_key(F.col("class_id")).alias(ident))
    alone = rows.filter("digest IS NULL").select(F.col("text_key").alias(key), id_key(F.col("doc_id")).alias(ident))
    return single.join(heads.unionByName(alone).distinct(), [key, ident]).select(f"{row}.*")
