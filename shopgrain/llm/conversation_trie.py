"""Prefix trie of conversations with totals rolled up band by band.

Every distinct sequence of first turns is a node.  A node's key is its depth
and the exclusive or of one 120-bit digest of (place, role, text) for each of
its turns, so keys of all prefixes are running sums, which are made in chunks
of bounded size and no conversation has to lie in one task.

Totals of subtrees are rolled up in bands of HEIGHT depths.  Inside a band a
node's own figures go to its ancestors of that band, HEIGHT at most.  The
roots of the bands form a tree that is HEIGHT times as flat and is rolled up
the same way; its completed totals then go from each band's root to the
ancestors in the band above.  A node so becomes at most 2 x HEIGHT rows and a
depth of d takes log_HEIGHT(d) rounds.  The ancestors of a node are found in
the turns of its smallest member.

A conversation's turns stand by turn, null first, repeated turn numbers by the
digest of role and text; repeated rows are turns of their own.  Null roles and
texts count as empty.  Rows without conversation id belong to no conversation
and are left out.  An empty table gives no rows, not even a root.  Texts are
digested whole where they lie and never shuffled.  Columns are taken by name,
so further columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.functions.ordering import ranked
from shopgrain.llm.columns import join_groups, named, whole
from shopgrain.sources.shared import materialize

#: Depths of a band.
HEIGHT = 8
#: Turns of one running sum, and ids of one piece of a list of members.
CHUNK = 4096
#: Conversations start with turns of the one whose id is the next lower multiple of this.
FAMILY = 100
#: A conversation takes over fewer turns than this.
HEADS = 6


def _bits(digest: Column, start: int) -> Column:
    """60 bits of a hex digest as a long."""
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def turns(
    rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """conv_id, pos (from 1), turn_digest, chars of every turn."""
    role, text = whole(named(role_column)), whole(named(text_column))
    flat = rows.filter(named(id_column).isNotNull()).select(
        named(id_column).cast("long").alias("conv_id"), named(turn_column).alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    placed = ranked(flat, ["conv_id"], [F.col("turn"), F.col("turn_digest")])
    return placed.select("conv_id", F.col("_pos").alias("pos"), F.col("_n").alias("n_turns"), "turn_digest", "chars")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, depth, turn_digest, chars, last: turns taken over from the head of the family, then the own rest.

    Turnless conversations have no row here but in :func:`conversations`.
    ``own`` is read several times and should come from files.
    """
    convs = conversations(own)
    taken = convs.select("conv_id", "n_rebuilt", F.inline("taken")).select(
        "conv_id", F.col("pos").alias("depth"), "turn_digest", "chars", "n_rebuilt"
    )
    rest = join_groups(own.drop("n_turns"), convs.drop("taken"), "conv_id", "n_turns").filter("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "turn_digest", "chars", "n_rebuilt"
    )
    return taken.unionByName(rest).withColumn("last", F.col("depth") == F.col("n_rebuilt")).drop("n_rebuilt")


def conversations(own: DataFrame) -> DataFrame:
    """conv_id, n_turns, h, k (turns taken over), n_rebuilt, taken: one row for each conversation."""
    first = own.filter(F.col("pos") < HEADS)
    heads = first.filter(F.col("conv_id") % FAMILY == 0).groupBy(F.col("conv_id").alias("base")).agg(
        # Fewer than HEADS of each conversation.
        F.sort_array(F.collect_list(F.struct("pos", "turn_digest", "chars"))).alias("head")
    )
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEADS).cast("int")
    convs = own.filter("pos = 1").select(
        "conv_id", "n_turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    )
    none = F.array().cast("array<struct<pos:bigint,turn_digest:string,chars:bigint>>")
    rows = convs.join(heads, "base", "left").withColumn(
        "taken", F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    ).withColumn("k", F.size("taken").cast("long"))
    return rows.select(
        "conv_id", "n_turns", "h", "k", (F.col("k") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_rebuilt"),
        "taken",
    )


def prefixes(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, depth, node, parent, chars, last of every prefix but the empty one.

    ``sequences`` has conv_id, depth (gapless from 1), turn_digest, chars, last.
    The running sums of a chunk start from those of the conversation's earlier
    chunks; only conversations longer than a chunk are joined with them.
    """
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn_digest")), 256)
    rows = sequences.withColumn("d", digest).select(
        "conv_id", "depth", "chars", "last", _bits(F.col("d"), 1).alias("a"), _bits(F.col("d"), 16).alias("b"),
        F.floor((F.col("depth") - 1) / chunk).alias("chunk"),
    )
    upto = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = materialize(rows.withColumns({"sum_a": F.bit_xor("a").over(upto), "sum_b": F.bit_xor("b").over(upto)}))
    full = rows.filter(F.col("depth") % chunk == 0).select("conv_id", "chunk", "sum_a", "sum_b")
    # One row for each full chunk.
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    starts = full.select(
        "conv_id", (F.col("chunk") + 1).alias("chunk"), F.bit_xor("sum_a").over(earlier).alias("start_a"),
        F.bit_xor("sum_b").over(earlier).alias("start_b"),
    )
    first = rows.filter("chunk = 0")
    later = rows.filter("chunk > 0").join(starts, ["conv_id", "chunk"]).withColumns({
        "sum_a": F.col("sum_a").bitwiseXOR(F.col("start_a")), "sum_b": F.col("sum_b").bitwiseXOR(F.col("start_b")),
    }).select(*first.columns)
    return first.unionByName(later).select(
        "conv_id", "depth", F.struct("depth", F.col("sum_a").alias("a"), F.col("sum_b").alias("b")).alias("node"),
        F.struct(
            (F.col("depth") - 1).alias("depth"), F.col("sum_a").bitwiseXOR(F.col("a")).alias("a"),
            F.col("sum_b").bitwiseXOR(F.col("b")).alias("b"),
        ).alias("parent"),
        "chars", "last",
    )


def roots(convs: DataFrame) -> DataFrame:
    """The empty prefix of every conversation, in the columns of :func:`prefixes`."""
    zero = F.lit(0).cast("long")
    key = F.struct(zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    return convs.select(
        "conv_id", zero.alias("depth"), key.alias("node"), F.when(F.lit(False), key).alias("parent"), zero.alias("chars"),
        (F.col("n_rebuilt") == 0).alias("last"),
    )


def subtree_sums(nodes: DataFrame, paths: DataFrame, figures: list[str], height: int = HEIGHT) -> DataFrame:
    """node and each of ``figures`` summed over the node's subtree, itself included.

    ``nodes`` has node, depth, conv_id (a member) and the figures, ``paths``
    conv_id, depth and node of every prefix; both should come from files.
    """
    sums = [F.sum(f).alias(f) for f in figures]
    band = F.floor(F.col("depth") / height)
    ways = paths.select("conv_id", band.alias("band"), F.col("depth").alias("up_depth"), F.col("node").alias("up"))
    inside = nodes.select("conv_id", band.alias("band"), "depth", *figures).join(ways, ["conv_id", "band"])
    inside = inside.filter("up_depth <= depth").groupBy(F.col("up").alias("node")).agg(*sums)
    if not nodes.filter(F.col("depth") >= height).limit(1).count():
        return inside
    inside = materialize(inside)
    tops = materialize(
        nodes.filter(F.col("depth") % height == 0).select("node", "conv_id", band.alias("depth")).join(inside, "node")
    )
    flat = paths.filter(F.col("depth") % height == 0).select("conv_id", band.alias("depth"), "node")
    done = subtree_sums(tops, flat, figures, height)
    # Totals of a band's root go to the ancestors in the band above.
    handed = tops.filter("depth > 0").select("node", "conv_id", (F.col("depth") - 1).alias("band")).join(done, "node")
    handed = handed.drop("node").join(ways, ["conv_id", "band"]).select(F.col("up").alias("node"), *figures)
    return materialize(inside.unionByName(handed).groupBy("node").agg(*sums))


def member_digests(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node and the SHA-256 of its comma-joined conv_ids in ascending order.

    Lists are joined in pieces of ``chunk`` ids.  Those of one piece are
    digested in place; for longer ones a task reads the pieces of a node one
    after the other and keeps the state of the digest only.
    """
    placed = ranked(members.select("node", "conv_id"), ["node"], [F.col("conv_id")])
    pieces = materialize(placed.groupBy("node", F.floor((F.col("_pos") - 1) / chunk).alias("piece")).agg(
        F.max("_n").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"),
    ))
    short = pieces.filter(F.col("n") <= chunk).select("node", F.sha2("ids", 256).alias("ends_sha256"))
    key = F.concat_ws(":", "node.depth", "node.a", "node.b")
    long = pieces.filter(F.col("n") > chunk).select(key.alias("key"), "piece", "ids", "node")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, node, state = None, None, None
        for batch in batches:
            done = []
            for key, ids, full in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "node"))):
                if key != at:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    at, node, state = key, full, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _digests(done)
        if state is not None:
            yield _digests([(node, state.hexdigest())])

    kind = members.schema["node"].dataType.simpleString()
    streamed = long.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(
        digest, f"node {kind}, ends_sha256 string"
    )
    return short.unionByName(streamed)


def _digests(done: list[tuple[dict, str]]) -> pa.RecordBatch:
    node = pa.struct([(c, pa.int64()) for c in ("depth", "a", "b")])
    return pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in done], node), pa.array([d for _, d in done], pa.string())], ["node", "ends_sha256"]
    )


def trie_of(paths: DataFrame, height: int = HEIGHT, chunk: int = CHUNK) -> DataFrame:
    """One row for each node of the trie of ``paths`` (conv_id, depth, node, parent, chars, last), which come from files."""
    met = materialize(paths.groupBy("node", "parent").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
    ))
    children = met.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = materialize(met.join(children, "node", "left").select(
        "node", "parent", F.col("node.depth").alias("depth"), "conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    ))
    sums = subtree_sums(
        nodes.select("node", "depth", "conv_id", "n_leaves", "saved_tokens"), paths.select("conv_id", "depth", "node"),
        ["n_leaves", "saved_tokens"], height,
    )
    ends = member_digests(paths.filter("last"), chunk)
    whole_nodes = materialize(
        nodes.drop("n_leaves", "saved_tokens").join(sums, "node").join(ends, "node", "left").withColumn(
            "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
        )
    )
    over = whole_nodes.filter("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size")
    )
    below = join_groups(whole_nodes.filter("parent IS NOT NULL"), materialize(over), "parent", "size")
    top = whole_nodes.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.drop("size").unionByName(top).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )


def trie(rows: DataFrame, height: int = HEIGHT, chunk: int = CHUNK) -> DataFrame:
    """The trie of rebuilt conversations; see :func:`trie_of`."""
    own = materialize(turns(rows))
    paths = prefixes(rebuilt(own), chunk).unionByName(roots(conversations(own)))
    return trie_of(materialize(paths), height, chunk)
