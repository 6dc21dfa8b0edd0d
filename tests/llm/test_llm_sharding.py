import struct
import zlib
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from shopgrain.llm import sharding as op


def test_places_are_gapless_and_bytes_even(spark, tmp_path, awkward, awkward_rows):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 400)) for i in range(3000)], "doc_id long, text string")
    got = op.shard(docs, op.SlotMaps(spark, str(tmp_path)), 16, slots=512).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    by = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32) == (r.doc_id * 37 % 400 + 1, zlib.crc32(b"x" * (r.doc_id * 37 % 400)))
        by[r.shard].append(r)
    assert set(by) == set(range(16))
    sizes = [sum(r.size for r in m) for m in by.values()]
    assert max(sizes) <= 1.01 * min(sizes)
    for m in by.values():
        assert sorted(r.slot for r in m) == list(range(len(m)))


def test_awkward_rows(spark, tmp_path, clashing, awkward_rows):
    got = op.shard(clashing, op.SlotMaps(spark, str(tmp_path)), 4).collect()
    want = sorted([(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in awkward_rows], key=str)
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in got], key=str) == want
    places = [(r.shard, r.slot) for r in got]
    assert len(set(places)) == len(places)


def test_a_new_shard_takes_only_what_was_too_much(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(2000)], "doc_id long, text string")
    maps = op.SlotMaps(spark, str(tmp_path))
    sizes = op.slot_sizes(op.measured(docs, 256), 256)
    first, second = op.rebalance(maps, sizes, 8, 256), op.rebalance(maps, sizes, 9, 256)
    assert maps.versions() == [0, first, second]
    a = {r.virtual_slot: r.shard for r in maps.read(first).collect()}
    rows = maps.read(second).collect()
    b = {r.virtual_slot: r.shard for r in rows}
    assert sorted(a) == sorted(b) == list(range(256))
    assert {s for s in b if a[s] != b[s]} <= {r.virtual_slot for r in rows if r.moved}
    assert sum(r.moved for r in rows) < 256 / 4 and 8 in b.values()
    # Nothing moves when nothing has changed.
    load = defaultdict(int)
    for r in sizes.collect():
        load[b[r.virtual_slot]] += r.bytes
    assert max(load.values()) <= 1.05 * min(load.values())


def test_written_shards_hold_every_row(spark, tmp_path, awkward):
    maps = op.SlotMaps(spark, f"{tmp_path}/maps")
    rows = op.shard(awkward, maps, 4)
    op.write_shards(awkward, maps.read(), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    want = sorted([(r.doc_id, r.virtual_slot, r.shard) for r in rows.collect()], key=str)
    assert sorted([(r.doc_id, r.virtual_slot, r.shard) for r in back.collect()], key=str) == want


def test_written_columns_of_any_name(spark, tmp_path, clashing):
    """The table's own columns stay as they are."""
    table = clashing.withColumns({"virtual_slot": F.lit(9), "part": F.lit(8)})
    maps = op.SlotMaps(spark, f"{tmp_path}/maps")
    rows = op.shard(table, maps, 4)
    op.write_shards(table, maps.read(), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r["virtual_slot"], r["Shard"], r["part"], r["odd.name"]) for r in back} == {(9, 7, 8, 7)}
    want = sorted([(r.doc_id, r.virtual_slot, r.shard) for r in rows.collect()], key=str)
    assert sorted([(r["doc_id"], r["_virtual_slot"], r["_shard"]) for r in back], key=str) == want


def test_shards_against_plain_python(spark, tmp_path):
    """Slots by the hash of the id, then the largest slots that a first map gives too much of go to the least full shard."""
    shards, slots = 5, 64
    docs = [(i * i - 700, "é" * (i * 53 % 300)) for i in range(900)] + [(17, "hot")] * 600
    got = op.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), op.SlotMaps(spark, str(tmp_path)), shards, slots)
    slot_of = {i: xxhash.xxh64_intdigest(struct.pack("<q", i), 42) for i, _ in docs}
    slot_of = {i: (h - 2**64 if h >= 2**63 else h) % slots for i, h in slot_of.items()}
    size = [0] * slots
    for i, t in docs:
        size[slot_of[i]] += len(t.encode()) + 1
    fair, load, place, freed = -(-sum(size) // shards), [0] * shards, {}, []
    for shard in range(shards):
        upto = 0
        for s in sorted(range(shard, slots, shards), key=lambda s: (-size[s], s)):
            upto += size[s]
            if upto <= fair:
                place[s], load[shard] = shard, load[shard] + size[s]
            else:
                freed.append(s)
    for s in sorted(freed, key=lambda s: (-size[s], s)):
        shard = min(range(shards), key=lambda x: (load[x], x))
        place[s], load[shard] = shard, load[shard] + size[s]
    rows = got.collect()
    assert sorted((r.doc_id, r.shard) for r in rows) == sorted((i, place[slot_of[i]]) for i, _ in docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_empty_table(spark, tmp_path, no_docs):
    assert op.shard(no_docs, op.SlotMaps(spark, str(tmp_path)), 16).count() == 0
