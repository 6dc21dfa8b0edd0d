"""Snapshots, merges by key index, conflicts and cleaning of the table store."""

from datetime import date, timedelta
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopgrain.operators.load import _replace
from shopgrain.sources import files
from shopgrain.sources.tables import KEYS, Changed, TableStore

PLACES = T.StructType([
    T.StructField("client_key", T.StringType()), T.StructField("k", T.StringType()), T.StructField("mes", T.DateType()),
])
SCHEMA = T.StructType([*PLACES.fields, T.StructField("v", T.IntegerType())])
KEY, PARTS = ["client_key", "k"], ["client_key", "mes"]


def sales(spark, *rows):
    return spark.createDataFrame([(s, k, date(2024, m, 1) if m else None, v) for s, k, m, v in rows], SCHEMA)


def put(store, df, fn=None, batch="b"):
    store.merge("r", df, KEY, PARTS, fn or (lambda old, new: _replace(old, new, KEY)), batch, SCHEMA)


def held(df):
    return sorted((r.client_key, r.k, r.mes and r.mes.month, r.v) for r in df.collect())


def folders(df):
    return {unquote(f).rsplit("/", 1)[0].split("/", 3)[3] for f in df.inputFiles()}


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "t"))


def test_a_frame_keeps_the_rows_it_was_planned_with(spark, store):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "client_key string, v int")
    store.save_result("r", df)
    before = store.read("r")
    store.save_result("r", df.withColumn("v", F.col("v") + 10))
    store.save_result("r", df.filter("client_key = 'a'").withColumn("v", F.lit(7)))
    assert sorted(map(tuple, before.collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, store.read("r").collect())) == [("a", 7), ("b", 12)]


def test_a_write_that_was_cut_short_shows_nothing(spark, store, monkeypatch):
    put(store, sales(spark, ("a", "1", 1, 1)))

    def cut(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(files, "create_text", cut)
        put(store, sales(spark, ("a", "1", 2, 5), ("a", "2", 1, 3)))
    assert held(store.read("r")) == [("a", "1", 1, 1)]
    put(store, sales(spark, ("a", "1", 2, 5), ("a", "2", 1, 3)))
    assert held(store.read("r")) == [("a", "1", 2, 5), ("a", "2", 1, 3)]
    # Its files go when they are old enough, those in use stay.
    store.vacuum("r", timedelta(0))
    assert held(store.read("r")) == [("a", "1", 2, 5), ("a", "2", 1, 3)]
    assert len(files.children(spark, f"{store.path('r')}/rows")) == 1


def test_keys_move_between_months_and_odd_values(spark, store):
    rows = [("a b/c=%", f"{i}", 1 + i % 12, i) for i in range(60)] + [("001", "x", None, 1), ("001", "y", 3, 2)]
    want = {(s, k): (m, v) for s, k, m, v in rows}
    put(store, sales(spark, *rows))
    for change in ([("a b/c=%", "5", 9, 500), ("001", "x", 4, 9)], [("a b/c=%", "5", None, 501), ("001", "n", 4, 1)],
                   [("a b/c=%", "17", 6, 17)], [("001", "y", None, 0)], [("a b/c=%", "5", 1, 502)]):
        put(store, sales(spark, *change))
        want |= {(s, k): (m, v) for s, k, m, v in change}
        got = held(store.read("r"))
        assert got == sorted(((s, k, m, v) for (s, k), (m, v) in want.items()), key=lambda r: r[:2])
        index = store._frame("r", KEYS, store.snapshot("r").keys, PLACES)
        assert {(r.client_key, r.k): r.mes and r.mes.month for r in index.collect()} == {x: m for x, (m, _) in want.items()}
        assert index.count() == len(want)


def test_a_merge_reads_touched_months_and_index_parts_only(spark, store):
    put(store, sales(spark, *[("a", f"{i}", 1 + i % 12, i) for i in range(600)]))
    read = []
    put(store, sales(spark, ("a", "2", 8, 0)), lambda old, new: (read.append(folders(old)), _replace(old, new, KEY))[1])
    assert {p.rsplit("/", 1)[-1] for p in read[0]} == {"mes=2024-03-01", "mes=2024-08-01"}
    seen = store.snapshot("r")
    index, leaves = store._key_rows("r", seen, sales(spark, ("a", "2", 8, 0)), KEY, PARTS, SCHEMA)
    assert len(leaves) == 1 and {p.split("/", 1)[1] for p in {f.split("versao=")[1] for f in folders(index)}} == leaves
    assert store.read("r").count() == 600


def test_a_merge_after_a_saved_result_lists_the_keys_anew(spark, store):
    put(store, sales(spark, ("a", "1", 1, 1), ("a", "2", 2, 2)))
    store.save_result("r", sales(spark, ("a", "3", 2, 3)), PARTS)
    assert store.snapshot("r").keys is None
    put(store, sales(spark, ("a", "3", 1, 4)))
    assert held(store.read("r")) == [("a", "1", 1, 1), ("a", "3", 1, 4)]


def test_writers_of_other_partitions_do_not_meet_and_of_the_same_ones_try_again(spark, store):
    put(store, sales(spark, ("a", "1", 1, 1), ("b", "1", 1, 1)))
    calls = []

    def slow(other):
        def fn(old, new):
            calls.append(1)
            if len(calls) == 1:
                put(store, other)
            return _replace(old, new, KEY)
        return fn

    put(store, sales(spark, ("a", "2", 2, 2)), slow(sales(spark, ("b", "1", 5, 9))))
    assert len(calls) == 1
    calls.clear()
    put(store, sales(spark, ("a", "3", 1, 3)), slow(sales(spark, ("a", "4", 1, 4))))
    assert len(calls) == 2
    assert held(store.read("r")) == [("a", "1", 1, 1), ("a", "2", 2, 2), ("a", "3", 1, 3), ("a", "4", 1, 4), ("b", "1", 5, 9)]

    def always(old, new):
        put(store, sales(spark, ("a", "4", 1, 5)))
        return _replace(old, new, KEY)

    with pytest.raises(Changed, match="lote 7"):
        put(store, sales(spark, ("a", "5", 1, 3)), always, "lote 7")


def test_an_erase_during_a_merge_of_another_shop_harms_neither(spark, store):
    put(store, sales(spark, ("a", "1", 1, 1), ("b", "1", 1, 1), ("b", "2", 2, 2)))

    def fn(old, new):
        assert store.erase_tenant("b") == ["r"]
        return _replace(old, new, KEY)

    put(store, sales(spark, ("a", "1", 2, 9)), fn)
    assert held(store.read("r")) == [("a", "1", 2, 9)]
    put(store, sales(spark, ("b", "2", 4, 4)))
    assert held(store.read("r")) == [("a", "1", 2, 9), ("b", "2", 4, 4)]


def test_old_snapshots_are_kept_and_cleaned(spark, store):
    for v in range(3):
        put(store, sales(spark, ("a", "1", 1, v), ("b", f"{v}", 1, v)))
    store.vacuum("r")
    assert len(store._manifests("r")) == 3
    store.vacuum("r", timedelta(0))
    assert len(store._manifests("r")) == 1
    assert held(store.read("r")) == [("a", "1", 1, 2), ("b", "0", 1, 0), ("b", "1", 1, 1), ("b", "2", 1, 2)]
    put(store, sales(spark, ("a", "1", 2, 7)))
    assert ("a", "1", 2, 7) in held(store.read("r"))
