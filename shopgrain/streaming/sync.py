"""Incremental pull of store exports as a stream of files.

Layout of the inbox: ``<inbox>/<client_key>/<entity>/<file>.csv|.tsv`` with the
entities clientes, produtos, vendas and itens_venda.  The stream only discovers
files (the checkpoint remembers them); each batch then reads its files as
ordinary CSV, one scan per header shape, and merges them into the tables.

A file that cannot be read is set aside: the other files of its batch are
merged, and it is tried again with every later batch and at the start of every
run until it can be read.  Records that do not fit their header go to the
reject table.  So do items whose sale is not known, which wait as well: the
batch that brings the sale merges them, so the order in which the two arrive
does not matter.  The wait ends after ``max_wait``.

Records go on over line ends inside quotes, in files of every size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shopgrain import schema
from shopgrain.operators import load, normalize
from shopgrain.sources import csv_files
from shopgrain.sources.shared import materialize
from shopgrain.sources.tables import TableStore

ENTITIES = ("clientes", "produtos", "vendas", "itens_venda")
REJECTS = T.StructType([
    T.StructField("client_key", T.StringType()), T.StructField("entidade", T.StringType()),
    T.StructField("_file", T.StringType()), T.StructField("_line", T.LongType()),
    T.StructField("_reason", T.StringType()),
    T.StructField("_raw", T.MapType(T.StringType(), T.StringType())),
])
# Only the path is read; unread content is never loaded.
PENDING = "arquivos_pendentes"
PENDING_SCHEMA = T.StructType([
    T.StructField("client_key", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("lote", T.StringType()), T.StructField("waits", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
])
#: Items whose sale has not come yet, laid out so that a batch reads the parts of its sales only.
WAITING = "itens_espera"
WAITING_PARTS = 64
MAX_WAIT = timedelta(days=30)
FOUND = "path string, modificationTime timestamp, length bigint, content binary"
_MONTH = T.StructField("mes", T.DateType())


def table_schema(name: str) -> T.StructType:
    """Canonical columns plus the month that lays out sales and items."""
    base = schema.TABLES[name]
    fields = [*base.fields, _MONTH] if name in ("vendas", "itens_venda") else base.fields
    # Parquet columns read back as nullable.
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def waiting_schema() -> T.StructType:
    items = [f for f in table_schema("itens_venda").fields if f.name != "mes"]
    return T.StructType([*items, T.StructField("desde", T.TimestampNTZType()), T.StructField("parte", T.IntegerType())])


def _waiting_part() -> Column:
    return F.pmod(F.xxhash64("venda_key"), F.lit(WAITING_PARTS)).cast("int").alias("parte")


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _from_path(part: int) -> Column:
    return F.element_at(F.split("_file", "/"), -part)


class SyncBatch:
    """One batch of files merged into the tables of a store."""

    def __init__(
        self, store: TableStore, clock: Callable[[], datetime] = _utc_now, max_wait: timedelta = MAX_WAIT,
    ):
        self.store = store
        self.max_wait = max_wait
        self.spark = store.spark
        self.clock = clock

    def _scan(self, paths: list[str]) -> tuple[list[DataFrame], list[DataFrame], list[tuple[str, str]]]:
        """Rows and malformed records of the files that can be read, and (path, error) of the others.

        When reading together fails, the files are halved until the ones that
        fail stand alone, so k bad files cost about k times log n more scans.
        """
        try:
            parts = [csv_files.scan_group(self.spark, s) for s in csv_files.scan_shapes(self.spark, paths)]
        except Exception as error:  # a shop's broken export must not stop the others
            if len(paths) == 1:
                return [], [], [(paths[0], str(error))]
            half = len(paths) // 2
            a, b = self._scan(paths[:half]), self._scan(paths[half:])
            return a[0] + b[0], a[1] + b[1], a[2] + b[2]
        shop = _from_path(3).alias("client_key")
        return [r.select(shop, "*") for r, _ in parts], [b.select(shop, "*") for _, b in parts], []

    def _normalize(self, entity: str, frames: list[DataFrame]):
        def joined(parts: list[DataFrame]) -> DataFrame:
            return reduce(DataFrame.unionByName, parts)

        if entity == "clientes":
            return joined([normalize.normalize_clientes(f) for f in frames]), None
        fn = {
            "vendas": normalize.normalize_vendas, "itens_venda": normalize.normalize_itens,
            "produtos": normalize.normalize_produtos,
        }[entity]
        pairs = [fn(f) for f in frames]
        return joined([g for g, _ in pairs]), joined([b for _, b in pairs])

    def _merge(
        self, entity: str, rows: DataFrame, batch: str, now: datetime
    ) -> tuple[DataFrame, DataFrame | None]:
        """Merge into the entity's table; returns the rows that were accepted, and those without a sale."""
        store, want = self.store, table_schema(entity)

        def full(df: DataFrame) -> DataFrame:
            missing = [f for f in want.fields if f.name not in df.columns]
            return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])

        rows, orphans = full(rows), None
        if entity == "clientes":
            fn, keys, parts = (
                lambda old, new: load.upsert_clientes(old, new, now),
                ["client_key", "cliente_key"], ["client_key"],
            )
        elif entity == "produtos":
            fn, keys, parts = (
                lambda old, new: load.upsert_produtos(old, new, now),
                ["client_key", "produto_key"], ["client_key"],
            )
        elif entity == "vendas":
            known = store.read("clientes", table_schema("clientes"))
            rows = rows.withColumn("mes", F.trunc("data_venda", "month"))
            fn, keys, parts = (
                lambda old, new: load.upsert_vendas(old, new, known),
                ["client_key", "venda_key"], ["client_key", "mes"],
            )
        else:
            sales = store.read("vendas", table_schema("vendas")).select(
                "client_key", "venda_key", "mes"
            )
            found = materialize(rows.drop("mes").join(
                sales.withColumn("_known", F.lit(True)), ["client_key", "venda_key"], "left"
            ))
            rows = found.filter("_known").drop("_known")
            self._keep_waiting(found.filter("_known IS NULL"), batch, now)
            orphans = found.filter("_known IS NULL").select(
                "client_key", "_file", "_line",
                F.concat(F.lit("linha "), F.col("_line"), F.lit(": venda desconhecida")).alias("_reason"),
                F.map_from_arrays(
                    F.array(F.lit("venda_key"), F.lit("produto_key")), F.array("venda_key", "produto_key")
                ).alias("_raw"),
            )
            fn, keys, parts = (
                lambda old, new: load.load_itens(old, new, sales),
                ["client_key", "venda_key"], ["client_key", "mes"],
            )
        store.merge(entity, rows, keys, parts, fn, batch, want)
        return rows, orphans

    def _keep_waiting(self, items: DataFrame, batch: str, now: datetime) -> None:
        """Let items wait for their sale; those of a later batch take the place of earlier ones, as in the table."""
        want = waiting_schema()
        rows = items.withColumn("desde", F.lit(now).cast("timestamp_ntz")).withColumn("parte", _waiting_part())
        rows = materialize(rows.select(*want.fieldNames()))
        if rows.limit(1).count():
            self._change_waiting(rows, f"{batch}-espera", lambda kept, new: kept.unionByName(new))

    def _change_waiting(
        self, rows: DataFrame, batch: str, then: Callable[[DataFrame, DataFrame], DataFrame]
    ) -> None:
        """Take the waiting items of the sales of ``rows`` out; ``then`` says what stays in their parts."""
        keys = ["client_key", "venda_key"]

        def fn(old: DataFrame, new: DataFrame) -> DataFrame:
            return then(old.join(new.select(*keys).distinct(), keys, "left_anti"), new)

        self.store.merge(WAITING, rows, keys, ["client_key", "parte"], fn, batch, waiting_schema())

    def _waiting_of(self, sales: DataFrame) -> DataFrame:
        """Waiting items of these sales (client_key, venda_key); only the parts of the sales are read."""
        keys = sales.select("client_key", "venda_key").distinct().withColumn("parte", _waiting_part())
        return self.store.read(WAITING, waiting_schema()).join(keys, ["client_key", "parte", "venda_key"], "left_semi")

    def _end_waits(self, sales: DataFrame | None, batch: str, now: datetime) -> None:
        """Merge the waiting items of sales that have come, then let go of those that wait for too long.

        It comes before the batch's own items, which take the place of earlier
        ones, and may be repeated: what was merged already is merged again.
        """
        if not self.store.exists(WAITING):
            return
        want = waiting_schema().fieldNames()
        if sales is not None:
            come = materialize(self._waiting_of(sales).select(*want))
            if come.limit(1).count():
                items = come.drop("desde", "parte").withColumns({
                    "_file": F.lit(None).cast("string"), "_line": F.lit(None).cast("bigint"),
                })
                self._merge("itens_venda", items, f"{batch}-vindos", now)
                self._change_waiting(come, f"{batch}-vindos", lambda kept, _: kept)
        old = self.store.read(WAITING, waiting_schema()).filter(F.col("desde") < F.lit(now - self.max_wait).cast("timestamp_ntz"))
        old = materialize(old.select(*want))
        if old.limit(1).count():
            self._change_waiting(old, f"{batch}-velhos", lambda kept, _: kept)

    def _pending(self) -> list[str]:
        """Files set aside by earlier batches: as many as failed and were not read since."""
        rows = self.store.read(PENDING, PENDING_SCHEMA)
        last = rows.groupBy("path").agg(F.max_by("waits", "lote").alias("waits")).filter("waits")
        return [r["path"] for r in last.select("path").collect()]

    def _note(self, failed: list[tuple[str, str]], read: list[str], batch: str) -> None:
        """Write down which files wait from this batch on, and which have been read at last."""
        lines = [(p.split("/")[-3], p, batch, True, e) for p, e in failed]
        lines += [(p.split("/")[-3], p, batch, False, None) for p in read]
        if lines:
            self.store.save_result(
                PENDING, self.spark.createDataFrame(lines, PENDING_SCHEMA), ["client_key", "lote"]
            )

    def __call__(self, found: DataFrame, batch_id: int) -> None:
        # At most maxFilesPerTrigger names.
        self.load([r["path"] for r in found.select("path").collect()], f"{batch_id:012d}")

    def retry(self) -> None:
        """Try the files that earlier runs set aside."""
        if self._pending():
            # Sorts after the numbers of batches of this and earlier runs at the same time.
            self.load([], f"r{self.clock():%Y%m%d%H%M%S%f}")

    def load(self, new: list[str], number: str) -> None:
        """Merge new files and those that wait."""
        waiting = set(self._pending())
        paths = sorted({*new, *waiting})
        # The names tell this batch from one of an earlier, abandoned checkpoint.
        mark = zlib.crc32("\n".join(paths).encode())
        started, batch = self.clock(), f"{number}-{mark:08x}"
        still: list[tuple[str, str]] = []
        sales = None
        for entity in ENTITIES:
            mine = [p for p in paths if p.split("/")[-2] == entity]
            if entity == "itens_venda":
                self._end_waits(sales, f"itens_venda-{batch}", started)
            if mine:
                failed_here, rows = self._load_entity(entity, mine, batch, started)
                still += failed_here
                sales = rows if entity == "vendas" else sales
        failed = {p for p, _ in still}
        stamp = f"{started:%Y%m%d%H%M%S%f}-{batch}"
        self._note(still, sorted(waiting - failed), stamp)

    def _load_entity(
        self, entity: str, paths: list[str], batch: str, started: datetime
    ) -> tuple[list[tuple[str, str]], DataFrame | None]:
        """The files that could not be read, and the rows of the others."""
        frames, malformed, failed = self._scan(paths)
        errors = self.spark.createDataFrame(
            [(p.split("/")[-3], f"{p}: {e}") for p, e in failed], "client_key string, error_message string"
        ).groupBy("client_key").agg(
            F.array_join(F.sort_array(F.collect_set("error_message")), "\n").alias("error_message")
        )
        good = None
        if not frames:
            read = written = self.spark.createDataFrame([], "client_key string")
        else:
            good, bad = self._normalize(entity, frames)
            good = materialize(good)
            written, orphans = self._merge(entity, good, f"{entity}-{batch}", started)
            rejects = [
                m.select(
                    "client_key", "_file", F.lit(None).cast("bigint").alias("_line"),
                    F.lit(csv_files.MALFORMED).alias("_reason"),
                    F.create_map(F.lit("texto"), F.col("_text")).alias("_raw"),
                ) for m in malformed
            ]
            rejects += [x for x in (bad, orphans) if x is not None]
            read = good.select("client_key")
            if bad is not None:
                read = read.unionByName(bad.select("client_key"))
            columns = [f for f in REJECTS.fieldNames() if f != "entidade"]
            log = reduce(DataFrame.unionByName, [r.select(*columns) for r in rejects])
            self.store.save_result(
                "rejeitos", log.select(
                    "client_key", F.lit(entity).alias("entidade"), *columns[1:],
                    F.lit(f"{entity}-{batch}").alias("lote"),
                ), ["client_key", "lote"],
            )
        log = load.etl_run_log(read, written, started, self.clock(), "csv", errors)
        self.store.save_result(
            "etl_logs", log.withColumn("lote", F.lit(f"{entity}-{batch}")), ["client_key", "lote"],
        )
        return failed, good


def incremental_sync(
    spark: SparkSession, inbox: str, store: TableStore, checkpoint: str,
    interval: str | None = None, max_files: int = 1000,
    clock: Callable[[], datetime] = _utc_now, max_wait: timedelta = MAX_WAIT,
) -> StreamingQuery:
    """Merge new files of the inbox; once through by default, else every ``interval``.

    Files that earlier runs could not read are tried first.  Items wait up to ``max_wait`` for their sale.
    """
    batch = SyncBatch(store, clock, max_wait)
    batch.retry()
    found = (
        spark.readStream.format("binaryFile").schema(FOUND).option("maxFilesPerTrigger", max_files)
        .load(f"{inbox.rstrip('/')}/*/*/*").select("path")
    )
    writer = found.writeStream.foreachBatch(batch).option(
        "checkpointLocation", checkpoint
    )
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()
