"""Tables kept as parquet under one root, laid out by shop, with snapshots for readers.

Files are written once, below a folder of their own for each write, and never
changed.  A manifest lists the partitions of which the table consists and the
write that each of them comes from; a write counts from the moment in which
the next manifest appears, in one step.  So a frame keeps the rows it was
planned with, a write that was cut short shows nothing, and of two writers who
start from the same manifest the second one looks at what the first one did.

The manifest is held by the driver: one line for each partition, as in the
list of files that Spark's reader keeps for a partitioned table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime, timedelta, timezone
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopgrain.functions.ordering import top_n
from shopgrain.sources import files
from shopgrain.sources.shared import clear_idle_scratch

SHOP_COLUMN = ["client_key"]
#: Folders of a table: its rows, and the partition in which each key lies.
ROWS, KEYS = "rows", "keys"
#: Parts of a shop's key index.
KEY_PARTS = 64
PART = "parte_chave"
#: How long superseded files stay for readers under way.
KEEP = timedelta(days=7)
CLEAN_EVERY = 16
ATTEMPTS = 5

Versions = dict[str, dict]


class Changed(RuntimeError):
    """Another write replaced partitions that this one was computed from."""


class Snapshot(NamedTuple):
    """A manifest: its number (0: none yet), the columns, and the partitions of each write."""

    number: int
    schema: T.StructType | None
    rows: Versions
    keys: Versions | None

    def text(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), ROWS: self.rows, KEYS: self.keys})


NOTHING = Snapshot(0, None, {}, None)


def _without(versions: Versions, gone: Iterable[str]) -> Versions:
    """What is left of the writes when these partitions are superseded."""
    gone, out = set(gone), {}
    for version, entry in versions.items():
        left = [x for x in entry["leaves"] if x not in gone]
        if left or not entry["leaves"]:
            out[version] = entry if len(left) == len(entry["leaves"]) else {"leaves": left, "whole": False}
    return out


def _origin(versions: Versions | None) -> dict[str, str]:
    """The write that each partition comes from."""
    return {leaf: version for version, entry in (versions or {}).items() for leaf in entry["leaves"]}


def _stored(schema: T.StructType) -> T.StructType:
    """Columns as they are read: shop keys are text even where every one of them looks like a number."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.name == "client_key" else f.dataType) for f in schema.fields
    ])


def _part(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(KEY_PARTS)).cast("int").alias(PART)


class TableStore:
    """Result and canonical tables, each partitioned by ``client_key`` first.

    Writes replace whole partitions; tables are read as of the last manifest.
    """

    def __init__(self, spark: SparkSession, root: str, keep: timedelta = KEEP):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep = keep

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _manifests(self, name: str) -> list[str]:
        found = files.children(self.spark, f"{self.path(name)}/_manifest")
        return [p for p in found if not p.rsplit("/", 1)[-1].startswith(".")]

    def _load(self, path: str) -> Snapshot:
        body = json.loads(files.read_text(self.spark, path))
        return Snapshot(int(path.rsplit("/", 1)[-1]), T.StructType.fromJson(body["schema"]), body[ROWS], body[KEYS])

    def snapshot(self, name: str) -> Snapshot:
        found = self._manifests(name)
        return self._load(found[-1]) if found else NOTHING

    def exists(self, name: str) -> bool:
        return bool(self._manifests(name))

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """The table as it is now, or no rows where it was never written.

        The frame keeps these rows whatever is written later, for as long as
        superseded files are kept.
        """
        now = self.snapshot(name)
        want = schema or now.schema or T.StructType([T.StructField("client_key", T.StringType())])
        return self._frame(name, ROWS, now.rows, want)

    def _frame(
        self, name: str, folder: str, versions: Versions | None, schema: T.StructType, only: set[str] | None = None
    ) -> DataFrame:
        """Rows of the listed partitions, or of those of them that are in ``only``."""
        base, schema, paths = f"{self.path(name)}/{folder}", _stored(schema), []
        for version, entry in (versions or {}).items():
            leaves = [x for x in entry["leaves"] if only is None or x in only]
            top = f"{base}/versao={version}"
            if entry["whole"] and leaves and len(leaves) == len(entry["leaves"]):
                paths.append(top)
            else:
                paths += [f"{top}/{leaf}" for leaf in leaves]
        if not paths:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
        return rows.select(*[F.col(f"`{c}`") for c in schema.fieldNames()])

    def _write(self, name: str, folder: str, rows: DataFrame, parts: Sequence[str]) -> Versions:
        """Write rows below a new name, a few files of the advised size for each partition."""
        version = uuid.uuid4().hex
        base = f"{self.path(name)}/{folder}"
        top = f"{base}/versao=v{version}"
        rows.hint("rebalance", *[F.col(c) for c in parts]).write.partitionBy(*parts).parquet(top)
        found = self.spark.read.schema(_stored(rows.schema)).option("basePath", base).parquet(top).inputFiles()
        leaves = {unquote(f).split(f"versao=v{version}/", 1)[1].rpartition("/")[0] for f in found} - {""}
        return {f"v{version}": {"leaves": sorted(leaves), "whole": True}}

    def _commit(self, name: str, change: Callable[[Snapshot], Snapshot]) -> None:
        """Put the next manifest in place, made from the last one whoever wrote it."""
        while True:
            now = self.snapshot(name)
            path = f"{self.path(name)}/_manifest/{now.number + 1:012d}"
            if files.create_text(self.spark, path, change(now).text()):
                break
        if (now.number + 1) % CLEAN_EVERY == 0:
            self.vacuum(name)

    def save_result(
        self, name: str, df: DataFrame, partition_by: Sequence[str] = SHOP_COLUMN
    ) -> None:
        """Replace the rows of every shop that has a result; others keep theirs."""
        new = self._write(name, ROWS, df, partition_by)
        leaves = _origin(new)

        def change(now: Snapshot) -> Snapshot:
            if not leaves:
                return now._replace(schema=df.schema)
            # Keys may lie elsewhere now: the next merge lists them anew.
            return Snapshot(now.number, df.schema, {**_without(now.rows, leaves), **new}, None)

        self._commit(name, change)

    def load_result(self, name: str) -> DataFrame:
        return self.read(name)

    def publish_cache(self, name: str, df: DataFrame, top: int | None = None, *order) -> None:
        """Replace a serving table, optionally with the first ``top`` rows per shop."""
        self.save_result(name, df if top is None else top_n(df, top, *order))

    def merge(
        self, name: str, incoming: DataFrame, keys: Sequence[str],
        partition_by: Sequence[str], merge_fn: Callable[[DataFrame, DataFrame], DataFrame],
        batch: str, schema: T.StructType,
    ) -> None:
        """Apply ``merge_fn(current, incoming)`` to the partitions the batch touches.

        It may add, change and drop rows of the incoming keys only.  Where the
        partition does not follow from the key, an index by hash of the key
        says where the incoming keys lie: its parts and the touched partitions
        are all that is read.  A merge that another write overtook on the same
        partitions is computed again; ``batch`` names it in errors.
        """
        for _ in range(ATTEMPTS):
            try:
                return self._merge_once(name, incoming, list(keys), list(partition_by), merge_fn, schema)
            except Changed:
                continue
        raise Changed(f"{name}: partitions of batch {batch} were replaced by others {ATTEMPTS} times")

    def _merge_once(
        self, name: str, incoming: DataFrame, keys: list[str], parts: list[str],
        merge_fn: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType,
    ) -> None:
        seen = self.snapshot(name)
        places = incoming.select(*parts)
        index, index_leaves = None, set()
        if not set(parts) <= set(keys):
            index, index_leaves = self._key_rows(name, seen, incoming, keys, parts, schema)
            mine = incoming.select(*keys).distinct()
            if seen.rows:
                places = places.unionByName(index.join(mine, keys, "left_semi").select(*parts))
        touched = self._leaves(places, parts)
        new = self._write(name, ROWS, merge_fn(self._frame(name, ROWS, seen.rows, schema, touched), incoming), parts)
        new_keys = None
        if index is not None:
            now_at = self._frame(name, ROWS, new, schema).select(*keys, *[p for p in parts if p not in keys])
            listed = index.join(mine, keys, "left_anti").unionByName(
                now_at.join(mine, keys, "left_semi").distinct()
            )
            new_keys = self._write(name, KEYS, listed.select("*", _part(keys)), [*SHOP_COLUMN, PART])
        before, before_keys = _origin(seen.rows), _origin(seen.keys)

        def change(now: Snapshot) -> Snapshot:
            at, at_keys = _origin(now.rows), _origin(now.keys)
            touched_now = touched | set(_origin(new))
            if any(at.get(x) != before.get(x) for x in touched_now):
                raise Changed(name)
            rows = {**_without(now.rows, touched_now), **new}
            if new_keys is None:
                return Snapshot(now.number, schema, rows, now.keys)
            if (now.keys is None) != (seen.keys is None) or any(at_keys.get(x) != before_keys.get(x) for x in index_leaves):
                raise Changed(name)
            return Snapshot(now.number, schema, rows, {**_without(now.keys or {}, index_leaves), **new_keys})

        self._commit(name, change)

    def _key_rows(
        self, name: str, seen: Snapshot, incoming: DataFrame, keys: list[str], parts: list[str], schema: T.StructType
    ) -> tuple[DataFrame, set[str]]:
        """Key and partition columns of the index parts that the batch needs, and the names of these parts.

        Without an index all keys of the table are listed.
        """
        columns = [*keys, *[p for p in parts if p not in keys]]
        if seen.keys is None:
            return self._frame(name, ROWS, seen.rows, schema).select(*columns).distinct(), set()
        leaves = self._leaves(incoming.select(*SHOP_COLUMN, _part(keys)), [*SHOP_COLUMN, PART])
        types = T.StructType([*[schema[c] for c in columns], T.StructField(PART, T.IntegerType())])
        return self._frame(name, KEYS, seen.keys, types, leaves).drop(PART), leaves

    def _leaves(self, places: DataFrame, parts: Sequence[str]) -> set[str]:
        """Folders of the partitions that occur in ``places``."""
        found = places.select(*[F.col(c).cast("string").alias(c) for c in parts]).distinct()
        return {files.partition_leaf(self.spark, [(c, r[c]) for c in parts]) for r in found.toLocalIterator()}

    def vacuum(self, name: str, keep: timedelta | None = None) -> None:
        """Delete what no manifest of the last ``keep`` names, and manifests older than that but the last.

        Folders of writes that never counted go too once they are as old.
        """
        limit = datetime.now(timezone.utc) - (self.keep if keep is None else keep)
        found = self._manifests(name)
        # A manifest is in force until the next one appears.
        old = [p for p, after in zip(found, found[1:]) if files.modified(self.spark, after) < limit]
        live = [self._load(p) for p in found if p not in old]
        for folder in (ROWS, KEYS):
            used = {(v, x) for s in live for x, v in _origin(getattr(s, folder)).items()}
            writes = {v for v, _ in used}
            gone = {(v, x) for p in old for x, v in _origin(getattr(self._load(p), folder)).items()} - used
            base = f"{self.path(name)}/{folder}"
            for version, leaf in gone:
                if version in writes:
                    files.remove(self.spark, f"{base}/versao={version}/{leaf}")
            for path in files.children(self.spark, base):
                if path.rsplit("=", 1)[-1] not in writes and files.modified(self.spark, path) < limit:
                    files.remove(self.spark, path)
        for path in old:
            files.remove(self.spark, path)

    def names(self) -> list[str]:
        found = [p.rsplit("/", 1)[-1] for p in files.children(self.spark, self.root)]
        return [n for n in found if not n.startswith(("_", ".")) and self.exists(n)]

    def erase_tenant(self, client_key: str, idle: timedelta = timedelta(days=1)) -> list[str]:
        """Drop every partition of a shop from all tables, old files included; returns the tables it was in.

        Other shops' reads and merges may be under way.  A merge of this shop
        is computed anew without its old rows.  Intermediate results hold all
        shops' rows: those of applications that have written none for ``idle``
        are deleted, those of running ones end with their run
        (:func:`~shopgrain.sources.shared.clear_scratch`).
        """
        leaf = files.partition_leaf(self.spark, [("client_key", client_key)])

        def of_shop(versions: Versions | None) -> set[str]:
            return {x for x in _origin(versions) if x == leaf or x.startswith(f"{leaf}/")}

        def change(now: Snapshot) -> Snapshot:
            keys = None if now.keys is None else _without(now.keys, of_shop(now.keys))
            return now._replace(rows=_without(now.rows, of_shop(now.rows)), keys=keys)

        hit = []
        for name in self.names():
            if of_shop(self.snapshot(name).rows):
                hit.append(name)
                self._commit(name, change)
            for folder in (ROWS, KEYS):
                for write in files.children(self.spark, f"{self.path(name)}/{folder}"):
                    files.remove(self.spark, f"{write}/{leaf}")
        clear_idle_scratch(self.spark, idle)
        return hit
