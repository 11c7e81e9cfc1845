"""Keyed tables on plain files: append, upsert, additive merge, and tables in parts that change together."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_new(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key the target lacks, one per key."""
    return batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row per key by the version column; of equal versions the new row."""
    both = target.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n", "_new")


def merge_add(target: DataFrame, deltas: DataFrame, keys: list[str], sums: list[str], greatest: list[str]) -> DataFrame:
    """Counters added up and maxima kept per key."""
    both = target.unionByName(deltas.select(*target.columns))
    return both.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in sums], *[F.max(c).alias(c) for c in greatest])


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table that the optimizer knows to be empty: joins and unions with it cost nothing."""
    fields = T.StructType.fromDDL(schema).fields
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).filter(F.lit(False))


class Conflict(RuntimeError):
    """Another writer has committed since the view was taken that a change is made from."""


class Folder:
    """Small files under a folder, through the file system that Spark finds for it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        where = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file in one step; False if there is one of that name."""
        beside = f"_{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(beside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._at(name)):
            self.delete(beside)
            return False
        self._fs.mkdirs(self._at(name).getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._at(beside), self._at(name), none)  # an error where the name is taken
        except Exception:
            self.delete(beside)
            if self._fs.exists(self._at(name)):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class View:
    """What a store holds at one version."""

    def __init__(self, store: Store, version: int, batch: int | None, places: dict[str, dict[str, str]]):
        self.store, self.version, self.batch, self.places = store, version, batch, places

    def parts(self, name: str) -> list[str]:
        """Parts that have rows."""
        return sorted(self.places.get(name, {}))

    def since(self, name: str, first: int) -> list[str]:
        """Parts of a table by number from one on."""
        return [p for p in self.parts(name) if int(p) >= first]

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """All rows of a table, or those of some parts."""
        spark, schema = self.store.spark, self.store.tables[name][0]
        wanted = None if parts is None else set(parts)
        paths = [f"{self.store.path}/{place}/_part={p}" for p, place in sorted(self.places.get(name, {}).items()) if wanted is None or p in wanted]
        return spark.read.schema(schema).parquet(*paths) if paths else no_rows(spark, schema)


class Store:
    """Tables in parts under one folder, whose changes are committed together.

    tables gives each table's schema and the column that tells a row's part: a day, a range of
    blocks, a hash; thousands in all, as the driver lists them. A commit writes the parts it touches, whole, to folders of its own and then one
    small file with the places of all parts, under the next version's name. A reader takes the latest of those
    files, so it sees all of a commit or nothing, and reads it alone however many there have been. A writer
    names the view that it started from: if another has committed since, a stream's batch or a rewind, its own
    commit is a Conflict and it starts again from what is there now.

    Batches are numbered apart from versions: a batch that is in already changes nothing, and commits
    without a batch leave the number as it is.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, Column]]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self._folder = Folder(spark, path)

    def _versions(self) -> list[int]:
        return [int(name) for name in self._folder.names("commits") if name.isdigit()]

    def view(self, version: int | None = None) -> View:
        """The latest version, or one that is kept."""
        held = self._versions()
        if not held:
            return View(self, 0, None, {})
        entry = json.loads(self._folder.read(f"commits/{version or max(held):012d}"))
        return View(self, entry["version"], entry["batch"], entry["places"])

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame:
        return self.view().read(name, parts)

    def parts(self, name: str, rows: DataFrame) -> list[str]:
        """The parts that rows belong to."""
        return sorted(r[0] for r in rows.select(self.tables[name][1].cast("string").alias("part")).distinct().collect())

    def within(self, name: str, rows: DataFrame, parts: list[str]) -> DataFrame:
        """Rows that belong to some parts."""
        return rows.filter(self.tables[name][1].cast("string").isin(parts)) if parts else rows.limit(0)

    def applied(self, batch: int, view: View | None = None) -> bool:
        """Whether a batch is in already. One before the last means that batches are numbered anew, which would lose them."""
        held = (view or self.view()).batch
        if held is not None and batch < held:
            raise RuntimeError(f"batch {batch} after {held}: the stream's checkpoint does not belong to {self.path}")
        return held == batch

    def commit(self, changes: dict[str, tuple[DataFrame, list[str]]], batch: int | None = None, view: View | None = None) -> bool:
        """Replaces the named parts of tables by rows that belong to them; False if the batch is in already.

        view is what the changes were made from; without one they do not depend on what was there.
        """
        view = view or self.view()
        if batch is not None and self.applied(batch, view):
            return False
        version, places = view.version + 1, {name: dict(at) for name, at in view.places.items()}
        for name, (rows, parts) in changes.items():
            schema, part = self.tables[name]
            columns = [c.name for c in T.StructType.fromDDL(schema)]
            place = f"{name}/v{version}-{uuid.uuid4().hex}"
            rows.select(*columns, part.cast("string").alias("_part")).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.path}/{place}")
            filled = {n.removeprefix("_part=") for n in self._folder.names(place) if n.startswith("_part=")}
            if filled - set(parts):
                raise ValueError(f"{name}: rows of parts {sorted(filled - set(parts))[:5]}, which are not replaced")
            own = places.setdefault(name, {})
            for p in parts:
                own.pop(p, None)
            own.update(dict.fromkeys(filled, place))
        entry = {"version": version, "batch": view.batch if batch is None else batch, "places": places}
        if not self._folder.create(f"commits/{version:012d}", json.dumps(entry)):
            raise Conflict(f"version {version} of {self.path} is there")
        return True

    @contextmanager
    def stage(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """Writes rows of a change under way beside the tables, to be read more than once; they go when it is done.

        On disk they take a fraction of what cached rows take, and each reading takes its columns alone.
        """
        folder = f"stage/{uuid.uuid4().hex}"

        def put(rows: DataFrame) -> DataFrame:
            place = f"{self.path}/{folder}/{uuid.uuid4().hex}"
            rows.write.parquet(place)
            return self.spark.read.schema(rows.schema).parquet(place)

        try:
            yield put
        finally:
            self._folder.delete(folder)

    @contextmanager
    def pinned(self) -> Iterator[View]:
        """A view whose files stay until it is let go."""
        view = self.view()
        pin = f"pins/{view.version}-{uuid.uuid4().hex}"
        self._folder.create(pin, "")
        try:
            yield view
        finally:
            self._folder.delete(pin)

    def expire(self, keep: int = 10) -> int:
        """Deletes versions but for the last ``keep`` and pinned ones, and parts that none of those holds; how many went."""
        held = sorted(self._versions())
        pins = {int(re.match(r"\d+", name)[0]) for name in self._folder.names("pins")}
        kept = [v for v in held if v in held[-keep:] or v in pins]
        used = {(place, p) for v in kept for at in self.view(v).places.values() for p, place in at.items()}
        gone = [v for v in held if v not in kept]
        for name in self.tables:
            for folder in self._folder.names(name):
                if not kept or int(folder[1:].split("-")[0]) > kept[-1]:
                    continue  # of a commit under way
                place = f"{name}/{folder}"
                parts = [n.removeprefix("_part=") for n in self._folder.names(place) if n.startswith("_part=")]
                live = [p for p in parts if (place, p) in used]
                for p in [] if live else [None]:
                    self._folder.delete(place)
                for p in parts if live else []:
                    if p not in live:
                        self._folder.delete(f"{place}/_part={p}")
        for v in gone:
            self._folder.delete(f"commits/{v:012d}")
        return len(gone)


class Snapshots:
    """Versions of a small table under one folder, of which the last two are kept.

    A reader never sees a part of one, and a repeated write of the same version changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self._store = Store(spark, path, {"rows": (schema, F.lit(0))})

    def latest(self) -> int | None:
        return self._store.view().batch

    def read(self) -> DataFrame:
        """The latest version; an empty table before the first."""
        return self._store.read("rows")

    def write(self, rows: DataFrame, version: int) -> bool:
        """Writes a version newer than the latest; False for one that has been written."""
        view = self._store.view()
        if view.batch is not None and version <= view.batch:
            return False
        self._store.commit({"rows": (rows, ["0"])}, version, view)
        self._store.expire(2)
        return True
