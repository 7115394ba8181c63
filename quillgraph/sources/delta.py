"""Keyed tables that are merged on read: a base, the changes since, and one manifest for all tables of a store.

A commit writes only the rows it changes, to a folder of a fresh name, and then the next manifest, which must be new: of two
writers that began from one manifest the second fails, and no file of the first is touched.  Readers see the state that the
last manifest names.  compact() folds a table's changes into a new base, clustered by its key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph


class Conflict(RuntimeError):
    """Another writer has committed since the state that a commit is based on."""


class Store:
    """Tables by name, each with key columns; one row a key.

    Folders: `<table>/<name>` with rows, `_gone` marking keys that are deleted; `manifests/<n>` the states.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    # Manifests -----------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        p, fs = self._fs("manifests")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []

    def _read(self, number: int) -> dict | None:
        """A manifest; None while its writer is still at it, or has died in that."""
        p, fs = self._fs(f"manifests/{number:08d}")
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}") else None

    def state(self, number: int | None = None) -> tuple[int, dict]:
        """(number, tables) of a manifest, or of the last whole one; 0 and none for a new store."""
        for n in [number] if number else reversed(self.versions()):
            if (found := self._read(n)) is not None:
                return n, found
        return 0, {}

    def _claim(self, number: int, tables: dict) -> None:
        p, fs = self._fs(f"manifests/{number:08d}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise Conflict(f"manifest {number} was written by another writer") from e
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        out.close()

    # Reads ---------------------------------------------------------------------------------------------

    def read(self, table: str, schema: str | None = None, number: int | None = None) -> DataFrame:
        """A table as of a manifest (the last one): its base, less what later changes have of the same keys, and those."""
        own = self.state(number)[1].get(table)
        if own is None:
            if schema is None:
                raise LookupError(f"no table {table}")
            return self.spark.createDataFrame([], schema)
        kinds = own["schema"]
        base = self.spark.read.schema(kinds).parquet(f"{self.path}/{table}/{own['base']}") if own["base"] else self.spark.createDataFrame([], kinds)
        columns = base.columns
        if not own["deltas"]:
            return base
        keys = self.keys[table]
        deltas = None
        for k, name in enumerate(own["deltas"]):
            part = self.spark.read.schema(f"{kinds}, _gone boolean").parquet(f"{self.path}/{table}/{name}").withColumn("_turn", F.lit(k))
            deltas = part if deltas is None else deltas.unionByName(part)
        if len(own["deltas"]) > 1:
            rest = [c for c in deltas.columns if c not in keys]
            deltas = deltas.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_turn").alias("_last")).select(*keys, "_last.*")
        now = deltas.where("not _gone").select(*columns)
        if not own["base"]:
            return now
        # The changed keys are broadcast only while they are few.
        size = sum(graph.stored_bytes(self.spark, f"{self.path}/{table}/{name}") for name in own["deltas"])
        kept = base.join(graph.unsent(deltas.select(*keys), size), keys, "left_anti")
        return kept.select(*columns).unionByName(now)

    # Writes --------------------------------------------------------------------------------------------

    def commit(self, changes: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, based_on: int | None = None) -> int:
        """Puts rows by key into tables and deletes keys (gone), all at once; returns the manifest's number.

        A row that is new here sets the table's columns; a table without a change keeps its files.  based_on: the state that
        the changes were derived from; if it is no longer the last one, that is a Conflict and nothing changes.
        """
        number, tables = self.state()
        if based_on is not None and based_on != number:
            raise Conflict(f"based on manifest {based_on}, but the last one is {number}")
        tables = json.loads(json.dumps(tables))
        gone = gone or {}
        for table in {**changes, **gone}:
            rows, out = changes.get(table), gone.get(table)
            own = tables.setdefault(table, {"base": None, "deltas": [], "schema": None})
            if own["schema"] is None:
                own["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            like = self.spark.createDataFrame([], own["schema"])
            part = (rows if rows is not None else like).select(*like.columns).withColumn("_gone", F.lit(False))
            if out is not None:
                missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema if f.name not in self.keys[table]]
                part = part.unionByName(out.select(*self.keys[table], *missing, F.lit(True).alias("_gone")))
            name = f"delta-{uuid.uuid4().hex}"
            part.write.parquet(f"{self.path}/{table}/{name}")
            own["deltas"].append(name)
        last = max(self.versions(), default=0)
        if last > number:
            raise Conflict(f"manifest {last} was written meanwhile")
        self._claim(number + 1, tables)
        return number + 1

    def compact(self, table: str, most: int = 0, files: int | None = None) -> bool:
        """Folds a table's changes into a new base if there are more than `most` of them.

        The base is dealt by ranges of its first key and sorted within them, with Bloom filters on it, so that a lookup of one
        key, or of a range of keys, reads few files and few of their row groups.
        """
        number, tables = self.state()
        own = tables.get(table)
        if own is None or len(own["deltas"]) <= most:
            return False
        key = self.keys[table][0]
        whole = self.read(table, number=number)
        ranged = whole.repartitionByRange(files, key) if files else whole.repartitionByRange(key)
        name = f"base-{uuid.uuid4().hex}"
        ranged.sortWithinPartitions(*self.keys[table]).write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{self.path}/{table}/{name}")
        last = max(self.versions(), default=0)
        if last > number:
            raise Conflict(f"manifest {last} was written meanwhile")
        self._claim(number + 1, {**tables, table: {**own, "base": name, "deltas": []}})
        return True

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the newest, and folders that none of those names; also what writers left that failed.

        For times without writers, as one that has written its rows but no manifest yet would lose them.
        """
        numbers = self.versions()
        for n in numbers[:-keep]:
            p, fs = self._fs(f"manifests/{n:08d}")
            fs.delete(p, False)
        named = {(t, x) for n in numbers[-keep:] for t, own in (self._read(n) or {}).items() for x in [own["base"], *own["deltas"]]}
        out = []
        for table in self.keys:
            p, fs = self._fs(table)
            for x in fs.listStatus(p) if fs.exists(p) else []:
                name = x.getPath().getName()
                if (table, name) not in named:
                    fs.delete(x.getPath(), True)
                    out.append(f"{table}/{name}")
        return sorted(out)


def by_key(table: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of one key; on a compacted base a scan of the few row groups whose range and filter allow it."""
    return table.where(F.col(key) == value)


def by_prefix(table: DataFrame, key: str, prefix: str) -> DataFrame:
    """The rows whose key begins with a prefix, as a range, so that the scan skips the row groups outside it."""
    if not prefix:
        return table
    out = table.where(F.col(key) >= prefix)
    # The least string after all that begin with the prefix; there is none after the last code point.
    ahead = prefix.rstrip("\U0010ffff")
    return out.where(F.col(key) < ahead[:-1] + _after(ahead[-1])) if ahead else out.where(F.startswith(F.col(key), F.lit(prefix)))


def _after(c: str) -> str:
    """The code point after c in the order of UTF-8 bytes; surrogates are no characters."""
    return "\ue000" if c == "\ud7ff" else chr(ord(c) + 1)
