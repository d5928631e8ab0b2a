"""A warehouse of immutable table versions, made visible together by a manifest.

``commit`` writes a new version of each table it is given, or adds a part to it, and then one
manifest that names the parts of every table. Readers follow the newest manifest, so a commit of
several tables is seen whole or not at all, a failed write leaves what was there, and no path is
read and overwritten at once. A table of several parts is read as one row per key: every column's
latest non-null value. So adding rows costs what the rows cost; after ``MOST_PARTS`` parts the
table is written anew. Versions that no manifest of the last few names can be pruned.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import schemas
from broadsheet.errors import StorageError
from broadsheet.operators.upsert import coalesced


#: Parts of a table after which it is written as one again.
MOST_PARTS = 64
#: Columns of added rows that replace what was there even by null, and those that keep the first value.
REPLACED, KEPT = {"stories": ["raw_json"]}, {"stories": ["first_seen_at"]}


def _parts(entry: str | list[str] | None) -> list[str]:
    return [] if entry is None else [entry] if isinstance(entry, str) else entry


class Warehouse:
    """Tables under a root on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str, must_exist: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if must_exist and not self._manifests():
            raise StorageError(f"no warehouse at {root}")

    def exists(self, path: str) -> bool:
        """True if there is a file or folder ``path`` under the root."""
        return self._fs.exists(self._path(f"{self.root}/{path}"))

    def remove(self, path: str) -> None:
        """Delete a file or folder ``path`` under the root, if there is one."""
        self._fs.delete(self._path(f"{self.root}/{path}"), True)

    # manifests ---------------------------------------------------------------

    def _manifests(self) -> list[str]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(n for n in names if n.endswith(".json"))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict:
        """{"schema_version": n, "tables": {name: path}} of the newest commit, empty before the first."""
        names = self._manifests()
        found = self._read(names[-1]) if names else {"schema_version": schemas.SCHEMA_VERSION, "tables": {}}
        if found["schema_version"] > schemas.SCHEMA_VERSION:
            raise StorageError(f"stored version {found['schema_version']} is newer than {schemas.SCHEMA_VERSION}")
        return found

    # tables ------------------------------------------------------------------

    def read(self, table: str) -> DataFrame:
        """The table as of the newest commit, with today's columns; empty if it was never written."""
        return self._of(table, _parts(self.manifest()["tables"].get(table)))

    def _of(self, table: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schemas.schema(table))
        read = lambda p: self.spark.read.schema(schemas.schema(table)).parquet(f"{self.root}/{p}")
        if len(parts) == 1:
            return read(parts[0])
        log = reduce(DataFrame.unionByName, [read(p).withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
        names = schemas.schema(table).names
        return coalesced(log, schemas.KEYS[table], ["__part"], REPLACED.get(table, ()), KEPT.get(table, ())).select(*names)

    def commit(self, changes: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> dict:
        """Replace the tables of ``changes`` and add the rows of ``added``, all together; returns the new manifest."""
        names = self._manifests()
        before = self.manifest()["tables"]
        number = int(names[-1][:12]) + 1 if names else 1
        after = dict(before)
        for table, df in changes.items():
            path = f"{table}/{number:012d}-{uuid.uuid4().hex[:8]}"
            schemas.conform(df, table).write.parquet(f"{self.root}/{path}")
            after[table] = path
        for table, df in (added or {}).items():
            path = f"{table}/{number:012d}-{uuid.uuid4().hex[:8]}"
            schemas.conform(df, table).write.parquet(f"{self.root}/{path}")
            after[table] = [*_parts(after.get(table)), path]
            if len(after[table]) > MOST_PARTS:
                whole = f"{table}/{number:012d}-{uuid.uuid4().hex[:8]}"
                self._of(table, after[table]).write.parquet(f"{self.root}/{whole}")
                after[table] = whole
        made = {"schema_version": schemas.SCHEMA_VERSION, "tables": after}
        target = self._path(f"{self.root}/_manifests/{number:012d}.json")
        try:
            stream = self._fs.create(target, False)  # fails if another writer took the number
        except Exception as e:  # noqa: BLE001
            raise StorageError(f"another writer committed {number}") from e
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        return made

    def initialise(self) -> dict:
        """Create every table that doesn't exist yet, empty."""
        have = self.manifest()["tables"]
        return self.commit({t: self.spark.createDataFrame([], schemas.schema(t)) for t in schemas.tables() if t not in have})

    def replace_topic(self, table: str, topic: str, rows: DataFrame) -> DataFrame:
        """The table with one topic's rows replaced; other topics as they are."""
        return self.read(table).filter(~F.col("topic").eqNullSafe(F.lit(topic))).unionByName(schemas.conform(rows, table))

    def prune(self, keep: int = 5) -> int:
        """Delete versions that none of the last ``keep`` manifests names; returns how many."""
        names = self._manifests()
        used = {p for n in names[-keep:] for entry in self._read(n)["tables"].values() for p in _parts(entry)}
        gone = 0
        for table in schemas.tables():
            folder = self._path(f"{self.root}/{table}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{table}/{status.getPath().getName()}" not in used:
                    self._fs.delete(status.getPath(), True)
                    gone += 1
        for name in names[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{name}"), False)
        return gone
