"""Tables that are changed in one piece: snapshots named by manifests, the newest of which is the table.

A table is a folder.  Rows lie in buckets by the hash of their key, in a data folder for each commit; a manifest
lists, for each bucket, the folders that hold its rows.  A commit writes a data folder with the buckets it touches, then gives
the next manifest its name, which only one writer can (a rename that fails if the name is taken).  Who comes second
reads the new state and does its change again.  Readers see the manifest they began with; whatever a writer that died has left is in
no manifest, and ``vacuum`` deletes it.

Rows of untouched buckets are neither read nor written.  A manifest has at most ``buckets`` entries.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import delete

BUCKET, TRIES = "_bucket", 20


class Conflict(Exception):
    """Another writer's commit came first."""


class Versions:
    """A versioned table at ``path`` on any file system that Spark reaches; ``key`` is one column."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("").getFileSystem(self._conf)

    def create(self, schema: T.StructType, key: str, buckets: int = 64) -> Versions:
        """An empty table, version 0; raises Conflict if there is one."""
        self._publish(0, {"schema": schema.jsonValue(), "key": key, "buckets": buckets, "data": {}})
        return self

    def versions(self) -> list[int]:
        """Versions that can be read, oldest first."""
        folder = self._at("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None) -> tuple[int, dict]:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ValueError(f"no version {'' if version is None else version} of {self.path}")
        version = known[-1] if version is None else version
        stream = self._fs.open(self._at(f"manifests/{version:012d}.json"))
        try:
            return version, json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """Name a manifest; only the first writer of a version can."""
        made, name = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{version:012d}.json")
        stream = self._fs.create(made, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        none[0] = hadoop.Options.Rename.valueOf("NONE")
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(made), self._fs.makeQualified(name), none)
        except Exception as error:
            self._fs.delete(made, False)
            if isinstance(error, CapturedException) or "AlreadyExists" in str(error):
                raise Conflict(version) from error
            raise

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given."""
        return self._rows(self._manifest(version)[1], None)

    def _rows(self, manifest: dict, buckets: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        chosen = manifest["data"] if buckets is None else {b: f for b, f in manifest["data"].items() if int(b) in set(buckets)}
        paths = sorted(f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folders in chosen.items() for folder in folders)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, change: Callable[[dict], tuple[DataFrame, list[int], bool]]) -> int:
        """``change`` gives new rows, the buckets they are of and whether they take the place of what these hold."""
        for _ in range(TRIES):
            version, manifest = self._manifest(None)
            rows, buckets, whole = change(manifest)
            folder = f"{version + 1:012d}-{uuid.uuid4().hex}"
            names = [f["name"] for f in manifest["schema"]["fields"]]
            placed = rows.select(*names, self._bucket(manifest).alias(BUCKET))
            placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
            held = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._at(f"data/{folder}")) if "=" in s.getPath().getName()}
            data = {b: f for b, f in manifest["data"].items() if not (whole and int(b) in set(buckets))}
            for b in held:
                data[str(b)] = [*data.get(str(b), []), folder]
            try:
                self._publish(version + 1, manifest | {"data": data})
                return version + 1
            except Conflict:
                delete(self.spark, f"{self.path}/data/{folder}")
        raise Conflict(f"{TRIES} other commits came first")

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(manifest["key"])), F.lit(manifest["buckets"])).cast("int")

    def _touched(self, manifest: dict, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(manifest).alias("b")).distinct().collect()]  # no more than there are buckets

    def append(self, rows: DataFrame) -> int:
        """Add rows, whatever their keys; returns the version made, as all changes do."""
        return self._commit(lambda m: (rows, [], False))

    def insert_or_ignore(self, rows: DataFrame, order: list[str]) -> int:
        """Add rows whose key isn't there yet, the first by ``order`` of each key.  Null keys are never there."""

        def change(m: dict) -> tuple[DataFrame, list[int], bool]:
            first = F.row_number().over(Window.partitionBy(m["key"]).orderBy(*order))
            fresh = rows.withColumn("_first", first).where("_first = 1").drop("_first")
            return fresh.join(self._rows(m, self._touched(m, rows)).select(m["key"]), m["key"], "left_anti"), [], False

        return self._commit(change)

    def insert_or_replace(self, rows: DataFrame) -> int:
        """Add rows in place of those of their keys."""

        def change(m: dict) -> tuple[DataFrame, list[int], bool]:
            buckets = self._touched(m, rows)
            return self._rows(m, buckets).join(rows.select(m["key"]), m["key"], "left_anti").unionByName(rows), buckets, True

        return self._commit(change)

    def add_up(self, rows: DataFrame) -> int:
        """Add the amounts of rows (all columns but the key) to those that their keys have; new keys begin with theirs."""

        def change(m: dict) -> tuple[DataFrame, list[int], bool]:
            buckets = self._touched(m, rows)
            amounts = [F.sum(f["name"]).alias(f["name"]) for f in m["schema"]["fields"] if f["name"] != m["key"]]
            return self._rows(m, buckets).unionByName(rows).groupBy(m["key"]).agg(*amounts), buckets, True

        return self._commit(change)

    def delete(self, keys: DataFrame) -> int:
        """Leave out rows whose key is in a table of keys."""

        def change(m: dict) -> tuple[DataFrame, list[int], bool]:
            buckets = self._touched(m, keys)
            return self._rows(m, buckets).join(keys.select(m["key"]), m["key"], "left_anti"), buckets, True

        return self._commit(change)

    def replace(self, rows: DataFrame) -> int:
        """All rows anew, as one commit; ``rows`` may be made from a version of this table."""
        return self._commit(lambda m: (rows, list(range(m["buckets"])), True))

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the ``keep`` newest versions and what no manifest names; returns how many folders go.  For times without writers or older readers."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        used = {f for v in known[-keep:] for folders in self._manifest(v)[1]["data"].values() for f in folders}
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._at("data"))] if self._fs.exists(self._at("data")) else []
        gone = [f for f in folders if f not in used]
        for f in gone:
            self._fs.delete(self._at(f"data/{f}"), True)
        return len(gone)
