"""Published tables: finished folders become visible by one new manifest.

A manifest lists the folders of every table and the runs that wrote them. Rows are first written to
a folder of their own, where nobody sees them; creating the next numbered manifest publishes them,
for several tables at once or for none. A manifest file is never changed. Creating a number that
exists fails, so of two writers that started from one version the second has to start again.

Readers pick a manifest once and keep reading its folders. `vacuum` deletes what no kept manifest
names, and leaves young folders alone, since a run that is still going may own them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS, RUNS = "_manifests", "_runs"
RUN = "run"


class Conflict(RuntimeError):
    """Another writer published first; compute the change again from the new version."""


@dataclass(frozen=True)
class Snapshot:
    """What is visible at one version: folders by table, and the committed runs."""

    version: int = 0
    tables: Mapping[str, Sequence[str]] = field(default_factory=dict)
    runs: Sequence[Mapping] = ()

    def run(self, run_id: str) -> Mapping | None:
        return next((r for r in self.runs if r["run_id"] == run_id), None)


class Store:
    """Tables under one root folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, name: str) -> list:
        path = self._path(name)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _create(self, name: str, content: dict) -> None:
        """Write a small file whole or not at all; a file that exists makes it fail."""
        jvm = self.spark._jvm
        draft = self._path(f"{MANIFESTS}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        self._fs.mkdirs(self._path(name).getParent())
        try:
            context.rename(draft, self._path(name), options)
        except Py4JJavaError as failed:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(failed.java_exception.getClass().getName()):
                raise Conflict(f"{name} exists") from None
            raise

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    # --- versions -----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._list(MANIFESTS))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the one asked for."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Snapshot()
        found = self._load(f"{MANIFESTS}/v{version:012d}.json")
        return Snapshot(version, found["tables"], found["runs"])

    def manifest(self, schema: str) -> DataFrame:
        """The newest manifest as a row of ``schema``; no row before the first commit."""
        version = max(self.versions(), default=0)
        if not version:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("multiLine", True)
        return reader.json(f"{self.root}/{MANIFESTS}/v{version:012d}.json")

    def commit(
        self,
        base: Snapshot,
        replace: Mapping[str, Sequence[str]] | None = None,
        append: Mapping[str, Sequence[str]] | None = None,
        run: Mapping | None = None,
    ) -> Snapshot:
        """Publish new folders on top of ``base``, all or none. Raises `Conflict` if it is not the newest."""
        tables = {**base.tables, **(replace or {})}
        for table, folders in (append or {}).items():
            tables[table] = [*tables.get(table, ()), *folders]
        runs = [*base.runs, *([dict(run)] if run else [])]
        version = base.version + 1
        self._create(f"{MANIFESTS}/v{version:012d}.json", {"tables": tables, "runs": runs})
        return Snapshot(version, tables, runs)

    # --- rows ---------------------------------------------------------------------------------

    def stage(
        self,
        df: DataFrame,
        table: str,
        run_id: str | None = None,
        partition_by: Sequence[str] = (),
        metrics: Mapping[str, Column] | None = None,
    ) -> tuple[str, dict[str, int]]:
        """Write rows to a new folder of ``table``; -> its name and the metrics seen by the write.

        The folder carries the run and a fresh suffix, so what a failed attempt left is never read.
        """
        seen = Observation()
        asked = {"_rows": F.count("*"), **(metrics or {})}
        name = f"{RUN}={run_id or 'snapshot'}@{uuid.uuid4().hex}"
        observed = df.observe(seen, *[c.alias(k) for k, c in asked.items()])
        packed = observed.write.option("compression", "zstd")  # most of what is written is text
        packed.partitionBy(*partition_by).parquet(f"{self.root}/{table}/{name}")
        return name, {k: int(v or 0) for k, v in seen.get.items()}

    def read(
        self, table: str, schema: T.StructType, snapshot: Snapshot | None = None
    ) -> DataFrame:
        """Rows of a table at a version, with partition columns of ``schema`` pruned by folder."""
        folders = (snapshot or self.snapshot()).tables.get(table, ())
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        reader = self.spark.read.schema(schema).option("basePath", base)
        return reader.parquet(*[f"{base}/{f}" for f in folders]).select(*schema.names)

    def compact(self, table: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> Snapshot:
        """Rewrite all folders of a table as one. Readers of older versions keep theirs.

        Rows are dealt by partition value in salted shares, so files are as many as the session's
        shuffle partitions at most per value and no value is one task.
        """
        base = self.snapshot()
        rows = self.read(table, schema, base)
        if partition_by:
            share = F.pmod(F.xxhash64(*[c for c in schema.names if c not in partition_by]), F.lit(16))
            rows = rows.repartition(*partition_by, share)
        folder, _ = self.stage(rows, table, "compacted", partition_by)
        return self.commit(base, replace={table: [folder]})

    # --- runs ---------------------------------------------------------------------------------

    def note(self, run_id: str, state: str) -> None:
        """Record that a run reached a state. Noting it twice changes nothing."""
        try:
            self._create(f"{RUNS}/{run_id}/{state}.json", {"run_id": run_id, "state": state, "at": time.time()})
        except Conflict:
            pass

    def runs(self) -> DataFrame:
        """(run_id, state, at): one row per state that a run reached.

        ``committed`` comes from the newest manifest and nowhere else: a run is committed exactly if
        its rows are visible.
        """
        rows = [(r["run_id"], "committed", r["at"]) for r in self.snapshot().runs]
        for run in self._list(RUNS):
            name = run.getPath().getName()
            for state in self._list(f"{RUNS}/{name}"):
                found = self._load(f"{RUNS}/{name}/{state.getPath().getName()}")
                rows.append((found["run_id"], found["state"], found["at"]))
        return self.spark.createDataFrame(rows, "run_id string, state string, at double").withColumn(
            "at", F.timestamp_seconds("at")
        )

    # --- retention ----------------------------------------------------------------------------

    def _folders(self) -> Iterator[tuple[str, str, float]]:
        for table in self._list(""):
            name = table.getPath().getName()
            if table.isDirectory() and not name.startswith("_"):
                for folder in self._list(name):
                    yield name, folder.getPath().getName(), folder.getModificationTime() / 1000

    def vacuum(self, keep: int = 10, grace_s: float = 86_400.0) -> list[str]:
        """Delete folders that none of the last ``keep`` versions lists; -> their names.

        Folders written to within ``grace_s`` seconds stay, as a run may be about to publish them.
        Old manifests go first, so no reader can pick a version whose folders are being deleted.
        """
        versions = self.versions()
        kept = versions[-max(keep, 1) :]
        listed = {
            (table, folder)
            for version in kept
            for table, folders in self.snapshot(version).tables.items()
            for folder in folders
        }
        for version in versions:
            if version not in kept:
                self._fs.delete(self._path(f"{MANIFESTS}/v{version:012d}.json"), False)
        old = [
            f"{table}/{folder}"
            for table, folder, written in self._folders()
            if (table, folder) not in listed and time.time() - written >= grace_s
        ]
        for name in old:
            self._fs.delete(self._path(name), True)
        return old
