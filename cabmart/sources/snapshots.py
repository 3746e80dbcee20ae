"""Snapshots of stored tables: one small file names the folders of every table.

A writer adds folders and never changes those that are there, so a frame that
was read before a run still reads the same rows after it.  At its end the writer publishes
a snapshot, ``_snapshots/s=<n>.json``, that lists each table's folder (or a
folder for each month).  The file is created only if it is absent: of two writers that started
from one snapshot the first wins, and the other gets ``ConcurrentRunError`` and
has changed nothing.  A writer that breaks off leaves folders that no snapshot names;
``vacuum`` deletes such folders.

Creating a file only if it is absent must be atomic in the storage: it is in HDFS, and
in object stores whose connector has conditional writes.
"""

from __future__ import annotations

import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_NAME = re.compile(r"^s=(\d+)\.json$")
#: Partition folder of a writer's number, above the month's.
RUN = "_run"


class ConcurrentRunError(RuntimeError):
    """Another writer has published a snapshot since this one read its own."""


class Snapshots:
    """The snapshots under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [st.getPath().getName() for st in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _create(self, path, text: str) -> bool:
        """Write a file that is not there yet; False if it is."""
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self._fs.exists(path):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def numbers(self) -> list[int]:
        return sorted(int(m.group(1)) for m in map(_NAME.match, self._names("_snapshots")) if m)

    def read(self, n: int) -> dict | None:
        """The content of snapshot ``n``; None if its writer broke off while writing it."""
        stream = self._fs.open(self._path("_snapshots", f"s={n}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def latest(self) -> tuple[int, dict]:
        """(number to build on, content); (-1, {}) where nothing is stored."""
        numbers = self.numbers()
        for n in reversed(numbers):
            content = self.read(n)
            if content is not None:
                return numbers[-1], content
        return (numbers[-1] if numbers else -1), {}

    def claim(self) -> int:
        """A number that no other writer has or will have, for the folders of one run."""
        n = max([int(x) for x in self._names("_claims") if x.isdigit()], default=-1) + 1
        while not self._create(self._path("_claims", str(n)), ""):
            n += 1
        return n

    def commit(self, base: int, content: dict) -> int:
        """Publish ``content`` as the successor of snapshot ``base``."""
        if not self._create(self._path("_snapshots", f"s={base + 1}.json"), json.dumps(content, sort_keys=True)):
            raise ConcurrentRunError(f"snapshot {base + 1} of {self.root} was published by another run; start again from it")
        return base + 1

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the last ``keep`` snapshots names; returns them.

        To be called while no run is writing and no older frame is read.
        """
        kept, tables = set(), set()
        for i, n in enumerate(reversed(self.numbers())):
            for name, entry in ((self.read(n) or {}).get("tables") or {}).items():
                tables.add(name)
                if i < keep:
                    kept |= {"/".join(filter(None, (name, f))) for f in folders(entry)}
        gone = []
        for name in tables:
            for folder in self._names(*filter(None, (name,))):
                if re.match(rf"^(v|{RUN})=\d+$", folder):
                    top = "/".join(filter(None, (name, folder)))
                    months = self._names(top) if folder.startswith(RUN) else []
                    for f in [f"{top}/{m}" for m in months if "=" in m] or [top]:
                        if f not in kept:
                            self._fs.delete(self._path(f), True)
                            gone.append(f)
        return sorted(gone)


def folders(entry: dict) -> list[str]:
    """The folders of a table's entry, below the table's own."""
    if "path" in entry:
        return [entry["path"]]
    return [f"{RUN}={run}/{entry['by']}={month}" for month, run in sorted(entry["months"].items())]


def open_entry(spark: SparkSession, root: str, entry: dict | None, months: list | None = None) -> DataFrame | None:
    """The rows of a table's entry, of the given months only if these are named; None without an entry.

    The schema is part of the entry, so no file is opened before a query runs.
    """
    if entry is None:
        return None
    schema = StructType.fromJson(json.loads(entry["schema"]))
    if "path" in entry:
        return spark.read.schema(schema).parquet(f"{root}/{entry['path']}")
    own = entry["months"] if months is None else {str(m): entry["months"][str(m)] for m in months if str(m) in entry["months"]}
    if not own:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/{f}" for f in folders({**entry, "months": own})]
    return spark.read.schema(schema).option("basePath", root).parquet(*paths).select(*schema.names)


class Build:
    """The tables of one root as a run sees them: those of its base snapshot, and what it has written itself."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.snapshots = spark, Snapshots(spark, root)
        self.root = self.snapshots.root
        self.base, content = self.snapshots.latest()
        self.before: dict = content.get("tables", {})
        self.tables: dict = dict(self.before)
        self.properties: dict = dict(content.get("properties", {}))
        self._number: int | None = None

    @property
    def number(self) -> int:
        if self._number is None:
            self._number = self.snapshots.claim()
        return self._number

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def stored(self, name: str, months: list | None = None) -> DataFrame | None:
        """The table as the base snapshot has it."""
        return open_entry(self.spark, self._at(name), self.before.get(name), months)

    def current(self, name: str, months: list | None = None) -> DataFrame | None:
        """The table with what this run has written."""
        return open_entry(self.spark, self._at(name), self.tables.get(name), months)

    def months(self, name: str) -> list[int]:
        return sorted(int(m) for m in self.before.get(name, {}).get("months", {}))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The whole table anew, in a folder of its own (L1, and small L2/L3 results)."""
        folder = f"v={self.number}"
        df.write.mode("errorifexists").parquet(f"{self._at(name)}/{folder}")
        self.tables[name] = {"path": folder, "schema": df.schema.json()}
        return self.current(name)

    def save_months(self, df: DataFrame, name: str, by: str, append: bool = False) -> list[int]:
        """The months present in ``df`` anew (``append``: beside what they hold); returns them.

        Files are cut by their size: a month of few rows has one task, a very large month many.
        """
        schema = StructType([f for f in df.schema.fields if f.name != by] + [df.schema[by]])
        folder = f"{RUN}={self.number}"
        df.select(*schema.names).hint("rebalance", by).write.mode("errorifexists").partitionBy(by).parquet(f"{self._at(name)}/{folder}")
        made = [m.split("=", 1)[1] for m in self.snapshots._names(*filter(None, (name, folder))) if m.startswith(f"{by}=")]
        old = self.tables.get(name, {}).get("months", {})
        self.tables[name] = {"by": by, "months": old | {m: self.number for m in made}, "schema": schema.json()}
        return sorted(int(m) for m in made)

    def publish(self) -> int:
        """Make all that was saved visible at once; raises ``ConcurrentRunError`` if another run came first."""
        return self.snapshots.commit(self.base, {"tables": self.tables, "properties": self.properties})
