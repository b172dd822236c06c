"""A Parquet table in versions, swapped as a whole: a job may read a table, change it and replace it.

A version is a folder of Parquet files. A log of numbered entries says which folder is current; an entry is written beside
the log and renamed into it, which fails if the number is taken, so of two writers one succeeds and the other starts over. A run
that dies before the rename leaves a folder that nothing names and changes nothing. Each entry lists the parts
merged so far, so a part that comes again, after a restart, is left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.sinks import keep_last


class Overtaken(RuntimeError):
    """Another writer has made the next version."""


@dataclass
class Entry:
    number: int
    folder: str
    parts: list[str]


class VersionedTable:
    """The table at ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._at("log").getFileSystem(self._conf)

    def entry(self) -> Entry | None:
        """The newest entry of the log."""
        fs = self._fs()
        if not fs.exists(self._at("log")):
            return None
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(self._at("log")) if s.getPath().getName().isdigit()]
        if not numbers:
            return None
        stream = fs.open(self._at("log", f"{max(numbers):012d}"))
        try:
            said = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Entry(max(numbers), said["folder"], said["parts"])

    def read(self) -> DataFrame | None:
        """The current version, or None before the first."""
        now = self.entry()
        return None if now is None else self.spark.read.parquet(f"{self.path}/{now.folder}")

    def _swap(self, number: int, folder: str, parts: list[str]) -> None:
        fs = self._fs()
        fs.mkdirs(self._at("log"))
        draft = self._at("drafts", uuid.uuid4().hex)
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"folder": folder, "parts": parts}).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._at("log", f"{number:012d}"), none)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(self._at("log", f"{number:012d}")):
                raise Overtaken(self.path) from e
            raise

    def replace(self, rows: DataFrame, seen: Entry | None = None, part: str | None = None) -> None:
        """Make ``rows`` the current version, if that is still ``seen``. ``rows`` may come from this table."""
        folder = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._swap(seen.number + 1 if seen else 0, folder, [*(seen.parts if seen else []), *([part] if part else [])])

    def merge(self, new: DataFrame, keys: list[str], part: str | None = None, tries: int = 5) -> bool:
        """Upsert ``new``, its rows winning over those of the same keys. False if the part was merged before."""
        for _ in range(tries):
            now = self.entry()
            if now is not None and part is not None and part in now.parts:
                return False
            rows = new if now is None else keep_last(self.spark.read.parquet(f"{self.path}/{now.folder}"), new, keys)
            try:
                self.replace(rows, now, part)
                return True
            except Overtaken:
                continue
        raise Overtaken(self.path)

    def vacuum(self) -> int:
        """Remove all folders but the current version's, also those that dead runs left; none may be writing. How many."""
        now, fs, gone = self.entry(), self._fs(), 0
        for s in fs.listStatus(self._at()):
            name = s.getPath().getName()
            if name.startswith("version-") and (now is None or name != now.folder):
                gone += bool(fs.delete(s.getPath(), True))
        return gone


def score_into(store: VersionedTable, work: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame], parts: dict[str, DataFrame] | None = None) -> int:
    """Score what the store lacks, part by part (by default in one), and merge each part as it is done. How many parts.

    A run that is started again takes up after the last part merged; rows whose keys are in the store are not scored.
    """
    done = 0
    for name, rows in (parts or {"all": work}).items():
        now = store.entry()
        if now is not None and name in now.parts and parts:
            continue
        known = store.read()
        due = rows if known is None else rows.join(known.select(*keys).distinct(), keys, "left_anti")
        done += store.merge(score(due), keys, name if parts else None)
    return done
