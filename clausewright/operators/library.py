"""The library of past analyses: change logs in Parquet keyed by id, found by name or content hash."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"


def content_hash(content: Column) -> Column:
    """Hex SHA-256 of the bytes; null for null."""
    return F.sha2(content, 256)


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the greatest `order` of each key, the others dropped; all columns of a row stay together."""
    columns = [c for c in rows.columns if c not in key]
    ranked = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(F.col(order), F.xxhash64(*[c for c in columns if not dict(rows.dtypes)[c].startswith("map")]))).alias("row"))
    return ranked.select(*key, "row.*").select(*rows.columns)


def listed(entries: DataFrame) -> DataFrame:
    """The entries, newest first; those without id or time are left out as broken."""
    return entries.where(F.col("id").isNotNull() & F.col("analyzed_at_epoch_millis").isNotNull()).orderBy(F.desc("analyzed_at_epoch_millis"), "id")


def search(entries: DataFrame, words: str | None) -> DataFrame:
    """Entries whose display name holds the words, letter case aside; blank words find all."""
    words = (words or "").strip().lower()
    return entries if not words else entries.where(F.contains(F.lower("display_name"), F.lit(words)))


def found_of(entries: DataFrame, words: str | None) -> DataFrame:
    """(found, total, line): one row with how many entries a search finds, of how many."""
    total, hits = entries.agg(F.count("*").alias("total")), search(entries, words).agg(F.count("*").alias("found"))
    return hits.join(F.broadcast(total)).select("found", "total", F.concat(F.col("found").cast("string"), F.lit(" of "), F.col("total").cast("string")).alias("line"))


def newest_by_hash(entries: DataFrame) -> DataFrame:
    """(content_hash, id, analyzed_at_epoch_millis): the most recent entry of each hash; null and blank hashes find none."""
    known = entries.where(F.trim(F.coalesce("content_hash", F.lit(""))) != "")
    return known.groupBy("content_hash").agg(F.max(F.struct("analyzed_at_epoch_millis", "id")).alias("e")).select("content_hash", F.col("e.id").alias("id"), F.col("e.analyzed_at_epoch_millis").alias("analyzed_at_epoch_millis"))


def unseen(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files (with content_hash) that no entry of the library has; files without a hash stay."""
    known = entries.where(F.col("content_hash").isNotNull()).select("content_hash").distinct()
    return files.join(known, "content_hash", "left_anti")


#: What a library holds: entries, analyses as JSON, and copies of the sources.
TABLES = ("entries", "results", "sources")


class Library:
    """Tables under a folder, each a log of changes: a write adds a part of its own and touches no other, so writers
    don't wait for or overwrite each other, and a write that broke off is not seen. Reading takes the newest row of each
    id; `compact` writes the rows of a moment as one part."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _parts(self, name: str) -> list[str]:
        """The complete parts of a table, oldest first."""
        root, files = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if not files.exists(root):
            return []
        found = (status.getPath() for status in files.listStatus(root))
        return sorted(p.getName() for p in found if re.fullmatch(rf"{name}-\d{{20}}-[0-9a-f]{{32}}", p.getName()) and files.exists(path(p, "_SUCCESS")))

    def _log(self, name: str) -> DataFrame | None:
        parts = self._parts(name)
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.folder}/{part}" for part in parts)) if parts else None

    def read(self, name: str = "entries") -> DataFrame | None:
        """The rows of a table, the newest of each id; null if nothing was ever written."""
        log = self._log(name)
        return None if log is None else latest(log, ["id"], "_at").where("not _gone").drop("_at", "_gone")

    def _append(self, rows: DataFrame, name: str, gone: bool = False) -> str:
        at = time.time_ns()
        part = f"{name}-{at:020d}-{uuid.uuid4().hex}"
        rows.withColumns({"_at": F.lit(at), "_gone": F.lit(gone)}).write.parquet(f"{self.folder}/{part}")
        return part

    def save(self, rows: DataFrame, name: str = "entries") -> None:
        """Adds rows; a row with a known id replaces it."""
        self._append(rows, name)

    def _known(self, id_: str) -> DataFrame | None:
        row = self.load(id_)
        return None if row is None or row.isEmpty() else row

    def touch(self, id_: str, millis: int) -> bool:
        """Sets the time of an entry; false for an unknown or impossible id."""
        row = self._known(id_)
        if row is None:
            return False
        self._append(row.withColumn("analyzed_at_epoch_millis", F.lit(millis).cast(row.schema["analyzed_at_epoch_millis"].dataType)), "entries")
        return True

    def delete(self, id_: str) -> bool:
        """Removes an entry with its result and source; false for an unknown or impossible id."""
        if self._known(id_) is None:
            return False
        for name in TABLES:
            if (row := self.load(id_, name)) is not None and not row.isEmpty():
                self._append(row, name, gone=True)
        return True

    def load(self, id_: str, name: str = "entries") -> DataFrame | None:
        """The row of an id; null for an impossible one (with path parts, say) or an empty table."""
        log = self._log(name) if re.fullmatch(_ID, id_) else None
        return None if log is None else latest(log.where(F.col("id") == id_), ["id"], "_at").where("not _gone").drop("_at", "_gone")

    def resubmit(self, hash_: str, millis: int) -> str | None:
        """The id of the newest entry with the hash, its time set; null if there is none."""
        old = self.read()
        found = newest_by_hash(old.where(F.col("content_hash") == hash_)).select("id").head() if old is not None and hash_ else None
        if found:
            self.touch(found[0], millis)
        return found[0] if found else None

    def compact(self, name: str = "entries") -> None:
        """Writes the present rows as one part and removes the parts they came from; what is written meanwhile stays."""
        old = self._parts(name)
        if len(old) < 2:
            return
        log = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.folder}/{part}" for part in old))
        part = f"{name}-{old[-1].split('-')[1]}-{uuid.uuid4().hex}"
        latest(log, ["id"], "_at").where("not _gone").write.parquet(f"{self.folder}/{part}")
        root, files = self._files()
        for gone in old:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, gone), True)
