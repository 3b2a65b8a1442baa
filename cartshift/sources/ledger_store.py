"""The ledger as a snapshot and a tail, so that reading it does not grow with its history.

Every append writes a folder of rows and then one commit row; rows without a commit do not count. Compaction writes the newest
value of every key into a folder of its own and commits it with the names of the folders that it replaces.
Readers take the committed folders that no other commit replaces: the snapshot and what was appended since.

So a compaction that dies leaves a folder that nobody reads, appends that are made meanwhile stay in the tail, and two
compactions at once leave two snapshots with the same values. Rows are never changed where they stand. Commits are files of
their own name, so writers do not meet.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartshift.operators.ledger import LEDGER_SCHEMA, latest
from cartshift.sources.writers import LEDGER_FOLDERS

COMMIT = "folder string, replaces array<string>"


@dataclass(frozen=True)
class LedgerStore:
    """A ledger under ``path``, a place that all executors share."""

    spark: SparkSession
    path: str

    def commits(self) -> DataFrame:
        """``folder`` and ``replaces`` of every commit."""
        try:
            return self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").json(f"{self.path}/commits")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], COMMIT)

    def folders(self) -> list[str]:
        """The folders that count: the last snapshot and the appends since, a name each."""
        commits = self.commits()
        replaced = commits.select(F.explode("replaces").alias("folder"))
        left = commits.select("folder").join(replaced, "folder", "left_anti")
        return sorted(r["folder"] for r in left.collect())

    def read(self) -> DataFrame:
        """All rows that count; a lookup by entity and field reads its own folders only."""
        return self._rows(self.folders())

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        base = f"{self.path}/rows"
        reader = self.spark.read.schema(f"{LEDGER_SCHEMA}, batch string").option("basePath", base)
        return reader.parquet(*[f"{base}/batch={f}" for f in folders]).drop("batch")

    def append(self, entries: DataFrame) -> str:
        """Add rows; returns the name of their folder."""
        return self._put(entries, [])

    def compact(self) -> str:
        """Replace what is there now by the newest value of every key."""
        folders = self.folders()
        return self._put(latest(self._rows(folders)), folders)

    def _put(self, rows: DataFrame, replaces: list[str]) -> str:
        folder = self._write(rows)
        self._commit(folder, replaces)
        return folder

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.partitionBy(*LEDGER_FOLDERS).parquet(f"{self.path}/rows/batch={folder}")
        return folder

    def _commit(self, folder: str, replaces: list[str]) -> None:
        row = self.spark.createDataFrame([(folder, replaces)], COMMIT)
        row.coalesce(1).write.json(f"{self.path}/commits/{folder}")
