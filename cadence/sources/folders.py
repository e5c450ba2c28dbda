"""A table kept as folders of parquet files and a list of those that count.

Folders are written aside and then named in ``commits/version=<n>``, a list of one small file
that appears at once.  A reader takes the list of the largest version, so it sees the
table before or after a commit, never between; folders that no list names are left over
from a run that was cut off, and are written again under their name by its retry.
One writer at a time; folders that only older lists name stay until ``forget``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadence.plans.session import read_table

#: Batch names that a commit remembers; a retry follows its batch at once.
KEPT = 1000


class Folders:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _commits(self) -> DataFrame | None:
        return read_table(self.spark, f"{self.path}/commits")

    def version(self) -> int:
        """The newest version; -1 before the first commit."""
        commits = self._commits()
        newest = None if commits is None else commits.agg(F.max("version")).first()[0]
        return -1 if newest is None else newest

    def _listed(self, column: str, version: int | None) -> list[str]:
        version = self.version() if version is None else version
        if version < 0:
            return []
        rows = self._commits().filter((F.col("version") == version) & F.col(column).isNotNull()).orderBy("place").collect()
        return [r[column] for r in rows]

    def live(self, version: int | None = None) -> list[str]:
        """The folders of a version (default: the newest), in the order of their commit."""
        return self._listed("folder", version)

    def applied(self) -> list[str]:
        """Names of the batches that the table holds, the last ``KEPT`` of them."""
        return self._listed("batch", None)

    def write(self, rows: DataFrame, folder: str) -> None:
        """Write a folder, in place of what a cut-off run left there."""
        rows.write.mode("overwrite").parquet(f"{self.path}/data/{folder}")

    def commit(self, folders: list[str], applied: list[str] | None = None) -> int:
        """Make ``folders`` the table; returns the new version.  ``applied`` names the batches in
        them (default: as before)."""
        applied = self.applied() if applied is None else applied
        named = [(i, f, None) for i, f in enumerate(folders)] + [(i, None, b) for i, b in enumerate(applied[-KEPT:])]
        version = self.version() + 1
        (self.spark.createDataFrame(named or [(0, None, None)], "place int, folder string, batch string").coalesce(1)
             .write.mode("overwrite").parquet(f"{self.path}/commits/version={version}"))
        return version

    def add(self, rows: DataFrame, batch: str) -> None:
        """Write and commit one batch's folder; nothing if the batch is in the table already (a
        retry), whether its folder still stands alone or was merged."""
        applied = self.applied()
        if batch not in applied:
            self.write(rows, f"batch-{batch}")
            self.commit([*self.live(), f"batch-{batch}"], [*applied, batch])

    def merge(self, rows: DataFrame) -> None:
        """Put ``rows``, which say the same as all live folders, in their place."""
        whole = f"merged-{self.version() + 1}"
        self.write(rows, whole)
        self.commit([whole])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the newest)."""
        folders = self.live(version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])
