"""Labels in a store of their own: Parquet files bucketed by key, with a commit order that outlives any copy of the files."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.labels import LABEL_COLUMNS, LABEL_SCHEMA, last_wins, unlabeled
from loomline.sources.scratch import delete, exists, file_system, names


class LabelStore:
    """Folders v1, v2 ... of which the last counts; a file belongs to one of `buckets` buckets by the hash of its keys.

    Each append takes the next commit number, which a file in _commits notes, and each record carries it: the last record of a key is that of the highest commit, wherever and in whatever order files were copied. As the
    files are bucketed, a join by key shuffles the other side alone. compact() writes the last records to a new version,
    which counts once it is whole.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _version(self) -> int:
        return max((int(n[1:]) for n in names(self.spark, self.path) if n[:1] == "v" and n[1:].isdigit()), default=0)

    def _table(self, folder: str) -> str:
        """A name for a folder's files in the session's catalog, which knows how they are bucketed."""
        name = "loomline_labels_" + hashlib.md5(folder.encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            where = folder.replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({LABEL_SCHEMA.replace(':', ' ')}, commit BIGINT) USING parquet CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return name

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{max(version, 1)}"

    def _records(self) -> DataFrame:
        name = self._table(self._folder(self._version()))
        self.spark.catalog.refreshTable(name)  # files that others have added since
        return self.spark.table(name)

    def read(self) -> DataFrame:
        """One record a key, the last; none if nothing was stored yet."""
        if not self._version():
            return self.spark.createDataFrame([], LABEL_SCHEMA)
        return last_wins(self._records(), "commit").select(*LABEL_COLUMNS)

    def _commit(self) -> int:
        """A number above all that were taken. Its last 20 bits are random: jobs that take one at the same moment are ordered by chance, but alike for every reader."""
        last = max((int(x) for x in names(self.spark, f"{self.path}/_commits") if x.isdigit()), default=0)
        n = ((last >> 20) + 1 << 20) + secrets.randbits(20)
        fs, path = file_system(self.spark, f"{self.path}/_commits/{n}")
        return n if fs.createNewFile(path) else self._commit()

    def append(self, labels: DataFrame) -> None:
        """Adds records, also of keys that are there: the new ones then count. labels: one record a key."""
        folder, n = self._folder(self._version()), self._commit()
        rows = labels.select(*LABEL_COLUMNS, F.lit(n).cast("long").alias("commit")).repartition(self.buckets, "key")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "key").saveAsTable(self._table(folder))

    def add(self, labels: DataFrame) -> None:
        """Adds those whose key isn't there, so a rerun adds nothing."""
        self.append(unlabeled(labels, self.read()))

    def compact(self) -> None:
        """The last record of each key in a new version, one file a bucket; older versions stay for those who read them, until prune()."""
        version = self._version()
        if not version:
            return
        aside = f"{self.path}/_v{version + 1}"
        delete(self.spark, aside)
        rows = last_wins(self._records(), "commit").select(*LABEL_COLUMNS, "commit")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "key").saveAsTable(self._table(aside))
        self.spark.sql(f"DROP TABLE {self._table(aside)}")
        fs, old = file_system(self.spark, aside)
        if not fs.rename(old, file_system(self.spark, f"{self.path}/v{version + 1}")[1]):
            raise OSError(f"{aside} could not be put in place")

    def prune(self) -> None:
        """Deletes all versions but the last."""
        last = self._version()
        for n in range(1, last):
            if exists(self.spark, f"{self.path}/v{n}"):
                delete(self.spark, f"{self.path}/v{n}")
