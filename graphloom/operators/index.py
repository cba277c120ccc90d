"""A vector index that is kept: versions of a table in a folder, with lookup, removal, upsert and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .hybrid import upsert


class VectorIndex:
    """Rows of vec_id, embedding and any metadata, stored under a folder that all machines share.

    Each change writes a whole new version and then removes the former one, so that a reader or a lost task never meets
    half a table. The newest whole version counts.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        root = self._path(self.folder)
        names = [s.getPath().getName() for s in self._store.listStatus(root)] if self._store.exists(root) else []
        found = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdecimal()]
        return sorted(n for n in found if self._store.exists(self._path(f"{self.folder}/v{n}/_SUCCESS")))

    def save(self, table: DataFrame) -> None:
        """Replace the index."""
        before = self._versions()
        table.write.mode("overwrite").parquet(f"{self.folder}/v{before[-1] + 1 if before else 0}")
        for n in before:
            self._store.delete(self._path(f"{self.folder}/v{n}"), True)

    def load(self) -> DataFrame | None:
        """The table, or None if there is none."""
        versions = self._versions()
        return self.spark.read.parquet(f"{self.folder}/v{versions[-1]}") if versions else None

    def clear(self) -> None:
        self._store.delete(self._path(self.folder), True)

    def _table(self) -> DataFrame:
        table = self.load()
        if table is None:
            raise LookupError(f"no index in {self.folder}")
        return table

    def vector(self, vec_id: int) -> list[float] | None:
        return vectors.vector_of(self._table(), vec_id)

    def metadata(self, vec_id: int) -> dict | None:
        """What is stored with a vector."""
        row = self._table().filter(F.col("vec_id") == vec_id).drop("embedding", "vec_id").first()
        return None if row is None else row.asDict(recursive=True)

    def remove(self, ids: DataFrame) -> None:
        """Drop the rows whose vec_id is among ids."""
        self.save(self._table().join(ids.select("vec_id"), "vec_id", "left_anti"))

    def upsert(self, rows: DataFrame, version: str | None = None) -> None:
        """Put rows in place of those of the same vec_id; of rows that share one, that with the largest version."""
        old = self.load()
        self.save(upsert(rows.limit(0) if old is None else old, rows, ["vec_id"], version))

    def search(self, query: list[float], k: int = 10, **options) -> DataFrame:
        return vectors.top_k(self._table(), query, k, **options)
