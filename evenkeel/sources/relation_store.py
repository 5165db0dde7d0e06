"""Published relations as snapshots by ref: a batch replaces or extends whole refs, readers see all of it or nothing.

A version writes the rows of the refs it touches to ``rows/version=N`` and then, as its
commit, the list of these refs to ``commits/version=N``.  A ref is read from the latest version that lists
it, so a version that failed halfway shows nothing, and a ref that is listed without rows has
been cleared.  Stream batch b is version 2b; the odd numbers are compactions.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..stages import publish


class RelationStore:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        """``schema`` is that of the rows, ``ref`` included."""
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], schema).schema

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        folder, system = self._folder(path)
        return system.exists(folder)

    def _versions(self, kind: str) -> list[int]:
        folder, system = self._folder(kind)
        if not system.exists(folder):
            return []
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))

    def committed(self) -> list[int]:
        """Versions whose commit is complete."""
        return [n for n in self._versions("commits") if self._exists(f"commits/version={n}/_SUCCESS")]

    def _table(self, kind: str, schema, versions: list[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/version={n}" for n in versions]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("version", F.lit(0).cast("long"))
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)
        return rows.withColumn("version", F.regexp_extract(F.input_file_name(), r"/version=(\d+)/", 1).cast("long"))

    def current(self) -> DataFrame:
        """(ref, version): where each ref stands."""
        return self._table("commits", "ref string", self.committed()).groupBy("ref").agg(F.max("version").alias("version"))

    def read(self, refs: DataFrame | None = None) -> DataFrame:
        """All rows, or those of some refs; versions that hold none of them are not opened."""
        current = publish(self.current() if refs is None else self.current().join(refs.select("ref").distinct(), "ref", "left_semi"), "store-current")
        wanted = [r["version"] for r in current.select("version").distinct().collect()]  # one a version
        wanted = [n for n in sorted(wanted) if self._exists(f"rows/version={n}")]
        return self._table("rows", self.schema, wanted).join(current, ["ref", "version"], "left_semi").select(*self.schema.names)

    def _commit(self, version: int, rows: DataFrame, refs: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/rows/version={version}")
        refs.select("ref").distinct().write.mode("overwrite").parquet(f"{self.path}/commits/version={version}")

    def put(self, batch_id: int, rows: DataFrame, refs: DataFrame | None = None, extend: bool = False) -> None:
        """Replace the refs that the rows have, and those of ``refs``; with ``extend``, add the rows to theirs.

        A batch that has been committed is not written again.
        """
        version = 2 * batch_id
        if version in self.committed():
            return
        rows = publish(rows.select(*self.schema.names), "store-rows")
        touched = rows.select("ref") if refs is None else rows.select("ref").unionByName(refs.select("ref"))
        touched = publish(touched.distinct(), "store-refs")
        if extend:
            rows = rows.unionByName(self.read(touched))
        self._commit(version, rows, touched)

    def writer(self, build: Callable[[DataFrame], DataFrame], extend: bool = False) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function; only the refs of a batch are read or written."""
        return lambda batch, batch_id: self.put(batch_id, build(batch), extend=extend)

    def compact(self) -> int | None:
        """Put the present rows of all refs into one version and drop the versions before it; returns the version.

        Readers that began before keep their list of files: run it when there are none.
        """
        done = self.committed()
        if not done or done[-1] % 2:
            return None
        version = done[-1] + 1
        current = publish(self.current(), "store-refs")
        self._commit(version, self.read(), current)
        for kind in ("rows", "commits"):
            for old in self._versions(kind):
                if old < version:
                    folder, system = self._folder(f"{kind}/version={old}")
                    system.delete(folder, True)
        return version
