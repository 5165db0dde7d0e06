"""Sinks for published relations: whole replacement per ref, batch or stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def write_relation(relation: DataFrame, path: str, refs: DataFrame | None = None) -> None:
    """Replace the rows of every ref present in the relation, leave other refs alone.

    With ``refs`` (a ``ref`` column), refs of it without any row in the relation are cleared.
    """
    (
        relation.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ref")
        .parquet(path)
    )
    if refs is not None:
        emptied = refs.select("ref").distinct().join(relation.select("ref").distinct(), "ref", "left_anti")
        _clear(emptied, path)


def _clear(refs: DataFrame, path: str) -> None:
    """Remove the folders of some refs; one file system call for each."""
    spark = refs.sparkSession
    jvm = spark._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in refs.toLocalIterator():
        system.delete(jvm.org.apache.hadoop.fs.Path(folder, f"ref={escape(row.ref)}"), True)


def relation_writer(build: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that rebuilds a relation as micro-batches come in.

    Every batch is kept beside the relation, in ``<path>_batches``, and the refs it
    touches are rebuilt from all their rows so far.  So a ref whose rows come in
    several batches loses none, a ref that has become empty is cleared, and a replayed
    batch replaces itself.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark, log = batch.sparkSession, f"{path}_batches"
        batch.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
        kept = spark.read.schema(batch.schema).parquet(log)
        if "ref" not in batch.columns:
            write_relation(build(kept), path)
            return
        touched = spark.read.schema(batch.schema).parquet(f"{log}/batch_id={batch_id}").select("ref").distinct()
        write_relation(build(kept.join(touched, "ref", "left_semi")), path, touched)

    return write_batch
