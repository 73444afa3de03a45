"""Parquet tables with last-transmission-wins loads, error log, deletion and publication."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators.latest import last_wins


class Table:
    """A partitioned parquet table updated partition by partition.

    ``partitions`` must be columns the key determines, so a batch only rewrites the partitions it
    touches and a replaced row is always in the partition being rewritten. Folder names are text: partition columns are
    read as such (a code keeps its leading zeros) unless ``kinds`` names another type.
    """

    def __init__(self, path: str, key: list[str], order: list[str], partitions: list[str], kinds: dict[str, str] | None = None):
        self.path, self.key, self.order, self.partitions, self.kinds = path, key, order, partitions, kinds or {}

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The table, or None before its first load: its rows and the loads not merged yet, the last one of a key."""
        base = _stored(spark, self.path)
        if base is not None and (loads := self._loads(spark)) is not None:
            base = last_wins(base.unionByName(loads, allowMissingColumns=True), self.key, self.order)
        return None if base is None else base.withColumns({c: F.col(c).cast(kind) for c, kind in self.kinds.items()})

    def upsert(self, batch: DataFrame) -> None:
        """Merge a batch: same key replaces, an incomplete key is kept apart.

        A later batch is written beside the table; batches are merged into it once they are as large as the table, so
        a row is rewritten only when the table has doubled, however many batches come.
        """
        spark = batch.sparkSession
        if _stored(spark, self.path) is None:
            self._write(last_wins(batch, self.key, self.order), self.path)
            return
        load = f"{self.loads}/load={uuid.uuid4().hex}"
        self._write(last_wins(batch, self.key, self.order), load)
        if (rows := _stored(spark, load)) is not None:  # a partition without a value is replaced by each load that has it
            self._write(rows.where(~self._placed()), self.path)
        if _bytes(spark, self.loads) >= _bytes(spark, self.path):
            self.merge(spark)

    def merge(self, spark: SparkSession) -> None:
        """Rewrite the partitions that the loads beside the table touch; repeating it changes nothing."""
        loads, base = self._loads(spark), _stored(spark, self.path)
        if loads is None or base is None:
            return
        affected = base.join(loads.select(*self.partitions).distinct(), self.partitions, "left_semi")
        self._write(last_wins(affected.unionByName(loads, allowMissingColumns=True), self.key, self.order), self.path)
        folder = _path(spark, self.loads)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    def drop(self, spark: SparkSession, value: str) -> bool:
        """Remove one value of the first partition column, an establishment: its folder goes, nothing else is touched."""
        if not re.fullmatch(r"\w+", value):
            raise ValueError(f"not a partition code: {value!r}")
        part = f"{self.partitions[0]}={value}"
        gone = False
        for pattern in (f"{self.path}/{part}", f"{self.loads}/load=*/{part}"):
            files = _path(spark, pattern).getFileSystem(spark._jsc.hadoopConfiguration())
            for status in files.globStatus(_path(spark, pattern)) or []:
                gone = bool(files.delete(status.getPath(), True)) or gone
        return gone

    @property
    def loads(self) -> str:
        return f"{self.path.rstrip('/')}.loads"

    def _loads(self, spark: SparkSession) -> DataFrame | None:
        rows = _stored(spark, self.loads, merge_schema=True)
        return None if rows is None else rows.where(self._placed()).drop("load")

    def _placed(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.partitions])

    def _write(self, rows: DataFrame, path: str) -> None:
        spread = rows.withColumn("_writer", F.pmod(F.xxhash64(*self.key), F.lit(_WRITERS))).hint("rebalance", *self.partitions, "_writer")
        spread.drop("_writer").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.partitions).parquet(path)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _bytes(spark: SparkSession, path: str) -> int:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(_path(spark, path)).getLength()


def _stored(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame | None:
    """Parquet files with their folder names as text, or None where there are none."""
    inferred = spark.conf.get(_INFERENCE)
    spark.conf.set(_INFERENCE, "false")
    try:
        return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    finally:
        spark.conf.set(_INFERENCE, inferred)


_INFERENCE = "spark.sql.sources.partitionColumnTypeInference.enabled"
_WRITERS = 32  # writers per partition: a hot establishment is not one task, and Spark splits what is still too large


class ErrorLog:
    """Messages of every load, one folder per load; only those of a file's latest load are current.

    A load writes its own folder as a whole, so a load repeated after a failure takes its own place and no message is
    compared with another: two messages that read alike stay two. Reloading a file replaces its messages even when it has none left.
    """

    def __init__(self, folder: str):
        self.messages, self.loads = f"{folder}/messages", f"{folder}/loads"

    def append(self, errors: DataFrame, files: DataFrame, load_id: int) -> None:
        """``errors`` of one load and the ``files`` (source_file) it read."""
        errors.write.mode("overwrite").parquet(f"{self.messages}/load_id={load_id}")
        files.select("source_file").distinct().write.mode("overwrite").parquet(f"{self.loads}/load_id={load_id}")

    def forget(self, files: DataFrame, load_id: int) -> None:
        """Leave no current message of ``files`` (source_file): a later load of them that has none."""
        self.append(files.sparkSession.read.parquet(self.messages).drop("load_id").limit(0), files, load_id)

    def current(self, spark: SparkSession) -> DataFrame:
        latest = spark.read.parquet(self.loads).groupBy("source_file").agg(F.max("load_id").alias("load_id"))
        return spark.read.parquet(self.messages).join(latest, ["source_file", "load_id"], "left_semi").drop("load_id")


def load_summary(good: DataFrame, errors: DataFrame) -> DataFrame:
    """Loaded records and error messages per source file."""
    ok = good.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.size("errors") == 0).alias("n_ok")
    )
    bad = errors.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_messages"))
    return ok.join(bad, "source_file", "full_outer").select(
        "source_file", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_records", "n_ok", "n_messages")]
    )


def deletion_preview(tables: dict[str, DataFrame], finess: str) -> DataFrame:
    """Rows one establishment holds in each table."""
    counts = [
        df.where(F.col("finess_epmsi") == finess).agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def without_establishment(rows: DataFrame, finess: str) -> DataFrame:
    """Everything but one establishment."""
    return rows.where(~F.col("finess_epmsi").eqNullSafe(finess))


def delete_establishment(spark: SparkSession, path: str, finess: str, target: str) -> None:
    """Rewrite a table without one establishment into ``target`` (the caller swaps the paths)."""
    kept = without_establishment(spark.read.parquet(path), finess)
    kept.write.mode("errorifexists").partitionBy("finess_epmsi").parquet(target)


def export_csv(rows: DataFrame, path: str, sep: str = ";") -> None:
    """Report export; the report is already aggregated or limited."""
    rows.write.mode("overwrite").csv(path, sep=sep, header=True)


def publish(tables: dict[str, DataFrame], folder: str) -> None:
    """Read-only analytic copy, one parquet folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
