"""Small helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.session import run_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut lineage that outlives any executor."""
    path = run_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text is the empty text."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker process stays, and the next task may be another
    operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def filter_rows(
    docs: DataFrame, text_col: str, make_keep: Callable[[], Callable[[list[str]], list[bool]]], free: Callable[[], None] = lambda: None
) -> DataFrame:
    """The rows, with all their columns, whose text a function keeps; ``make_keep`` makes it once per task, ``free`` drops
    what it holds at the task's end."""
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make_keep()
        for batch in batches:
            for some in slices(batch, at):
                yield some.filter(pa.array(keep([t or "" for t in some.column(at).to_pylist()]), pa.bool_()))
        del keep
        free()
        give_back()

    return docs.mapInArrow(kept, docs.schema)


def slices(batch: pa.RecordBatch, text_at: int = 1, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``chars`` bytes of text, so that buffers stay bounded; no row is left out."""
    column = batch.column(text_at)
    start = size = 0
    for i in range(batch.num_rows):
        size += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
        if size >= chars:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
