"""Helpers shared by the corpus operators: stored intermediates, ranks, text columns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.session import checkpoint_dir

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, where they were not started with it on their path."""
    context = spark.sparkContext
    if getattr(context, "_vigil_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="vigil-"), "vigil.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._vigil_shipped = True


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = 16 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of ``batch`` with about ``size`` bytes of text each (a longer text is one by itself), and their texts.

    Null texts come as empty ones. Kernels that copy texts several times stay within a fixed
    multiple of ``size`` and of the longest text, however many rows a batch has.
    """
    texts = pc.fill_null(batch.column(column).cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, until - at), texts.slice(at, until - at)
        at = until


def whole_text(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Store ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage in a place every executor reaches: a lost executor never makes a later
    stage repeat this work, and every reader of the table sees the very same rows.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/vigil-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column | str], tag: str) -> DataFrame:
    """``df`` with ``_rank`` (0-based position in ``order``) and ``_total`` (row count).

    One range shuffle sorts the rows; a row's rank is its place in its partition plus the
    rows of the partitions before. Only the per-partition counts (one row for each shuffle
    partition) meet in one place, so no key, however frequent, lands in one task as long as
    ``order`` ends with a column that tells equal keys apart.
    """
    if "_place" in df.columns:
        raise ValueError("the column name _place is reserved")
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()),
        tag,
    )
    part = F.shiftright(F.col("_place"), 33)
    index = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total"),
    )
    # one row per shuffle partition: broadcasting it has a fixed bound
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(sizes), "_part")
        .withColumn("_rank", F.col("_before") + index)
        .drop("_part", "_before", "_place")
    )


def fold(doc_id, folds: int) -> int:
    """crc32 of the decimal doc_id modulo ``folds`` (a missing id is the empty text)."""
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % folds


def fold_column(folds: int, column: str = "doc_id") -> Column:
    """The column form of :func:`fold`."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds
