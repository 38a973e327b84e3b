"""Folding the closed epochs of a streamed table.

A stream writes each batch to ``dt=…/run=<id>/epoch=<batch>``, so a batch that is replayed
replaces its own rows. Only the newest epoch of a run can be replayed: when a batch begins,
all before it are committed. Those closed epochs are folded here, inside the stream's own
batch, so that a day does not end up with a folder for every batch:

* epochs of one size class (powers of ``FANOUT`` of their bytes) are merged when there are
  ``FANOUT`` of them, under the number of the newest, so after n batches a day holds about
  ``FANOUT`` folders for each of log n classes, and every row is rewritten log n times;
* the partial rows of the tiers are folded alongside, merged by key, into the very epochs
  that the raw table then has: the test whether partial rows cover a day stays valid.

A fold is staged as a whole under ``_folding``; then the folded epochs are deleted and the
copy is renamed into place. What a lost driver leaves behind is completed by the next batch
of the stream, whatever step it had reached, before anything is read. Other readers should
read the tiers; one that lists a raw day in that moment may miss the rows being moved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

FANOUT = 8
STAGING = "_folding"  # partition discovery ignores names with an underscore


class Files:
    """The table's file system, by path text."""

    def __init__(self, spark: SparkSession, path: str):
        self._hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._hpath(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._hpath(path))] if self.exists(path) else []

    def bytes(self, path: str) -> int:
        return self._fs.getContentSummary(self._hpath(path)).getLength()

    def delete(self, path: str) -> None:
        self._fs.delete(self._hpath(path), True)

    def touch(self, path: str) -> None:
        self._fs.mkdirs(self._hpath(path).getParent())
        self._fs.createNewFile(self._hpath(path))

    def rename(self, path: str, to: str) -> None:
        self._fs.mkdirs(self._hpath(to).getParent())
        if not self._fs.rename(self._hpath(path), self._hpath(to)):
            raise OSError(f"could not rename {path} to {to}")


def epochs(files: Files, path: str, day, run: str) -> list[int]:
    """The epochs that a run has stored for a day."""
    found = files.names(f"{path.rstrip('/')}/dt={day}/run={run}")
    return sorted(int(name.removeprefix("epoch=")) for name in found if name.startswith("epoch="))


def size_classes(sizes: dict[int, int], fanout: int = FANOUT) -> list[list[int]]:
    """Groups of epochs worth folding: ``fanout`` or more whose bytes have the same power of ``fanout``."""
    classes: dict[int, list[int]] = {}
    for epoch, size in sizes.items():
        classes.setdefault(int(math.log(max(size, 1), fanout)), []).append(epoch)
    return [sorted(group) for group in classes.values() if len(group) >= fanout]


def _replace(files: Files, path: str, day: str, run: str, group: Iterable[int], staged: str) -> None:
    """Put the staged fold in the place of the epochs it holds. Repeatable until the rename, which is last."""
    group = list(group)
    for epoch in group:
        files.delete(f"{path}/dt={day}/run={run}/epoch={epoch}")
    files.rename(staged, f"{path}/dt={day}/run={run}/epoch={max(group)}")


def recover(spark: SparkSession, path: str, run: str) -> None:
    """Complete or drop what a broken fold of this run left behind."""
    path, files = path.rstrip("/"), Files(spark, path)
    for name in files.names(f"{path}/{STAGING}"):
        day, owner, *group = name.split("~")
        if owner != run:
            continue
        staged = f"{path}/{STAGING}/{name}"
        if files.exists(f"{staged}/_SUCCESS"):
            _replace(files, path, day, run, map(int, group), staged)
        else:
            files.delete(staged)


def fold(
    spark: SparkSession, path: str, day, run: str, group: list[int], sort: tuple[str, ...] = (),
    merge: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Make one epoch of several closed ones; ``merge`` combines their rows, ``sort`` orders the files."""
    path, files = path.rstrip("/"), Files(spark, path)
    staged = f"{path}/{STAGING}/{'~'.join(map(str, (day, run, *group)))}"
    rows = spark.read.parquet(*[f"{path}/dt={day}/run={run}/epoch={e}" for e in group])
    rows = merge(rows) if merge else rows
    rows = rows.hint("rebalance")
    (rows.sortWithinPartitions(*sort) if sort else rows).write.mode("overwrite").parquet(staged)
    _replace(files, path, str(day), run, group, staged)


def fold_day(
    spark: SparkSession, path: str, day, run: str, below: int, sort: tuple[str, ...] = (),
    partials: dict[str, Callable[[DataFrame], DataFrame]] | None = None, fanout: int = FANOUT,
) -> None:
    """Fold the epochs of a day before ``below`` by size class, and the partial rows into the epochs that are left.

    ``partials`` maps the tables of partial rows to how their rows merge. Epochs that a
    table of partial rows lacks (of an older layout) are left alone.
    """
    partials = partials or {}
    files = Files(spark, path)
    closed = [e for e in epochs(files, path, day, run) if e < below]
    for other in partials:
        held = set(epochs(files, other, day, run))
        closed = [e for e in closed if e in held]
    sizes = {e: files.bytes(f"{path.rstrip('/')}/dt={day}/run={run}/epoch={e}") for e in closed}
    for group in size_classes(sizes, fanout):
        fold(spark, path, day, run, group, sort)
    kept = epochs(files, path, day, run)
    for other, merge in partials.items():
        for group in covered(kept, [e for e in epochs(files, other, day, run) if e < below]):
            fold(spark, other, day, run, group, merge=merge)


def covered(kept: list[int], have: list[int]) -> list[list[int]]:
    """Groups of ``have`` that end at the same epoch of ``kept``: those after the kept epoch before, up to it."""
    groups, last = [], -1
    for epoch in sorted(kept):
        group = [e for e in have if last < e <= epoch]
        if len(group) > 1 and epoch in have:
            groups.append(group)
        last = epoch
    return groups
