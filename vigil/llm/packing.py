"""Mixture-controlled packing: deficit round-robin over source queues.

The tokens of a source form a queue, each source has its own. The stream is served in
windows; in every window each queue earns its target share of the window's tokens and is
served what it has earned, in whole grains. What it has earned but was not served stays as
its deficit and carries over to the next window, across partitions of the input and of the
output alike, so every prefix of the stream holds every source in proportion to the targets,
to within a grain, as long as none has run dry. A queue that runs dry is served its rest in
its last window; from the next window on the others share by their targets, so no text is
left over or doubled. Sources without a target come when all others are dry. By default the
targets are the corpus shares, hence all queues end in the same window.

The state of a queue after any number of windows follows from the totals alone: between two
queues running dry (a phase) what a queue has earned is linear in the windows
(``Schedule``). So windows need not be run one after the other: each document finds its own
windows, its pieces and their places in the sequences. The totals, one number for each
source, are the only thing that meets in one place; ``MAX_SOURCES`` bounds them.

Sequences take ``length`` tokens of the stream each and are full; the rest of the stream
fills sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigil.llm import bpe
from vigil.llm.common import materialize

LENGTH = 1024
WINDOW = 64 * LENGTH  # tokens of a window, to within a grain for each queue
GRAIN = 256  # tokens served at once
MAX_SOURCES = 1_000_000  # each with a name and a total in every task; a table with more needs a coarser column
END = 0  # the id that ends a document


class Phase:
    """Windows from ``first`` on in which the same queues earn: ``num[q] / den`` tokens of queue q in each."""

    def __init__(self, first: int, base: list[int], credit: list[int], num: list[int], den: int):
        self.first, self.base, self.credit, self.num, self.den = first, base, credit, num, den


class Schedule:
    """How many tokens of each queue the first windows serve: deficit round-robin in closed form."""

    def __init__(self, totals: list[int], window: int = WINDOW, grain: int = GRAIN, weights: list[int] | None = None):
        """``weights``: target shares as whole numbers, 0 for queues without one; None for the corpus shares."""
        self.totals, self.grain, self.tokens = totals, grain, sum(totals)
        self.phases: list[Phase] = []
        if weights is None:
            # every queue earns its total in the same number of windows
            self.windows = max(1, self.tokens // window)
            self.phases.append(Phase(0, [0] * len(totals), [0] * len(totals), list(totals), self.windows))
        else:
            self.windows = self._run_dry(window, weights)
        self.firsts = [p.first for p in self.phases]
        self.arrays: dict[int, tuple] = {}

    def _run_dry(self, window: int, weights: list[int]) -> int:
        """Lay out the phases, each of which ends with the first window that some queue runs dry in; returns all windows."""
        at, base, credit = 0, [0] * len(self.totals), [0] * len(self.totals)
        while any(b < t for b, t in zip(base, self.totals)):
            live = [w if b < t else 0 for w, b, t in zip(weights, base, self.totals)]
            if not any(live):  # only sources without a target are left: by their shares
                live = [t - b for b, t in zip(base, self.totals)]
            phase = Phase(at, base, credit, [window * w for w in live], sum(live))
            self.phases.append(phase)
            ends = [self._windows_for(phase, q, t - base[q]) for q, t in enumerate(self.totals) if phase.num[q]]
            at += min(ends)
            base = [self._served_in(phase, q, at - phase.first) for q in range(len(self.totals))]
            credit = [
                0 if b >= t else phase.credit[q] + (at - phase.first) * phase.num[q] // phase.den - (b - phase.base[q])
                for q, (b, t) in enumerate(zip(base, self.totals))
            ]
        return max(1, at)

    @staticmethod
    def _windows_for(phase: Phase, q: int, tokens: int) -> int:
        """Windows of the phase until the queue has earned so many tokens; one at least."""
        return max(1, -(-(tokens - phase.credit[q]) * phase.den // phase.num[q]))

    def _served_in(self, phase: Phase, q: int, windows: int) -> int:
        """Tokens of the queue served before the end of the phase's first windows, all phases before included."""
        if not windows or not phase.num[q]:
            return phase.base[q]
        earned, rest = phase.credit[q] + windows * phase.num[q] // phase.den, self.totals[q] - phase.base[q]
        return phase.base[q] + (rest if earned >= rest else self.grain * (earned // self.grain))

    def served(self, k: int, q: int) -> int:
        """Tokens of the queue served in the first ``k`` windows."""
        if k >= self.windows:
            return self.totals[q]
        phase = self.phases[bisect_right(self.firsts, k) - 1]
        return self._served_in(phase, q, k - phase.first)

    def window_of(self, q: int, position: int) -> int:
        """The window that serves the queue's token at ``position``."""
        phase = self.phases[bisect_right(self.phases, position, key=lambda p: p.base[q]) - 1]
        through = min(self.grain * ((position - phase.base[q]) // self.grain + 1), self.totals[q] - phase.base[q])
        return phase.first + self._windows_for(phase, q, through) - 1

    def all_served(self, k: int) -> np.ndarray:
        """:meth:`served` of every queue."""
        totals = np.array(self.totals, dtype=np.int64)
        if k >= self.windows:
            return totals
        at = bisect_right(self.firsts, k) - 1
        if at not in self.arrays:
            p = self.phases[at]
            parts = [divmod(n, p.den) for n in p.num]  # whole tokens and the rest, so products stay within 64 bits
            self.arrays = {at: tuple(np.array(x, dtype=np.int64) for x in (
                p.base, p.credit, [x for x, _ in parts], [y for _, y in parts], [n > 0 for n in p.num]))}
        base, credit, whole, rest, live = self.arrays[at]
        windows = k - self.phases[at].first
        if not windows:
            return base
        earned = credit + windows * whole + windows * rest // self.phases[at].den
        left = totals - base
        return base + np.where(live == 0, 0, np.where(earned >= left, left, earned // self.grain * self.grain))


class Layout:
    """Where each token of each queue stands in the stream of sequences."""

    def __init__(self, totals: list[int], length: int = LENGTH, window: int = WINDOW, grain: int = GRAIN,
                 weights: list[int] | None = None):
        self.totals, self.length = totals, length
        self.schedule = Schedule(totals, window, grain, weights)
        self.tokens = sum(totals)
        full, rest = divmod(self.tokens, length)
        self.full = full
        # the tail in falling powers of two
        self.tail = [full * length]
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.tail.append(self.tail[-1] + (1 << bit))
        self.known: dict[int, list[int]] = {}

    def starts(self, k: int) -> list[int]:
        """Stream positions where the queues' parts of window ``k`` begin."""
        if k not in self.known:
            if len(self.known) * len(self.totals) > 5_000_000:
                self.known.clear()
            before = self.schedule.all_served(k)
            sizes = self.schedule.all_served(k + 1) - before
            self.known[k] = (int(before.sum()) + np.cumsum(sizes) - sizes).tolist()
        return self.known[k]

    def sequence(self, at: int) -> tuple[int, int, int]:
        """(sequence, offset there, tokens from there to its end) of a stream position."""
        if at < self.full * self.length:
            s, offset = divmod(at, self.length)
            return s, offset, self.length - offset
        i = bisect_right(self.tail, at) - 1
        return self.full + i, at - self.tail[i], self.tail[i + 1] - at

    def pieces(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) for the queue's tokens [start, start + n)."""
        at = start
        while at < start + n:
            k = self.schedule.window_of(queue, at)
            begin, end = self.schedule.served(k, queue), self.schedule.served(k + 1, queue)
            place = self.starts(k)[queue] + at - begin
            until = min(start + n, end)
            while at < until:
                sequence, offset, room = self.sequence(place)
                size = min(room, until - at)
                yield at - start, size, sequence, offset
                at += size
                place += size


TOKENS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("queue", T.StringType()),
    T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
])

PIECES_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("queue", T.StringType()),
])


def queue_name(source: str) -> Column:
    """The queue of a row: its source; a null source is one of its own."""
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def target_weights(names: list[str], targets: dict[str | None, float] | None) -> list[int] | None:
    """Whole-number weights of the queues; shares are kept to a millionth of the largest."""
    if targets is None:
        return None
    if any(not t >= 0 for t in targets.values()) or not any(targets.values()):
        raise ValueError("target shares must not be negative, and one must be above zero")
    by_queue = {"" if name is None else f"s{name}": share for name, share in targets.items()}
    top = max(by_queue.values())
    return [max(1, round(1_000_000 * by_queue[q] / top)) if by_queue.get(q) else 0 for q in names]


def tokenized(docs: DataFrame, path: str, pattern: str | None, source: str) -> DataFrame:
    """The ids of every text with the end id, stored once; ``before`` counts its partition's ids of the queue so far."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path, pattern)
        narrow = len(model.token_bytes) <= 1 << 16
        kind = "<u2" if narrow else "<u4"
        code = "H" if narrow else "I"
        entries = bpe.cache(model, kind, lambda ids: struct.pack(f"<{len(ids)}{code}", *ids), bytes.__add__)
        width, end = (2 if narrow else 4), np.asarray([END], dtype=kind).tobytes()
        part = TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in batches:
            queues = batch.column("queue").to_pylist()
            ids, counts, before = [], [], []
            for queue, text in zip(queues, batch.column("text")):
                row = b"".join(entries.of(text.as_py() or "")) + end
                ids.append(row)
                counts.append(len(row) // width)
                before.append(seen.get(queue, 0))
                seen[queue] = before[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(queues, pa.string()),
                 pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=TOKENS_SCHEMA.names,
            )

    rows = docs.select("doc_id", "text", queue_name(source).alias("queue"))
    return materialize(rows.mapInArrow(encode, TOKENS_SCHEMA), "tokens")


def pack_documents(
    docs: DataFrame, path: str, pattern: str | None = None, length: int = LENGTH, window: int = WINDOW,
    grain: int = GRAIN, source: str = "source", targets: dict[str | None, float] | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    A document is its text's ids (null: empty text) and the end id, so an empty text is one
    token and every row of ``docs``, repeated ones too, is packed. Offsets in a sequence run
    from 0 without gaps. An empty table gives no pieces; a null source is a queue of its own;
    other columns are ignored. ``targets`` are the token shares wanted of the sources (any
    positive numbers; default: their shares of the corpus). ``with_ids`` adds the ids of the
    piece.
    """
    rows = tokenized(docs, path, pattern, source)
    sums = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each queue and input partition
    bases = sums.select("queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"{len(totals)} sources; name a column with at most {MAX_SOURCES} values")
    names = sorted(totals)
    number = {q: i for i, q in enumerate(names)}
    counts = [totals[q] for q in names]
    weights = target_weights(names, targets)
    schema = T.StructType([*PIECES_SCHEMA.fields, T.StructField("ids", T.BinaryType())]) if with_ids else PIECES_SCHEMA

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(counts, length, window, grain, weights)
        for batch in batches:
            out: list[list] = [[] for _ in schema.fields]
            for doc_id, queue, first, n, ids in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "queue", "first", "n", "ids"))
            ):
                wide = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                for start, size, sequence, offset in layout.pieces(number[queue], first, n):
                    piece = wide[start : start + size].tobytes()
                    row = (doc_id, start, size, zlib.crc32(piece), n, sequence, offset, queue, piece)
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if f.name == "ids" else pa.string() if f.name == "queue" else pa.int64())
                 for c, f in zip(out, schema.fields)],
                names=schema.names,
            )

    placed = rows.join(bases, ["queue", "part"]).select(
        "doc_id", "queue", (F.col("base") + F.col("before")).alias("first"), "n", "ids"
    )
    return placed.mapInArrow(place, schema)
