"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test texts.

The texts of a benchmark (questions and answers) are normalised to words and cut into windows
of consecutive words. One automaton holds all windows as sequences of word numbers; each
document is normalised the same way and its words run through the automaton once, which finds
every occurrence of every window, overlapping ones too. Word positions of the hits map back
to characters of the original text.

The automaton is broadcast, so its size is checked: the stored windows are counted first. Up
to ``MAX_WINDOWS`` make one automaton. A larger benchmark is cut into blocks of that many by
rank, each with its own automaton; every text then meets one block after the other, and the
hits are merged in the task. Nothing of the documents is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import materialize, ranked

WINDOW = 10
MAX_WINDOWS = 200_000  # (window, item) pairs of one automaton: about 250 MB in a worker if all differ
GATHERED = 64 << 20  # bytes of text that a task holds while the blocks of a large benchmark pass
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # words of a text as written
# the same on bytes: A-Z to lower case, all other ASCII but letters and digits to spaces
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

HITS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The windows of a test text; one of fewer words, but not none, is a window."""
    words = normal_words(text)
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def benchmark_windows(benchmark: DataFrame, size: int, item: str, columns: tuple[str, ...]) -> DataFrame:
    """Distinct (window, item) of all texts of the benchmark, stored; a null item is the empty text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("item").to_pylist()
            found = [(w.decode(), i) for c in columns for i, t in zip(items, batch.column(c)) for w in windows(t.as_py() or "", size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.string()), pa.array([i for _, i in found], pa.string())], names=["window", "item"]
            )

    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), *columns)
    return materialize(rows.mapInArrow(cut, "window string, item string").distinct(), "benchmark-windows")


class Matcher:
    """The automaton of some windows over word numbers (0: a word of none of them)."""

    def __init__(self, rows: list[tuple[str, str]]):
        """``rows``: (window, item), sorted."""
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.held: list[tuple[int, tuple[str, ...]]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for window, group in groupby(rows, key=lambda r: r[0]):
            sequence = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.encode().split())
            self.automaton.add_word(sequence, len(self.held))
            self.held.append((len(sequence), tuple(i for _, i in group)))
        if self.held:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes], hit: bytearray, items: set[str]) -> None:
        """Mark the words inside any occurrence of a window, and add the windows' items."""
        if not self.held or not words:
            return
        number, seen = self.numbers.get, set()
        for end, window in self.automaton.iter(tuple([number(w, 0) for w in words])):
            size, names = self.held[window]
            start = end - size + 1
            hit[start : end + 1] = b"\1" * size
            if window not in seen:
                seen.add(window)
                items.update(names)


def _sorted_rows(frame: DataFrame) -> list[tuple[str, str]]:
    return sorted((r["window"], r["item"]) for r in frame.select("window", "item").collect())


def broadcast_blocks(stored: DataFrame, most: int) -> list:
    """The stored windows as broadcast variables of at most ``most`` rows; the driver holds one block at a time."""
    n = stored.count()
    context = stored.sparkSession.sparkContext
    if n <= most:
        return [context.broadcast(_sorted_rows(stored))]
    placed = materialize(ranked(stored, ["window", "item"], "benchmark-order"), "benchmark-ranks")
    return [
        context.broadcast(_sorted_rows(placed.filter((F.col("_rank") >= at) & (F.col("_rank") < at + most))))
        for at in range(0, n, most)
    ]


_LAST: list = [None, None]  # of a worker process: the last block and its automaton


def _matcher(block) -> Matcher:
    if _LAST[0] is not block:
        _LAST[:] = [None, None]
        _LAST[:] = [block, Matcher(block.value)]
        vars(block).pop("_value", None)  # the automaton holds the rows now
    return _LAST[1]


def spans_of(text: str, hit: bytearray) -> list[dict[str, int]]:
    """Character ranges of the text, from the first to the last word of each run of hit words."""
    found, before = [], -2
    places = WORD.finditer(text)
    for i, place in enumerate(places):
        if hit[i]:
            if before == i - 1:
                found[-1]["end"] = place.end()
            else:
                found.append({"start": place.start(), "end": place.end()})
            before = i
    return found


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", columns: tuple[str, ...] = ("text",),
    most: int = MAX_WINDOWS,
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside a window), items (sorted, of all windows found), spans.

    Null texts have no words, on both sides. Words are letters and digits of ASCII and all
    characters beyond it, A-Z lower-cased. A test text of fewer words than a window is one
    window. Items that share an id are one item, a missing id is the empty text; repeated
    rows of documents come out each, rows without doc_id too. Texts are read whole. An empty
    benchmark hits nothing, empty documents give no rows, other columns are ignored.
    """
    blocks = broadcast_blocks(benchmark_windows(benchmark, window, item, columns), most)

    def scan(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[list[tuple[bytearray, set[str]]]] = [[] for _ in group]
        for k, block in enumerate(blocks):
            matcher = _matcher(block)
            for batch, rows in zip(group, state):
                for i, text in enumerate(batch.column("text")):
                    words = normal_words(text.as_py() or "")
                    if k == 0:
                        rows.append((bytearray(len(words)), set()))
                    matcher.scan(words, *rows[i])
        for batch, rows in zip(group, state):
            counts = [hit.count(1) for hit, _ in rows]
            spans = [spans_of(t.as_py(), hit) if n else [] for t, (hit, _), n in zip(batch.column("text"), rows, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(hit) for hit, _ in rows], pa.int64()),
                 pa.array(counts, pa.int64()), pa.array([sorted(items) for _, items in rows], pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=HITS_SCHEMA.names,
            )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.nbytes
            if len(blocks) == 1 or size > GATHERED:
                yield from scan(group)
                group, size = [], 0
        if group:
            yield from scan(group)

    return docs.select("doc_id", "text").mapInArrow(compute, HITS_SCHEMA)


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The findings with the items as a number and a digest."""
    return find_contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
