"""an index that tells which files of a stored table can hold a text, consulted before the scan.

For every file the index has the set of three-letter grams (lower case, hashed) of a text
column, stored by gram: ``<table>/_grams_<column>/dt=…``, sorted, so a search reads the row
groups of its own few grams and not a filter for each file. A file without one of a
needle's grams cannot hold the needle; a file with all of them may. Files that the index does
not know, such as those of batches written since, are always read. So there are false
positives and no misses, and an index that lags costs time only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.predicates import And, Cond, Or, Pred, where_
from vigil.sources.sinks import read_stored

GRAM = 3
NEEDLE_OPS = ("contains", "starts_with", "ends_with", "=")
# every file has this entry, so a file whose texts have no gram is known too
KNOWN = 0


def grams(text: Column) -> Column:
    """The distinct grams of a text in lower case, hashed; none for texts of fewer letters."""
    def hashed(letters: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(letters) - GRAM)
        found = F.transform(at, lambda i: F.xxhash64(*[F.get(letters, i + k) for k in range(GRAM)]))
        return F.when(F.size(letters) >= GRAM, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

    # the text is split once, as the one element of an array, and not again for each of its grams
    return F.get(F.transform(F.array(F.split(F.lower(text), "")), hashed), F.lit(0))


def gram_rows(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, gram) without repeats; grams of equal texts under a key are made once."""
    texts = rows.select(*keys, column).distinct()
    found = texts.select(*keys, F.explode(F.array_append(grams(F.coalesce(F.col(column), F.lit(""))), F.lit(KNOWN))).alias("gram"))
    return found.distinct()


def build(spark: SparkSession, path: str, kind: str, column: str = "message", days: list[str] | None = None) -> None:
    """Index the files of the given days (all, if none are given); replaces those days in the index."""
    rows = read_stored(spark, path, kind)
    if days is not None:
        rows = rows.where(F.col("dt").cast("string").isin(days))
    named = rows.select("dt", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), column)
    found = gram_rows(named, column, "dt", "file").hint("rebalance", "dt").sortWithinPartitions("dt", "gram", "file")
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(_place(path, column))


def _place(path: str, column: str) -> str:
    return f"{path.rstrip('/')}/_grams_{column}"


def needles(pred: Pred, column: str) -> list[list[str]]:
    """Alternatives (any of) of texts that a matching row must all hold; ``[[]]`` if the predicate asks for none."""
    if isinstance(pred, And):
        return [a + b for a in needles(pred.left, column) for b in needles(pred.right, column)]
    if isinstance(pred, Or):
        return needles(pred.left, column) + needles(pred.right, column)
    if isinstance(pred, Cond) and pred.field.lower() == column and pred.op in NEEDLE_OPS and isinstance(pred.value, str):
        return [[pred.value]]
    return [[]]


def wanted_grams(spark: SparkSession, alternatives: list[list[str]]) -> list[list[int]]:
    """The grams of each alternative, made by the same expression that made the index."""
    texts = [(i, t) for i, alternative in enumerate(alternatives) for t in alternative]
    found: list[set[int]] = [set() for _ in alternatives]
    if texts:
        for r in spark.createDataFrame(texts, "i int, t string").select("i", F.explode(grams(F.col("t"))).alias("g")).collect():
            found[r["i"]].add(r["g"])
    return [sorted(g) for g in found]


def holding(index: DataFrame, alternatives: list[list[int]], *keys: str) -> DataFrame:
    """The keys of an index (keys, gram) whose texts may hold all grams of some alternative."""
    asked = sorted({g for grams_ in alternatives for g in grams_})
    have = index.where(F.col("gram").isin([KNOWN, *asked])).groupBy(*keys).agg(F.collect_set("gram").alias("have"))
    able = [F.size(F.array_except(F.lit(g) if g else F.array().cast("array<bigint>"), "have")) == 0 for g in alternatives]
    return have.where(F.greatest(*able, F.lit(False))).select(*keys)


def candidate_files(spark: SparkSession, path: str, kind: str, pred: Pred, column: str = "message") -> list[str] | None:
    """The files that can hold a match; None if the predicate excludes none.

    What reaches the driver are file names, of which its own listing of the table has more.
    """
    alternatives = wanted_grams(spark, needles(pred, column))
    if not all(alternatives):
        return None
    files = read_stored(spark, path, kind).inputFiles()
    index = spark.read.schema("gram bigint, file string, dt date").parquet(_place(path, column))
    known = {(str(r["dt"]), r["file"]) for r in index.where(F.col("gram") == KNOWN).select("dt", "file").collect()}
    able = {(str(r["dt"]), r["file"]) for r in holding(index, alternatives, "dt", "file").collect()}

    def key(file: str) -> tuple[str, str]:
        day = [p for p in file.split("/") if p.startswith("dt=")]
        return (day[-1][3:] if day else "", file.rsplit("/", 1)[-1])

    return [f for f in files if key(f) in able or key(f) not in known]


def search(spark: SparkSession, path: str, kind: str, pred: Pred, column: str = "message") -> DataFrame:
    """The rows of a stored table that satisfy the predicate, read from the files that can hold some."""
    files = candidate_files(spark, path, kind, pred, column)
    table = read_stored(spark, path, kind)
    if files is not None:
        table = spark.read.schema(table.schema).option("basePath", path).parquet(*files) if files else table.limit(0)
    return where_(table, pred)
