"""Line dedup on levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table of line hashes, bucketed and sorted by hash in the shared folder. A new batch of lines is merge-joined
against every run: what no run has (anti-join) becomes a run of level 0, what some run has is tallied. FAN_OUT runs of a
level are compacted into one of the next, so a batch meets few runs however many came before it. Runs of one store have
disjoint keys and equal bucketing, so joins against them move only the batch.

A line's key is the line without blanks `[\\x20\\x09-\\x0D]` at its ends and with A-Z in lower case, held as 128 bits.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import shared

LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FAN_OUT = 4, 2
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def hash_of(key: Column) -> Column:
    """128 bits, as two chained hashes from different seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """Distinct hashes of the keys of at least so many code points."""
    keys = F.filter(F.transform(lines_of(text), key_of), lambda k: F.char_length(k) >= least_chars)
    return F.array_distinct(F.transform(keys, hash_of))


class LineRuns:
    """The levelled runs: a batch's unseen keys become a run, its other keys are tallied."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fan_out: int = FAN_OUT):
        self.spark, self.folder, self.fan_out = spark, folder, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.tallies: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "a", "b").write.bucketBy(self.buckets, "a", "b").sortBy("a", "b")
            .option("path", f"{self.folder}/{name}").saveAsTable(name)
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch whose key (a, b) is in no run."""
        for run in self.runs():
            batch = batch.join(run.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> DataFrame:
        """Add (doc_id, a, b) rows, one for each document and key; returns the keys that are new, as now stored."""
        counted = self._write(batch.groupBy("a", "b").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        if any(self.levels):
            run = self._write(self.unseen(self.spark.table(counted)))
            self.tallies.append(self._write(self.spark.table(counted).join(self.spark.table(run).select("a", "b").hint("merge"), ["a", "b"], "left_anti")))
            self._drop(counted)
        else:
            run = counted
        self.levels[0].append(run)
        self._compact()
        return self.spark.table(run) if run in self.levels[0] else self.runs()[-1]

    def _compact(self) -> None:
        k = 0
        while len(self.levels[k]) >= self.fan_out:
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(self._all(self.levels[k])))
            for name in self.levels[k]:
                self._drop(name)
            self.levels[k] = []
            k += 1

    def _drop(self, name: str) -> None:
        """The catalog entry and, as the table is external, its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        shared.remove(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Drop all runs and tallies."""
        for name in [name for level in self.levels for name in level] + self.tallies:
            self._drop(name)
        self.levels, self.tallies = [[]], []

    def totals(self) -> DataFrame:
        """a, b, n_docs, last_doc over all batches."""
        parts = self._all([name for level in self.levels for name in level] + self.tallies)
        return parts.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _all(self, names: list[str]) -> DataFrame:
        """The rows of several tables in one scan of their files.

        Not as a union of the tables: Spark takes a union of equally bucketed tables as dealt by key, but its columnar form
        strings their partitions together, so that an aggregate or an exchange above it is left out where it is needed.
        """
        return self.spark.read.schema("a bigint, b bigint, n_docs bigint, last_doc bigint").parquet(*(f"{self.folder}/{name}" for name in names))


def dedup_lines(
    docs: DataFrame, folder: str, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept (the text that stays) and the ``carry`` columns.

    Keys of at least ``least_chars`` code points found in ``least_docs`` documents or more lose their lines in all
    documents but the one of the largest id. Null texts are one empty line. Rows of one doc_id count as one document
    and share one fate; rows without an id do not count, and keep all their lines. Other columns are left out, so names
    may clash; carried columns are named as ``shared.Carried`` has it. Ties cannot arise: a document holds a key or not.
    Texts of any length are split whole.
    """
    spark = docs.sparkSession
    more = shared.Carried(docs, carry, ("doc_id", "n_lines", "n_dropped", "kept"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more.columns)
    keyed = rows.select("doc_id", F.explode(line_hashes(F.col("text"), least_chars)).alias("h")).select("doc_id", "h.a", "h.b").distinct()
    at = f"{folder}/lines"
    keyed.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))).write.partitionBy("batch").parquet(at)
    lines = spark.read.schema("doc_id bigint, a bigint, b bigint, batch int").parquet(at)
    runs = LineRuns(spark, f"{folder}/runs")
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("doc_id", "a", "b"))
    common = shared.cut(runs.totals().where(F.col("n_docs") >= least_docs).select("a", "b", "last_doc", "n_docs"))
    runs.close()
    total = common.agg(F.sum("n_docs")).first()[0] or 0
    lost = shared.join_keyed(lines.select("doc_id", "a", "b"), common, ["a", "b"], "n_docs", total).where(F.col("doc_id") < F.col("last_doc"))
    lost = lost.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("lost"))
    stay = F.filter(lines_of(F.col("text")), lambda line: ~((F.char_length(key_of(line)) >= least_chars) & F.array_contains(F.col("lost"), hash_of(key_of(line)))))
    kept = F.when(F.col("lost").isNull(), lines_of(F.col("text"))).otherwise(stay)
    n = F.size(lines_of(F.col("text"))).cast("bigint")
    found = rows.join(lost, "doc_id", "left").select("doc_id", *more.inner, n.alias("n_lines"), kept.alias("kept"))
    return found.select("doc_id", *more.renamed(), "n_lines", (F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_dropped"), F.array_join("kept", "\n").alias("kept"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many of them go and the digest of what stays."""
    found = dedup_lines(shared.table(spark, sf_dir, "documents"), shared.scratch(spark, "line-dedup"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase

SQL_BODY = f"""
lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, i, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
), judged AS (
  SELECT keyed.doc_id, i, line, common.k IS NOT NULL AND keyed.doc_id < last_doc AS gone
  FROM keyed LEFT JOIN common ON keyed.k = common.k
)"""
SQL = f"""WITH {SQL_BODY}
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
