"""Where operators of this subpackage put what outlives a stage, and how they read their tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where rows are cut on one machine (tests, bench) that names no shared folder.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. FALLBACK_DIR serves a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or FALLBACK_DIR).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder and read from there: a lost executor cannot take them along.

    It takes the place of checkpoint(), which computes its last stage twice and writes rows uncompressed.
    """
    at = scratch(df.sparkSession, "cut")
    df.write.parquet(at)
    found = df.sparkSession.read.schema(df.schema).parquet(at)
    _cuts[found] = at
    return found


#: Where the rows of a cut lie.
_cuts: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def drop(*cuts: DataFrame) -> None:
    """Delete cuts that nothing reads any more, and let Spark clear shuffle files of finished jobs, which it does when the JVM collects."""
    for df in cuts:
        remove(df.sparkSession, _cuts.pop(df))
    if cuts:
        cuts[0].sparkSession.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key held by more than one in so many rows is hot; there are at most so many hot keys.
HOT_SHARE = 10_000


def join_keyed(rows: DataFrame, keyed: DataFrame, on: list[str], held: str, total: int) -> DataFrame:
    """``rows`` with the row of ``keyed`` (one for each key) of the same key, without a task that all rows of a hot key meet in.

    ``keyed`` is a cut. Its column ``held`` has the number of rows of the key, ``total`` is their sum. Keys of more than
    total / HOT_SHARE rows are hot: at most HOT_SHARE of them, whatever the size of the table, so that their first
    columns come to the driver and their rows are broadcast. The other keys join by key, with at most that share of the
    rows each. ``held`` is left out of the result.
    """
    first = F.col(on[0])
    hot = sorted({r[0] for r in keyed.where(F.col(held) > total / HOT_SHARE).select(first).collect()})
    keyed = keyed.drop(held)
    if not hot:
        return rows.join(keyed.hint("merge"), on)
    rest = rows.where(~first.isin(hot)).join(keyed.where(~first.isin(hot)).hint("merge"), on)
    return rows.where(first.isin(hot)).join(F.broadcast(keyed.where(first.isin(hot))), on).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under these names, whatever else ``docs`` carries. Ids become longs, texts strings."""
    kind = {"doc_id": "bigint"}
    return docs.select(*(F.col(n).cast(kind.get(n, "string")).alias(n) for n in names))


class Carried:
    """Columns that an operator passes on beside its own.

    Inside the operator they have names of their own (``inner``), so they clash with none of its columns. In the result
    a column keeps its name, unless the operator has a column of that name itself (upper and lower case are one): then
    it is called ``<name>_given``, with further ``_given`` as needed. doc_id is always there and not carried twice; text,
    which operators read anyway, is not sent twice, and carried as the string they read.
    """

    def __init__(self, docs: DataFrame, carry: tuple[str, ...], own: tuple[str, ...]):
        taken, names, out = {n.lower() for n in own}, [], []
        for name in dict.fromkeys(carry):
            if name.lower() == "doc_id":
                continue
            given = name
            while given.lower() in taken:
                given += "_given"
            taken.add(given.lower())
            names.append(name)
            out.append(given)
        self.inner = ["text" if n.lower() == "text" else f"carried_{i}" for i, n in enumerate(names)]
        self.out = out
        self.columns = [F.col(n).alias(i) for n, i in zip(names, self.inner, strict=True) if i != "text"]
        kinds = dict(docs.select(*self.columns).dtypes)
        self.types = [kinds.get(i, "string") for i in self.inner]

    def ddl(self) -> str:
        """The carried part of a schema, each column with a comma before it."""
        return "".join(f", `{n}` {t}" for n, t in zip(self.out, self.types, strict=True))

    def renamed(self) -> list[Column]:
        return [F.col(i).alias(n) for i, n in zip(self.inner, self.out, strict=True)]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, but what it freed goes back to the machine when a task ends: workers are kept for other stages."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return kept


def give_back() -> None:
    """Return freed memory to the machine."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
