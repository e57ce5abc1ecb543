"""Sinks: canonical JSON, flat CSV, idempotent and exclusive tables, reports, self-contained pages, bound traces, progress."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions import scalar


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text with its fields in order of name, nulls included, so that equal rows give equal texts."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """Canonical JSON, a row a line, each partition sorted."""
    json_rows(df).sortWithinPartitions("value").write.mode(mode).text(path)


def document(df: DataFrame, most: int = 10_000) -> str:
    """One canonical JSON document of a small result; more than ``most`` rows are an error."""
    rows = json_rows(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a document holds {most} rows at most")
    return json.dumps(sorted((json.loads(r["value"]) for r in rows), key=lambda r: json.dumps(r, sort_keys=True)), indent=2, sort_keys=True) + "\n"


def flat(df: DataFrame, separator: str = " | ") -> DataFrame:
    """Columns that CSV can hold: arrays joined, structs and maps as JSON."""
    out = []
    for c, t in df.dtypes:
        if t.startswith("array<") and "struct" not in t and "array<array" not in t:
            out.append(F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), separator).alias(c))
        elif t.startswith(("struct", "map", "array")):
            out.append(F.to_json(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """The named columns, in this order, with a header."""
    flat(df.select(*columns)).write.mode(mode).option("header", "true").csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def table_digest(df: DataFrame) -> str:
    """A digest of the set of rows, whatever their order: from the number and the sums of parts of the rows' hashes."""
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(5)]
    row = df.agg(F.count("*").alias("n"), *sums).select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "s0", "s1", "s2", "s3", "s4")]), 256).alias("d"))
    return row.first()["d"]


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """Write a table unless it is there already: written, unchanged or overwritten; a different one is an error without ``overwrite``."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
        return "written"
    if table_digest(spark.read.parquet(path)) == table_digest(df):
        return "unchanged"
    if not overwrite:
        raise FileExistsError(f"{path} holds other rows")
    df.write.mode("overwrite").parquet(path)
    return "overwritten"


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key the table does not hold yet; of equal keys in one batch one is taken."""
    spark = df.sparkSession
    rows = df.dropDuplicates(key)
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*key), key, "left_anti")
    rows.write.mode("append").parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Write a table that must not exist."""
    df.write.mode("errorifexists").parquet(path)


def markdown(df: DataFrame, title: str, columns: list[str], order: list, top: int = 20) -> str:
    """A table of the first rows in the given order; a report of ``top`` rows by its nature."""
    rows = flat(df.orderBy(*order).limit(top).select(*columns)).collect()
    text = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)] + ["| " + " | ".join(text(r[c]) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"


PAGE = "<!doctype html><meta charset=utf-8><title>{title}</title><pre id=out></pre><script type=application/json id=data>{data}</script><script>out.textContent=JSON.stringify(JSON.parse(data.textContent),null,1)</script>"


def page(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A page that carries its data; closing tags within the data are escaped."""
    return PAGE.format(title=title.replace("&", "&amp;").replace("<", "&lt;"), data=document(df, most).replace("</", "<\\/"))


def write_traces(df: DataFrame, path: str) -> DataFrame:
    """Write a trace table and give back one row (path, sha256, n) that binds it."""
    write_new(df, path)
    spark = df.sparkSession
    found = spark.read.parquet(path)
    return spark.createDataFrame([(path, table_digest(found), found.count())], "path string, sha256 string, n bigint")


def timeline(df: DataFrame, by: list[str], start: str, stop: str, label: str) -> DataFrame:
    """What a band chart of a timeline draws: by, label, start, stop and lane (a number for each label, in order of name). Charts themselves are drawn elsewhere."""
    lanes = df.select(label).distinct().agg(F.array_sort(F.collect_set(label)).alias("_l"))
    return df.join(F.broadcast(lanes)).select(*by, label, start, stop, F.array_position("_l", F.col(label)).alias("lane"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The latest status of each recording and how many there are of each, from an append-only log (relative_path, status, at)."""
    log = spark.read.parquet(path)
    last = log.groupBy("relative_path").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
    return last.groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("relative_path")).alias("paths"))


def record_progress(df: DataFrame, path: str) -> None:
    """Append statuses to the log; ``at`` is the time of writing."""
    df.select("relative_path", "status", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def row_digest(df: DataFrame) -> DataFrame:
    """Rows with ``sha256`` over their canonical values."""
    return df.withColumn("sha256", F.sha2(scalar.canonical(*[F.col(c) for c in sorted(df.columns)]), 256))
