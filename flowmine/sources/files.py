"""File sources and sinks: CSV folders, parquet stages, tables and reports."""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmine.functions.columns import INF, clean_name, quote
from flowmine.operators.clean import is_afternoon, weekday_of
from flowmine.session import cut_lineage

#: (file, block) pairs up to which their offsets are broadcast, some 200 bytes each.
OFFSET_ROWS = 500_000


def discover_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Files under ``folder``: by weekday in the name, morning first, then name."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(folder).select("path"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.select(
        "path", F.coalesce(weekday_of(name), F.lit(99)).alias("day"),
        is_afternoon(name, ["afternoon"]).cast("int").alias("pm"), name.alias("name")).orderBy(
            "day", "pm", "name").collect()
    if not rows:
        raise FileNotFoundError(f"no files matching {pattern!r} under {folder}")
    return [r["path"] for r in rows]


def header_names(raw: list[str]) -> list[str | None]:
    """Clean column names; a repeated header cell gets ``.1``, a name that is
    still taken after cleaning is dropped (``None``)."""
    seen: dict[str, int] = {}
    out: list[str | None] = []
    for cell in raw:
        again = seen.get(cell, 0)
        seen[cell] = again + 1
        name = clean_name(f"{cell}.{again}" if again else cell)
        out.append(None if name in out else name)
    return out


def _header(spark: SparkSession, path: str, encoding: str) -> tuple[str, ...]:
    line = (spark.read.option("encoding", encoding).option("header", "false").option("inferSchema", "false")
            .csv(path).limit(1).collect())
    return tuple("" if v is None else v for v in line[0]) if line else ()


def read_csv_folder(spark: SparkSession, folder: str, pattern: str = "*.csv", encoding: str = "ISO-8859-1",
                    stage: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """All CSVs of a folder as text columns, one read per header layout.

    Adds ``source_file`` (name), ``source_path`` (which tells files of one name
    apart) and ``row_in_source``. Columns a file lacks are NULL. The text is read
    once and staged, so that later passes read the columns they need.
    """
    paths = discover_files(spark, folder, pattern)
    with ThreadPoolExecutor(8) as pool:
        headers = list(pool.map(lambda p: _header(spark, p, encoding), paths))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path, head in zip(paths, headers):
        if head:
            layouts.setdefault(head, []).append(path)
    parts = []
    for head, files in layouts.items():
        names = header_names(list(head))
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(head))])
        raw = (spark.read.schema(schema).option("header", "true").option("encoding", encoding)
               .option("mode", "PERMISSIVE").csv(files))
        parts.append(raw.select(
            *[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n is not None],
            F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"),
            F.col("_metadata.file_block_start").alias("__at"),
            F.monotonically_increasing_id().alias("__seq")))
    if not parts:
        raise ValueError(f"no file under {folder} has a header")
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _numbered(stage(out)).drop("__at", "__seq")


def _numbered(staged: DataFrame) -> DataFrame:
    """``row_in_source`` from a first id and a count per (file, block): the rows themselves are not shuffled.

    Ids rise by one within a block, as one task reads a block from its start to its
    end, and are fixed by the staged files. The table of blocks is broadcast up to
    ``OFFSET_ROWS`` rows and joined by shuffle beyond that.
    """
    blocks = staged.groupBy("source_path", "__at").agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("source_path").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(blocks.select("source_path", "__at", (
        F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")))
    if offsets.count() <= OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    out = staged.join(offsets, ["source_path", "__at"])
    return out.select(*[quote(c) for c in staged.columns], (F.col("__seq") + F.col("__shift")).alias("row_in_source"))


def aligned_union(tables: Mapping[str, DataFrame], source: str = "source") -> DataFrame:
    """Union by name; missing columns are NULL; the origin is kept."""
    tagged = [df.withColumn(source, F.lit(name)) for name, df in tables.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def require_rows(df: DataFrame, least: int) -> int:
    """Row count; an error when the source is smaller than expected."""
    n = df.count()
    if n < least:
        raise ValueError(f"expected at least {least} rows, found {n}")
    return n


def signature(**parts) -> str:
    """Short stable name for a set of settings."""
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def folder_state(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str:
    """Short name for the files of a folder: it changes with any path, length or time of change."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime"))
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    r = found.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.bit_xor(one).alias("h")).first()
    return f"{r['n']}-{r['size']}-{r['h']}"


def parquet_stage(spark: SparkSession, base: str, name: str, key: str,
                  build: Callable[[], DataFrame], meta: Callable[[], dict] | dict | None = None) -> DataFrame:
    """Result of ``build``, written once under ``base`` and read back.

    The folder name holds ``key``, so changed settings never meet old data. Rows
    (``data``) and ``meta`` (a one-row JSON table, see ``stage_meta``) are written
    beside the target and published by one rename: a broken or a concurrent
    writer leaves nothing half done, and of two writers the first one's stands.
    """
    target = f"{base.rstrip('/')}/{name}-{key}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(target)):
        made = f"{base.rstrip('/')}/_{name}-{key}-{uuid.uuid4().hex}"
        build().write.parquet(f"{made}/data")
        if meta is not None:
            told = meta() if callable(meta) else meta
            write_report(spark.createDataFrame([(json.dumps(told, default=str),)], "meta string"), f"{made}/meta")
        # A rename onto a folder that has appeared meanwhile would land inside it.
        if not fs.exists(path(target)) and not fs.rename(path(made), path(target)) and not fs.exists(path(target)):
            raise OSError(f"could not publish {target}")
    return spark.read.parquet(f"{target}/data")


def stage_meta(spark: SparkSession, base: str, name: str, key: str) -> dict:
    """What ``parquet_stage`` wrote beside its rows."""
    row = spark.read.schema("meta string").json(f"{base.rstrip('/')}/{name}-{key}/meta").first()
    return json.loads(row["meta"])


def write_table(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV with a header; arrays and maps as JSON text.

    With ``order`` (as ``row_no`` of ``number_in_order``) the files, by name, hold
    the rows in that order: a range per file, sorted inside.
    """
    if order:
        df = df.repartitionByRange(*[quote(c) for c in order]).sortWithinPartitions(*[quote(c) for c in order])
    flat = [F.to_json(quote(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else quote(f.name)
            for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinities become null."""
    cols = [F.when(~F.isnan(quote(f.name)) & (F.abs(quote(f.name)) != F.lit(INF)), quote(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else quote(f.name)
            for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_graph(edges: DataFrame, path: str, min_weight: float = 0.0) -> None:
    """Observed transitions above a weight as a JSON edge table."""
    write_report(observed_edges(edges, min_weight), path)


def observed_edges(edges: DataFrame, min_weight: float = 0.0) -> DataFrame:
    return (edges.filter((F.col("cnt") > 0) & (F.col("prob") > min_weight))
            .select("src", "dst", "cnt", F.round("prob", 5).alias("weight")))
