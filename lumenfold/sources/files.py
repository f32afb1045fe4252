"""Files in and out: JSON arrays, lines and documents, CSV manifests, reports, listings, tables replaced as a whole."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import strings

POINTER = "CURRENT"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bulk file that holds one array of objects; split it into lines upstream if it is too large for one task."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_id_set(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Distinct values of one key of a JSON array's objects, as ids are compared; nothing else is parsed."""
    found = read_json_array(spark, path, f"`{key}` string").select(strings.norm_id(F.col(key)).alias(key))
    return found.where(F.col(key) != "").distinct()


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a row, nulls kept; mode="append" adds files and leaves those that are there."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV with a header under a fixed schema; no rows if there is no such file."""
    try:
        return spark.read.schema(schema).options(header=True, sep=sep, escape='"', multiLine=True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, fields: list[str], sep: str = ",", mode: str = "overwrite") -> None:
    """Fixed columns in their order, quotes doubled."""
    df.select(*fields).write.mode(mode).options(header=True, sep=sep, escape='"').csv(path)


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, stem, modified, length of files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(root)
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return found.select("path", stem.alias("stem"), F.col("modificationTime").alias("modified"), "length")


def read_rows(spark: SparkSession, path: str, schema: str, row: str = "row_idx", sep: str = ",") -> DataFrame:
    """A CSV with its rows numbered in the order of the file, as positions pair it with other tables of the same order.

    Each file is numbered on its own, from 0 behind its header; empty lines count but give no row. Blocks of a file are
    read by tasks of their own and counted first, so that only one number a block meets the lines. A field must not hold
    a line break.
    """
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at")]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("__id"))
    blocks = lines.groupBy("__file", "__at").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    earlier = W.partitionBy("__file").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("__file", "__at", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    nth = F.col("__start") + F.col("__id") - F.col("__first") - 1
    numbered = lines.join(starts, ["__file", "__at"]).where((nth >= 0) & (F.col("value") != ""))
    return numbered.select(nth.alias(row), F.from_csv("value", schema, {"sep": sep, "escape": '"'}).alias("__r")).select(row, "__r.*")


def distinct_parents(spark: SparkSession, root: str, glob: str, without: str = "cache") -> DataFrame:
    """Folders below ``root`` that hold a file of that name, except those on whose path a folder is named ``without``."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    found = list_files(spark, root, glob).select(parent.alias("parent")).distinct()
    return found.where(~F.array_contains(F.split("parent", "/"), without)).orderBy("parent")


def stale_outputs(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Keys of ``inputs`` whose output is missing or older, from listings with (key, modified)."""
    new = inputs.groupBy(key).agg(F.max("modified").alias("new"))
    old = outputs.groupBy(key).agg(F.min("modified").alias("old"))
    return new.join(old, key, "left").where("old is null or old < new").select(key)


# --- small results, written by the driver -----------------------------------------------------------------------------


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written aside and renamed over the old one in one step."""
    jvm = spark.sparkContext._jvm
    fs, to = _filesystem(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, to, over)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small file, whole and all at once, unless there is one of that name: then false. Of any number of writers one gets true.

    Written aside, then put in place by what doesn't overwrite: a hard link on local disks, elsewhere the file system's
    rename without overwriting, which HDFS and object stores with conditional writes do in one step.
    """
    jvm = spark.sparkContext._jvm
    fs, to = _filesystem(spark, path)
    fs.mkdirs(to.getParent())
    aside = jvm.org.apache.hadoop.fs.Path(f"{to.getParent()}/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(aside.toUri().getPath(), to.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, to, none)
    except Exception:
        if not fs.exists(to):
            raise
        return False
    finally:
        fs.delete(aside, False)
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, where = _filesystem(spark, path)
    if not fs.exists(where):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a document")
    return rows


def write_json_document(df: DataFrame, path: str, most: int = 100_000) -> None:
    """All rows of a small table as one JSON array of objects; a table of more than ``most`` rows is refused."""
    whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    write_text(df.sparkSession, path, "[" + ",\n ".join(r[0] for r in _few(df.select(whole), most)) + "]\n")


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    """A small table as Markdown; bars inside cells are escaped, null is empty."""
    cells = [strings.md_escape(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]
    rows = _few(df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))), most)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *(r[0] for r in rows)])


def write_report(spark: SparkSession, path: str, title: str, sections: dict[str, DataFrame | str]) -> None:
    """A Markdown report: a heading and a table or a text for each section."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    write_text(spark, path, "\n\n".join(parts) + "\n")


# --- tables replaced as a whole ---------------------------------------------------------------------------------------


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version beside the others, then point to it.

    The pointer is one small file that is renamed over the old one, so ``read_table`` always finds a whole version, the
    old or the new one; if writing fails, the pointer stays. The version before is kept for readers that have begun.
    """
    spark = df.sparkSession
    before, name = read_text(spark, f"{path}/{POINTER}"), f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    write_text(spark, f"{path}/{POINTER}", name)
    fs, root = _filesystem(spark, path)
    for status in fs.listStatus(root):
        if status.isDirectory() and status.getPath().getName() not in (name, before):
            fs.delete(status.getPath(), True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names."""
    name = read_text(spark, f"{path}/{POINTER}")
    if name is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{name}")


# --- part files -------------------------------------------------------------------------------------------------------


def write_part(df: DataFrame, root: str, number: int) -> None:
    """One part of a build that may be interrupted; a part counts once its file of success is there."""
    df.write.mode("overwrite").parquet(f"{root}/part_{number:06d}")


def read_parts(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All finished parts; no rows if there is none."""
    fs, where = _filesystem(spark, root)
    done = [f"{root}/{s.getPath().getName()}" for s in (fs.listStatus(where) if fs.exists(where) else []) if fs.exists(_filesystem(spark, f"{root}/{s.getPath().getName()}/_SUCCESS")[1])]
    return spark.read.schema(schema).parquet(*sorted(done)) if done else spark.createDataFrame([], schema)


def build_rest(items: DataFrame, root: str, schema: str, key: str, build, part: int) -> DataFrame:
    """Build what no finished part holds, as part number ``part``, and return all parts; ``build`` maps items to rows."""
    spark = items.sparkSession
    done = read_parts(spark, root, schema)
    write_part(build(items.join(done.select(key), key, "left_anti")), root, part)
    return read_parts(spark, root, schema)


def merge_parts(spark: SparkSession, root: str, schema: str, to: str) -> None:
    """One table of all finished parts in place of ``to``."""
    replace_table(read_parts(spark, root, schema), to)
