"""File sources and sinks by role (A1, A2, A5-A10).

A *role map* says which source column feeds which corpus column:
``{"text": 5, "ts": 0, "set": "fixed:dev"}``. CSV roles are zero-based
positions, JSON roles are field names; ``fixed:<v>`` gives a literal (A5).
Only mapped columns are selected, so the CSV/JSON scan prunes the rest.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ROLE_TYPES

EXPORT_TAG = "#ABCExportv1"   # fixed value: first line of an export file
EXPORT_COLUMNS = ("text", "ref", "ts", "target", "predict", "distance", "set")  # fixed order


class LoadError(ValueError):
    pass


def _fixed(v) -> str | None:
    s = str(v)
    return s[len("fixed:"):] if s.startswith("fixed:") else None


def _place() -> tuple:
    """Where a row was read: the file, and the block of it that a task scanned."""
    return F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")


def apply_roles(df: DataFrame, roles: dict, by_position: bool, place: bool = False) -> DataFrame:
    """Select mapped columns under their role names, add fixed roles as
    literals (A5) and cast each role to its corpus type. Two roles may read
    the same column (fixes Q4). ``place`` adds the file and block of a file scan."""
    if "text" not in roles:
        raise LoadError("a text role is required")
    cols = []
    for role, src in roles.items():
        if role not in ROLE_TYPES and role not in ("embedding", "reduced"):
            continue
        fixed = _fixed(src)
        if fixed is not None:
            if role == "text":
                raise LoadError("text cannot be a fixed value")
            c = F.lit(fixed)
        else:
            name = df.columns[int(src)] if by_position else str(src)
            if name not in df.columns:
                raise LoadError(f"no source column {src!r} for role {role!r}")
            c = F.col(f"`{name}`")
        t = ROLE_TYPES.get(role)
        if role == "ts":
            from ..operators.curate import coerce_ts
            c = coerce_ts(c)
        elif t is not None and not isinstance(t, T.StringType):
            c = c.cast("string").try_cast(t)
        elif t is not None:
            c = c.cast(t)
        cols.append(c.alias(role))
    if place and "_file" in df.columns:
        return df.select(*cols, "_file", "_block")
    return df.select(*cols, *_place()) if place else df.select(*cols)


def read_csv_roles(spark: SparkSession, path: str, roles: dict, comment: str | None = None,
                   skip_first: int = 0, multi_line: bool = True, na_values: str | None = None,
                   header: bool = False, place: bool = False) -> DataFrame:
    """A1: headerless CSV by position. ``multi_line`` (default) keeps quoted
    newlines inside a text (one task per file); ``multi_line=False`` splits
    large files across tasks for one-line texts. ``skip_first`` drops the
    first physical lines of each file."""
    if skip_first:
        place = False
        width = max((int(v) + 1 for v in roles.values() if not str(v).startswith("fixed:")), default=1)
        df = _read_csv_skipping(spark, path, skip_first, comment, header, multi_line, width)
        if na_values is not None:
            df = df.select(*[F.when(F.col(c) != na_values, F.col(c)).alias(c) for c in df.columns])
    else:
        reader = (spark.read.option("header", header).option("multiLine", multi_line)
                  .option("escape", '"').option("quote", '"').option("mode", "PERMISSIVE"))
        if comment:
            reader = reader.option("comment", comment)
        if na_values is not None:
            reader = reader.option("nullValue", na_values)
        df = reader.csv(path)
    return apply_roles(df, roles, by_position=True, place=place)


def _read_csv_skipping(spark, path, skip, comment, header, multi_line=True, width=0) -> DataFrame:
    """CSV with leading lines skipped: one partition per file through the
    Python Data Source reader (files stay whole because quoted texts may span
    lines)."""
    from .python_sources import register_sources
    register_sources(spark)
    r = (spark.read.format("cg_csvskip").option("path", path).option("skip", str(skip))
         .option("header", str(header).lower()).option("multi_line", str(multi_line).lower())
         .option("width", str(width)))
    if comment:
        r = r.option("comment", comment)
    return r.load()


def read_json_roles(spark: SparkSession, path: str, roles: dict, layout: str = "auto", place: bool = False) -> DataFrame:
    """A2: JSON Lines, an array of records, or one object keyed by row id
    (read as ``map<string, struct>`` and exploded; the key becomes ``_key``).
    The role projection runs once, after reading (fixes Q5)."""
    if layout == "auto":
        layout = json_layout(spark, path)
    if layout == "lines":
        df = spark.read.json(path)
    elif layout == "array":
        df = spark.read.option("multiLine", True).json(path)
    elif layout == "keyed":
        df = _explode_keyed(spark, path, roles)
    else:
        raise LoadError(f"unknown JSON layout {layout!r}")
    return apply_roles(df, roles, by_position=False, place=place)


def _explode_keyed(spark: SparkSession, path: str, roles: dict) -> DataFrame:
    """``{"0": {...}, "1": {...}}`` -> one row per key (``_key``) with the fields
    that the roles name. The object is read as ``map<string, string>`` (one task
    per file, as any single JSON document), exploded, and each record parsed
    with a schema made from the roles, so no record decides for another."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType())))
                       .alias("_key", "_json"), *_place())
    fields = {}
    for role, name in roles.items():
        if str(name).startswith("fixed:") or name == "_key":
            continue
        t = ROLE_TYPES.get(role)
        fields[name] = t if isinstance(t, T.ArrayType) else fields.get(name, T.StringType())
    if not fields:
        return pairs.select("_key", "_file", "_block")
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    return pairs.select("_key", F.from_json("_json", schema).alias("_rec"), "_file", "_block").select("_key", "_rec.*", "_file", "_block")


def json_layout(spark: SparkSession, path: str) -> str:
    """``lines``, ``array`` or ``keyed``, decided by a Spark read of all lines of
    the file or of all files of a folder: JSON Lines if each line is an object by
    itself; files that are one object each, whose values are all objects, are
    keyed by row id."""
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path")).where(F.trim("value") != "")
    start = F.substring(F.trim("value"), 1, 1)
    whole = F.get_json_object("value", "$").isNotNull()
    values = F.map_values(F.from_json("value", T.MapType(T.StringType(), T.StringType())))
    keyed = whole & (start == "{") & (F.size(values) > 0) & F.forall(values, lambda v: F.coalesce(v.startswith("{"), F.lit(False)))
    by_file = lines.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(whole & (start == "{"), 1)).alias("o"), F.count(F.when(keyed, 1)).alias("k"))
    n, longest, objects, keyed_lines = by_file.agg(F.sum("n"), F.max("n"), F.sum("o"), F.sum("k")).first()
    if not n:
        return "lines"
    if n == objects:
        return "keyed" if longest == 1 and keyed_lines == n else "lines"
    return "array" if lines.select(start).first()[0] == "[" else "keyed"


def read_sqlite_roles(spark: SparkSession, path: str, roles: dict, table: str = "dataset",
                      rows_per_partition: int = 100_000) -> DataFrame:
    """A3: a SQLite table through the Python Data Source (rowid ranges per
    partition, quoted identifiers, projection pushed into the SQL). Vector
    roles (``embedding``, ``reduced``) are decoded from npy blobs (A4)."""
    from .python_sources import decode_npy, register_sources
    register_sources(spark)
    src_cols = {r: s for r, s in roles.items() if _fixed(s) is None}
    df = (spark.read.format("cg_sqlite").option("path", path).option("table", table)
          .option("columns", "\x1f".join(str(s) for s in src_cols.values()))
          .option("rowsPerPartition", str(rows_per_partition)).load())
    out = apply_roles(df, roles, by_position=False)
    for r in ("embedding", "reduced"):
        if r in src_cols:
            out = out.withColumn(r, decode_npy(F.col(r)))
    return out


def load_dataset(spark: SparkSession, corpus: DataFrame | None, filename: str, type: str | None = None,
                 roles: dict | None = None, **kw) -> DataFrame:
    """Dispatch by type (or by extension without the dot, fixes Q7),
    read by role, then B3, B1, A6, B4, B2 via :func:`curate.append_rows`.
    Nothing is appended when the read fails (all or nothing, Q6)."""
    from ..operators.curate import append_rows
    if type is None:
        type = os.path.splitext(filename)[1].lstrip(".").lower()
    roles = roles or {"text": 0}
    dedupe_sets = kw.pop("dedupe_sets", ("train",))
    if type == "csv":
        new = read_csv_roles(spark, filename, roles, place=True, **kw)
    elif type == "json":
        new = read_json_roles(spark, filename, roles, place=True, **kw)
    elif type in ("sqlite", "sqlite3", "db"):
        new = read_sqlite_roles(spark, filename, roles, **kw)
    elif type == "parquet":
        new = apply_roles(spark.read.parquet(filename), roles, by_position=False, place=True)
    elif type == "export":
        new = read_export(spark, filename)
    else:
        raise LoadError(f"unknown dataset type {type!r}")
    return append_rows(corpus, new, dedupe_sets)


#: how export files are written: all cells quoted, texts kept as they are
_EXPORT_CSV = {"escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
_TAG_FOLDER = "_EXPORT_TAG"


def export_csv(corpus: DataFrame, path: str, single_file: bool = False) -> str:
    """Both sets in one CSV dataset: header + columns text, ref, ts,
    target, predict, distance, set. Texts keep padding and quotes. The
    export tag is a small text table beside the part files (or
    the first line when ``single_file`` is asked for small data, which one task
    then writes). Everything is written by Spark, on any file system it knows."""
    if corpus.limit(1).count() == 0:
        raise LoadError("nothing to save")
    spark = corpus.sparkSession
    out = corpus.select(*[F.col(c) for c in EXPORT_COLUMNS])
    if single_file:
        return _export_one(out, path)
    out.write.mode("overwrite").options(header=True, **_EXPORT_CSV).csv(path)
    spark.createDataFrame([(EXPORT_TAG,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, _TAG_FOLDER))
    return path


def _export_one(out: DataFrame, path: str) -> str:
    spark = out.sparkSession
    head = spark.createDataFrame([(EXPORT_TAG + "\n" + ",".join(f'"{c}"' for c in out.columns),)], "value string").coalesce(1)
    lines = head.union(out.select(F.to_csv(F.struct(*out.columns), {**_EXPORT_CSV, "emptyValue": ""})))
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(parts)  # the partitions of a union are written in order
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, target = hadoop.Path(parts), hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    written = fs.globStatus(hadoop.Path(parts, "part-*"))
    if fs.exists(target):
        if fs.getFileStatus(target).isDirectory():
            raise LoadError(f"{path} is a folder")
        fs.delete(target, False)
    fs.rename(written[0].getPath(), target)
    fs.delete(folder, True)  # the folder named above, which holds no more than the commit marker
    return path


def is_export(path: str) -> bool:
    """Detect an export by its tag (tag table, or first cell of a file)."""
    spark = SparkSession.active()
    try:
        tag = spark.read.text(os.path.join(path, _TAG_FOLDER))
        return tag.where(F.col("value") == EXPORT_TAG).limit(1).count() > 0
    except AnalysisException:
        pass  # no tag table: a file, or a folder of other data
    where = F.col("_metadata.file_block_start") == 0
    files = spark.read.text(path)
    if len(files.inputFiles()) != 1:
        return False
    first = files.where(where).select("value").take(1)
    return bool(first) and first[0]["value"].split(",")[0] == EXPORT_TAG


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Export profile: header, multi-line, fixed role order; ``#``
    comments only for a tagged single file. A first cell that starts with the comment
    sign is quoted in such a file, so it is no comment."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    try:
        spark.read.text(os.path.join(path, _TAG_FOLDER))
    except AnalysisException:
        if is_export(path):
            reader = reader.option("comment", "#")
    df = reader.csv(path)
    roles = {r: r for r in EXPORT_COLUMNS}
    return apply_roles(df, roles, by_position=False)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """A10: first n rows (the preview is a feature-defined limit)."""
    return df.limit(n)
