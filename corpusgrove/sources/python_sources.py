"""Python Data Sources (Spark 4 ``pyspark.sql.datasource``) for inputs that
Spark has no reader for: SQLite tables (A3) and CSV files with leading lines
to skip (A1). Plus the npy blob decoder (A4).

Files must be visible to every executor (a shared path on a cluster).
"""

from __future__ import annotations

import csv
import glob
import heapq
import io
import os
import sqlite3

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_REGISTERED: set[int] = set()


def quote_ident(name: str) -> str:
    """SQLite identifier quoting (fixes raw interpolation of names)."""
    return '"' + str(name).replace('"', '""') + '"'


def _sqlite_type(decl: str | None) -> T.DataType:
    d = (decl or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(k in d for k in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    if "BLOB" in d or d in ("ARRAY",):
        return T.BinaryType()
    return T.StringType()


class SqlitePartition(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


#: row-id intervals that planning looks at before it cuts the rest by counting
MAX_INTERVALS = 100_000


def rowid_ranges(con, table: str, step: int, max_intervals: int = MAX_INTERVALS) -> list[tuple[int, int]]:
    """Row-id intervals, in order, that hold all rows and at most ``step`` of them each.

    The widest interval is halved by its ids, and both halves shrink to the ids that
    occur in them (two index look-ups), until none is wider than ``step``, so empty
    ranges cost nothing. With ``max_intervals`` reached (ids far apart), what is
    still wider is cut at every ``step``-th id that occurs. Neighbours that together cannot
    hold more than ``step`` rows become one, so their number follows the rows, not the ids."""
    name = quote_ident(table)
    lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()
    if lo is None:
        return []
    wide, done = [(lo - hi, lo, hi)], []
    while wide and len(wide) + len(done) < max_intervals:
        _, a, b = heapq.heappop(wide)
        if b - a < step:
            done.append((a, b, b - a + 1))
            continue
        mid = (a + b) // 2
        left = con.execute(f"SELECT rowid FROM {name} WHERE rowid <= ? ORDER BY rowid DESC LIMIT 1", (mid,)).fetchone()[0]
        right = con.execute(f"SELECT rowid FROM {name} WHERE rowid > ? ORDER BY rowid LIMIT 1", (mid,)).fetchone()[0]
        heapq.heappush(wide, (a - left, a, left))
        heapq.heappush(wide, (right - b, right, b))
    for _, a, b in wide:
        if b - a < step:
            done.append((a, b, b - a + 1))
            continue
        while True:
            ids = f"SELECT rowid FROM {name} WHERE rowid BETWEEN ? AND ? ORDER BY rowid LIMIT {int(step)}"
            n, last = con.execute(f"SELECT count(*), max(rowid) FROM ({ids})", (a, b)).fetchone()
            done.append((a, last, n))
            if last >= b:
                break
            a = con.execute(f"SELECT rowid FROM {name} WHERE rowid > ? ORDER BY rowid LIMIT 1", (last,)).fetchone()[0]
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(done):
        if out and out[-1][2] + n <= step:
            out[-1] = (out[-1][0], b, out[-1][2] + n)
        else:
            out.append((a, b, n))
    return [(a, b) for a, b, _ in out]


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path = options["path"]
        self.table = options.get("table", "dataset")
        self.columns = [f.name for f in schema.fields]
        self.types = [f.dataType for f in schema.fields]
        self.step = int(options.get("rowsPerPartition", "100000"))

    def partitions(self):
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            return [SqlitePartition(a, b) for a, b in rowid_ranges(con, self.table, self.step)] or [SqlitePartition(0, -1)]
        finally:
            con.close()

    def read(self, partition):
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        cols = ", ".join(quote_ident(c) for c in self.columns)
        sql = (f"SELECT {cols} FROM {quote_ident(self.table)} WHERE rowid BETWEEN ? AND ? "
               "ORDER BY rowid")
        for row in con.execute(sql, (partition.lo, partition.hi)):
            yield tuple(_coerce(v, t) for v, t in zip(row, self.types))
        con.close()


def _coerce(v, t):
    if v is None:
        return None
    if isinstance(t, T.BinaryType):
        return bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else str(v).encode()
    if isinstance(t, T.LongType):
        try:
            return int(v)
        except (TypeError, ValueError):
            return None
    if isinstance(t, T.DoubleType):
        try:
            return float(v)
        except (TypeError, ValueError):
            return None
    return v if isinstance(v, str) else str(v)


class SqliteDataSource(DataSource):
    """``spark.read.format("cg_sqlite").option("path", p).option("table", t)
    .option("columns", "a\\x1fb")``: one partition per range of
    :func:`rowid_ranges`."""

    @classmethod
    def name(cls):
        return "cg_sqlite"

    def schema(self):
        path, table = self.options["path"], self.options.get("table", "dataset")
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        info = con.execute(f"PRAGMA table_info({quote_ident(table)})").fetchall()
        con.close()
        decl = {r[1]: r[2] for r in info}
        wanted = [c for c in self.options.get("columns", "").split("\x1f") if c] or list(decl)
        missing = [c for c in wanted if c not in decl]
        if missing:
            raise ValueError(f"columns not in table {table!r}: {missing}")
        seen, fields = set(), []
        for c in wanted:
            if c in seen:
                continue
            seen.add(c)
            fields.append(T.StructField(c, _sqlite_type(decl[c]), True))
        return T.StructType(fields)

    def reader(self, schema):
        return SqliteReader(self.options, schema)


class CsvSkipPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CsvSkipReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options = options
        self.width = len(schema.fields)

    def partitions(self):
        return [CsvSkipPartition(p) for p in _files(self.options["path"])]

    def read(self, partition):
        header = self.options.get("header", "false") == "true"
        records = csv_records(partition.path, self.options)
        if header:
            next(records, None)
        for rec in records:
            rec = [(v if v != "" else None) for v in rec[: self.width]]
            rec += [None] * (self.width - len(rec))
            yield tuple(rec)


def csv_records(path: str, options):
    """Records of one file. A comment sign counts only where a record begins,
    never inside a quoted text."""
    skip, comment = int(options.get("skip", "0")), options.get("comment")
    multi_line = options.get("multi_line", "true") == "true"
    with open(path, encoding="utf-8", newline="") as fh:
        for _ in range(skip):
            fh.readline()
        if not multi_line:
            for ln in fh:
                if ln.strip("\r\n") and not (comment and ln.startswith(comment)):
                    yield next(csv.reader([ln]))
            return
        begins = [True]

        def lines():
            for ln in fh:
                if begins[0] and comment and ln.startswith(comment):
                    continue
                begins[0] = False
                yield ln

        reader = csv.reader(lines())
        while True:
            begins[0] = True
            rec = next(reader, None)
            if rec is None:
                return
            if rec:
                yield rec


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "*")) if not os.path.basename(p).startswith((".", "_")))
    return sorted(glob.glob(path)) or [path]


class CsvSkipDataSource(DataSource):
    """CSV with the first ``skip`` physical lines of each file dropped; all
    columns are strings named ``_c0`` ... (``width`` of them; by default as many as
    the first record has)."""

    @classmethod
    def name(cls):
        return "cg_csvskip"

    def schema(self):
        width = int(self.options.get("width", "0"))
        files = _files(self.options["path"])
        if not width and files:
            width = len(next(csv_records(files[0], self.options), []))
        width = max(1, width)
        return T.StructType([T.StructField(f"_c{i}", T.StringType(), True) for i in range(width)])

    def reader(self, schema):
        return CsvSkipReader(self.options, schema)


def register_sources(spark) -> None:
    key = id(spark)
    if key in _REGISTERED:
        return
    spark.dataSource.register(SqliteDataSource)
    spark.dataSource.register(CsvSkipDataSource)
    _REGISTERED.add(key)


def _decode_one(b):
    if b is None:
        return None
    try:
        arr = np.load(io.BytesIO(bytes(b)), allow_pickle=False)
        return np.asarray(arr, dtype=np.float32).ravel()
    except (ValueError, OSError, EOFError):
        pass
    try:
        return np.array([float(bytes(b))], dtype=np.float32)
    except ValueError:
        return None


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_npy(blobs: pd.Series) -> pd.Series:
    """A4: npy bytes -> array<float>; the text of a number -> one entry;
    anything else -> NULL (the raw bytes stay in the column read)."""
    return blobs.map(_decode_one)


def encode_npy(vec) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(vec))
    return out.getvalue()
