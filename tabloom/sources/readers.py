"""Sources: Parquet, delimited text, .dta, Excel, DataFrames, SQL; and the boundary every source passes."""

from __future__ import annotations

import csv
import glob
import json
import os
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace as changed

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import VerbError
from ..functions.values import BIG, EPOCH_MS
from ..plans.view import Meta, View
from . import store
from .names import sanitised

META_KEY = "tabloom"
TEXT = (".csv", ".tsv", ".txt", ".tab")


def boundary(df: DataFrame, paths: tuple[str, ...] = (), step: str = "use") -> View:
    """Two kinds of values only: numbers (missing is null) and strings (missing is '').

    Dates become day counts since 1960, times ms counts, truth values 0/1; NaN,
    infinities and magnitudes from 2^1023 on are missing; columns of nested and
    binary types are dropped with a warning.
    """
    cols, meta, gone = [], {}, []
    kept = [f for f in df.schema if _readable(f.dataType)]
    gone = [f.name for f in df.schema if not _readable(f.dataType)]
    if gone:
        warnings.warn(f"dropped (no number, string or date): {', '.join(gone)}", stacklevel=3)
    if not kept:
        raise VerbError("no variable is left")
    for f, name in zip(kept, sanitised([f.name for f in kept]), strict=True):
        c, t = F.col(f"`{f.name}`"), f.dataType
        told = json.loads((f.metadata or {}).get(META_KEY, "{}"))
        m = Meta(**{k: v for k, v in told.items() if k in ("storage", "fmt", "label", "value_label")}, source=f.name if f.name != name else "", chars=tuple(tuple(c) for c in told.get("chars", ())))
        if isinstance(t, T.BooleanType):
            c = c.cast("tinyint")
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            c = F.when(F.abs(c) < F.lit(BIG), c)
        elif isinstance(t, T.DateType):
            c, m = F.datediff(c, F.lit("1960-01-01").cast("date")), changed(m, fmt=m.fmt or "%td")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            micros = F.unix_micros(c.cast("timestamp")) if isinstance(t, T.TimestampType) else F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{f.name}`)")
            c, m = F.floor(micros / 1000).cast("bigint") + F.lit(EPOCH_MS), changed(m, fmt=m.fmt or "%tc")
        elif isinstance(t, T.NullType):
            c = c.cast("int")
        elif isinstance(t, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif type(t).__name__ == "TimeType":
            c, m = F.expr(f"cast(extract(hour from `{f.name}`) * 3600000 + extract(minute from `{f.name}`) * 60000 + floor(extract(second from `{f.name}`) * 1000) as bigint)"), changed(m, fmt="%tcHH:MM:SS")
        cols.append(c.alias(name))
        meta[name] = m
    out = df.select(*cols)
    return View(out, {k: m for k, m in meta.items() if m != Meta()}, steps=(step,), paths=paths, source=df)


def _readable(t: T.DataType) -> bool:
    return not isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.DayTimeIntervalType, T.YearMonthIntervalType)) and type(t).__name__ not in ("VariantType", "CalendarIntervalType")


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def local_files(path: str) -> list[str]:
    """Files of a path: an existing file is never a pattern; [ stands for itself."""
    if os.path.isfile(path):
        return [path]
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(glob.escape(path), "**", "*.parquet"), recursive=True))
    return sorted(p for p in glob.glob(path.replace("[", "[[]")))


def escaped(path: str) -> str:
    for c in "[]{}":
        path = path.replace(c, "\\" + c)
    return path


def footers(files: list[str]) -> list[dict[str, str]]:
    import pyarrow.parquet as pq

    def one(f: str) -> dict[str, str]:
        schema = pq.read_schema(f)
        if any("\0" in n for n in schema.names):
            raise VerbError(f"{f}: a column name has a NUL byte")
        if len(set(schema.names)) < len(schema.names):
            raise VerbError(f"{f}: a column name occurs twice in the file")
        return {n: str(t) for n, t in zip(schema.names, schema.types, strict=True)}

    with ThreadPoolExecutor(store.AT_ONCE) as pool:  # many small reads that wait for the disk
        return list(pool.map(one, files))


def read_parquet(spark: SparkSession, path: str | list[str], relaxed: bool = False) -> DataFrame:
    """One file, a list, a pattern or a partitioned tree; all files alike, unless relaxed: then the union by name."""
    paths = [path] if isinstance(path, str) else list(path)
    remote = any(is_remote(p) for p in paths)
    paths = paths if remote else [p.removeprefix("file://") for p in paths]
    files = [f for p in paths for f in (store.parquet_files(spark, p) if remote else local_files(p))]
    if not files:
        raise VerbError(f"file {', '.join(paths)} not found", 601)
    heads = store.footers(spark, files) if remote else footers(files)
    if len({tuple(h) for h in heads}) == 1 and any(len(set(h)) < len(h) for h in heads):
        raise VerbError("a column name occurs twice in the file")
    fold = [{k.lower(): v for k, v in h.items()} for h in heads]
    if all(f == fold[0] for f in fold):
        if remote:
            return spark.read.parquet(*paths)
        base = paths[0] if len(paths) == 1 and os.path.isdir(paths[0]) else None
        return spark.read.parquet(escaped(base)) if base else spark.read.parquet(*[escaped(f) for f in files])
    if not relaxed:
        other = next(k for k, f in enumerate(fold) if f != fold[0])
        names = sorted(n for n in {*fold[0], *fold[other]} if fold[0].get(n) != fold[other].get(n))
        told = "; ".join(f"{n}: {fold[0].get(n, 'absent')} and {fold[other].get(n, 'absent')}" for n in names)
        raise VerbError(f"{files[0]} and {files[other]} differ ({told}); relaxed takes their union")
    groups: dict[tuple, list[str]] = {}
    for f, h in zip(files, heads, strict=True):
        groups.setdefault(tuple(sorted(h.items())), []).append(f)
    frames = [spark.read.parquet(*[escaped(f) for f in g]) for g in groups.values()]
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            kinds[f.name] = f.dataType if f.name not in kinds else _wider(f.name, kinds[f.name], f.dataType)
    out = None
    for df in frames:
        df = df.select(*[F.col(f"`{f.name}`").cast(kinds[f.name]).alias(f.name) for f in df.schema])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _wider(name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    ladder = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]
    if a in ladder and b in ladder:
        top = max(ladder.index(a), ladder.index(b))
        return T.DoubleType() if top >= 4 else ladder[top]
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        raise VerbError(f"{name} is a string in one file and a number in another", 109)
    return T.DoubleType()


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header; the delimiter is found in its first lines, the types by Spark."""
    local = path.removeprefix("file://")
    if not is_remote(path) and not glob.glob(local) and not os.path.exists(local):
        raise VerbError(f"file {path} not found", 601)
    sep = "\t" if path.lower().endswith((".tsv", ".tab")) else None
    if sep is None:
        start = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())
        try:
            sep = csv.Sniffer().sniff(start, delimiters=",;\t|").delimiter
        except csv.Error:
            sep = ","
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep, quote='"', escape='"', multiLine=True)


def read_pandas(spark: SparkSession, frame) -> DataFrame:
    frame = frame.copy()
    for n in frame.columns:
        if str(frame[n].dtype) == "category" or frame[n].dtype == object:
            frame[n] = frame[n].astype(object).where(frame[n].notna(), None)
            frame[n] = frame[n].map(lambda x: None if x is None else str(x))
    frame.columns = [str(c) for c in frame.columns]
    return spark.createDataFrame(frame)


def use(spark: SparkSession, path: str | list[str], names: str = "", relaxed: bool = False) -> View:
    """A lazy view of a file; the suffix tells the format."""
    first = path if isinstance(path, str) else path[0]
    low = first.lower()
    if low.endswith(TEXT):
        df = read_text(spark, first)
    elif low.endswith(".dta"):
        import pandas as pd

        df = read_pandas(spark, pd.read_stata(first, convert_categoricals=False))
    elif low.endswith((".xls", ".xlsx")):
        try:
            import openpyxl  # noqa: F401
            import pandas as pd
        except ImportError:
            raise VerbError("reading Excel files needs openpyxl", 199) from None
        df = read_pandas(spark, pd.read_excel(first))
    else:
        df = read_parquet(spark, path, relaxed)
    v = boundary(df, (path,) if isinstance(path, str) else tuple(path), f"use {path}")
    side = sidecar(first, spark)
    if side:
        labels = {k: {int(a): b for a, b in m.items()} for k, m in side.get("value_labels", {}).items()}
        order = tuple((n, False) for n in side.get("sortedby", ()) if n in v.names)
        v = changed(v, order=order, value_labels=labels, data_label=side.get("data_label", ""), notes=tuple(side.get("notes", ())))
    if names:
        from ..operators.columns import keep

        v = keep(v, names)
    return v


def sidecar(path: str, spark: SparkSession | None = None) -> dict:
    """Labels, notes and sort that a saved view left beside its data; nothing if there is none or it can't be read."""
    try:
        if is_remote(path):
            got = json.loads((spark and not set("*?{[") & set(path) and store.read_text(spark, f"{path.rstrip('/')}/_tabloom.json")) or "null")
            return got if isinstance(got, dict) else {}
        with open(os.path.join(path.removeprefix("file://"), "_tabloom.json")) as f:
            got = json.load(f)
        return got if isinstance(got, dict) else {}
    except (OSError, ValueError):
        return {}


def describe_file(path: str, spark: SparkSession | None = None) -> dict:
    """Rows, columns, row groups, files and types, from the footers alone; of a remote path by Spark's file systems."""
    import pyarrow.parquet as pq

    far = is_remote(path) and spark is not None
    path = path if far else path.removeprefix("file://")
    files = store.parquet_files(spark, path) if far else local_files(path)
    if not files:
        raise VerbError(f"file {path} not found", 601)
    if far:
        counts, types = store.sizes(spark, files), store.footers(spark, files[:1])[0]
    else:
        with ThreadPoolExecutor(store.AT_ONCE) as pool:
            counts = [(m.num_rows, m.num_row_groups) for m in pool.map(pq.read_metadata, files)]
        types = footers(files[:1])[0]
    return {"rows": sum(n for n, _ in counts), "columns": len(types), "row_groups": sum(g for _, g in counts), "files": len(files), "types": types, "metadata": bool(sidecar(path, spark))}


def path_of(path: str) -> dict:
    return {"path": os.path.abspath(path), "exists": os.path.exists(path)}
