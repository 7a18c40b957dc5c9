"""Saving a view: back to dates and times, written aside, counted, then put in place."""

from __future__ import annotations

import fnmatch
import json
import os
import shutil
import uuid
import warnings

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import VerbError
from ..functions.values import BIG, BOUNDS, EPOCH_MS, FLOAT_MAX, date_of_days
from ..operators.columns import check_ranges
from ..plans.view import Meta, View
from . import store
from .readers import META_KEY, is_remote

#: Codecs that a file can be written with.
CODECS = ("snappy", "zstd", "gzip", "lz4", "lz4_raw", "brotli", "uncompressed")
#: Names of the levels 0 to 9 of gzip.
GZIP_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


def to_disk(v: View) -> DataFrame:
    """The view's rows in its order: %td numbers as dates, %tc as timestamps, other periods as integers."""
    df = v.sorted_df()
    cols = []
    for n in v.names:
        m, c, t = v.meta.get(n, Meta()), F.col(f"`{n}`"), v.type_of(n)
        if isinstance(t, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif m.fmt.startswith("%td"):
            c = date_of_days(F.floor(c.cast("double") + 0.5))
        elif m.fmt.startswith("%tc") and m.fmt != "%tcHH:MM:SS":
            c = F.timestamp_millis(F.floor(c.cast("double") + 0.5).cast("bigint") - F.lit(EPOCH_MS)).cast("timestamp_ntz")
        elif m.fmt[:3] in ("%tC", "%tm", "%tq", "%th", "%tw", "%ty", "%tb"):
            c = F.floor(c.cast("double") + 0.5).cast("bigint" if m.fmt.startswith("%tC") else "int")
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            c = F.when(F.abs(c) < F.lit(BIG), c)
        told = {k: x for k, x in (("storage", m.storage), ("fmt", m.fmt), ("label", m.label), ("value_label", m.value_label), ("chars", m.chars)) if x}
        cols.append(c.alias(n, metadata={META_KEY: json.dumps(told)} if told else {}))
    return df.select(*cols)


def fractional_dates(v: View) -> list[str]:
    """Names of date and time variables whose values are not whole (they are rounded when saved)."""
    names = [n for n, m in v.meta.items() if m.fmt.startswith("%t") and v.is_float(n)]
    if not names:
        return []
    row = v.df.agg(*[F.max(F.floor(F.col(f"`{n}`") + 0.5) != F.col(f"`{n}`")).alias(n) for n in names]).first()
    return [n for n in names if row[n]]


def check_storage(v: View) -> None:
    """Refuse a view with values outside the storage types or the calendar that its variables declare."""
    bad = {}
    for n, m in v.meta.items():
        if n not in v.names or v.kinds[n] == "s":
            continue
        x = F.col(f"`{n}`").cast("double")
        if m.storage in BOUNDS:
            bad[n] = ~x.between(*BOUNDS[m.storage])
        elif m.storage == "float":
            bad[n] = F.abs(x) > FLOAT_MAX
        elif m.fmt.startswith("%td"):
            bad[n] = date_of_days(x).isNull() & x.isNotNull()
    if not bad:
        return
    row = v.df.agg(*[F.count(F.when(c, 1)).alias(f"b{i}") for i, c in enumerate(bad.values())]).first()
    told = [f"{n}: {row[f'b{i}']}" for i, n in enumerate(bad) if row[f"b{i}"]]
    if told:
        raise VerbError(f"values outside the range of their storage type ({'; '.join(told)}); nothing is loaded", 459)


def source_notes(v: View) -> list[str]:
    """What the source holds that was changed on the way in: counted in one pass over the columns that are still there."""
    if v.source is None:
        return []
    origin = {(v.meta.get(n, Meta()).source or n): n for n in v.names}
    counts, out = {}, []
    for f in v.source.schema:
        if f.name not in origin:
            continue
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.FloatType, T.DoubleType)):
            counts[f.name] = (F.abs(c) >= F.lit(BIG)) & ~F.isnan(c), "beyond the largest number (or infinite): missing"
        elif isinstance(t, T.StringType):
            counts[f.name] = c.contains("\0"), "with a NUL character"
        elif isinstance(t, T.TimestampType):
            counts[f.name] = F.unix_micros(c) % 1000 != 0, "finer than a millisecond: cut"
        elif isinstance(t, T.LongType):
            counts[f.name] = F.abs(c) > F.lit(2**53), "beyond 2^53: rounded"
        elif isinstance(t, T.DecimalType):
            out.append(f"{origin[f.name]}: decimals become doubles")
    if counts:
        row = v.source.agg(*[F.count(F.when(c, 1)).alias(f"b{i}") for i, (c, _) in enumerate(counts.values())]).first()
        out += [f"{origin[n]}: {row[f'b{i}']} values of the source are {what}" for i, (n, (_, what)) in enumerate(counts.items()) if row[f"b{i}"]]
    return out


def clashes(v: View, dest: str) -> bool:
    """Whether the destination is, holds or lies in one of the view's own sources."""
    dest = os.path.abspath(dest.removeprefix("file://"))
    for p in v.paths:
        if is_remote(p):
            if p.rstrip("/") == dest:
                return True
            continue
        p = os.path.abspath(p.removeprefix("file://"))
        base = p.split("*")[0].split("?")[0]
        if p == dest or fnmatch.fnmatchcase(dest, p.replace("[", "[[]")) or p.startswith(dest + os.sep) or dest.startswith(p + os.sep) or (base != p and os.path.dirname(base) == dest):
            return True
    return False


def save(v: View, dest: str, replace: bool = False, partition_by: str = "", compression: str = "snappy", level: int | None = None, chunk: int | None = None) -> int:
    """Write Parquet at dest, all or nothing; the number of rows written."""
    if compression not in CODECS:
        raise VerbError(f"unknown compression {compression}")
    if compression == "brotli":
        raise VerbError("this Spark has no brotli codec: take zstd")
    if chunk is not None and chunk < 1:
        raise VerbError("chunk() takes at least one row")
    if level is not None and not {"zstd": 1 <= level <= 22, "gzip": 0 <= level <= 9}.get(compression, False):
        raise VerbError("a compression level is 1 to 22 of zstd or 0 to 9 of gzip")
    keys = v.expand(partition_by, wild=False) if partition_by else []
    if keys and len(keys) == len(v.names):
        raise VerbError("partition_by() would leave no variable")
    if clashes(v, dest):
        raise VerbError(f"{dest} is a source of this view", 602)
    check_ranges(v)
    rounded = fractional_dates(v)
    if rounded:
        warnings.warn(f"dates and times are saved whole; rounded: {', '.join(rounded)}", stacklevel=2)
    # the rows are counted as they are written, so the view runs once
    seen = Observation()
    df = to_disk(v)
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", compression)
    if chunk:
        writer = writer.option("parquet.block.row.count.limit", chunk)
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", level) if compression == "zstd" else writer.option("zlib.compress.level", GZIP_LEVELS[level])
    if keys:
        writer = writer.partitionBy(*keys)
    spark = df.sparkSession
    ascending = [] if any(d for _, d in v.order) else [n for n, _ in v.order if not n.startswith("__o")]
    side = json.dumps({"sortedby": ascending, "value_labels": v.value_labels, "data_label": v.data_label, "notes": v.notes})

    def verified(path: str) -> int:
        got, wanted = spark.read.schema(df.schema).parquet(path).count(), seen.get["n"]
        if got != wanted:
            raise VerbError(f"{got} rows were written of {wanted}", 692)
        return wanted

    if is_remote(dest):  # the store's own committer publishes the files; what goes beside them is written through the store too
        dest = dest.rstrip("/")
        if store.exists(spark, dest) and not replace:
            raise VerbError(f"file {dest} already exists", 602)
        if not store.claim(spark, dest + ".lock"):
            raise VerbError(f"{dest} is being written by another session", 608)
        try:
            writer.mode("overwrite" if replace else "errorifexists").parquet(dest)
            n = verified(dest)
            store.write_text(spark, f"{dest}/_tabloom.json", side)
            return n
        finally:
            store.drop(spark, dest + ".lock")
    dest = os.path.abspath(dest.removeprefix("file://"))
    if os.path.exists(dest) and not replace:
        raise VerbError(f"file {dest} already exists", 602)
    lock, aside = dest + ".lock", f"{dest}.{uuid.uuid4().hex}"
    try:
        os.mkdir(lock)
    except FileExistsError:
        raise VerbError(f"{dest} is being written by another session", 608) from None
    try:
        writer.parquet(aside)
        wanted = verified(aside)
        with open(os.path.join(aside, "_tabloom.json"), "w") as f:
            f.write(side)
        if os.path.exists(dest):
            old = dest + ".old-" + uuid.uuid4().hex
            os.rename(dest, old)
            os.rename(aside, dest)
            shutil.rmtree(old) if os.path.isdir(old) else os.remove(old)
        else:
            os.rename(aside, dest)
        return wanted
    finally:
        shutil.rmtree(aside, ignore_errors=True)
        shutil.rmtree(lock, ignore_errors=True)


def collect(v: View):
    """The view as a pandas DataFrame, in its order: strings '' and numbers NaN where missing.

    A value that the variable's storage type cannot hold refuses the whole load; what a
    number or string cannot tell of the source is noted.
    """
    check_ranges(v)
    check_storage(v)
    for note in source_notes(v):
        warnings.warn(note, stacklevel=2)
    return v.sorted_df().toPandas()
