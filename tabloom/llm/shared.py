"""What the operators of this subpackage share: reading, cutting lineage, words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import glob
import os
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where all of Spark is in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tabloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders this process has written and nobody has dropped yet.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    if not _MADE:
        atexit.register(_drop_all)
    path = f"{shared_folder(spark)}/tabloom-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """A mark: how many folders have been written so far."""
    return len(_MADE)


def drop_made(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete the folders written between two marks; of use once nothing lazy reads them any more."""
    for path in _MADE[since:until]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _MADE[since:until]


def _drop_all() -> None:
    """At the end of the process, while Spark still answers."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop_made(spark)
        except Exception:  # noqa: BLE001  the JVM is gone: its folder is the cluster's to clear
            return


def cut(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint; for narrow frames that are read again at once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    """Partitions to deal rows to: the session's own setting, which follows the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lane(spark: SparkSession, n: int, place: F.Column) -> F.Column:
    """A number for each of the places 0 to n - 1 that repartition(n, ...) sends to the partition of that number.

    Spark deals rows by a hash of their key; a few whole numbers are hashed here to find one for each partition,
    so ranges of known bounds each get a task of their own, in their order, without a sampling run.
    """
    tried = spark.range(40 * n + 400).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
    number = {r["p"]: r["k"] for r in tried.collect()}  # n rows
    listed = F.split(F.lit(",".join(str(number.get(k, k)) for k in range(n))), ",")
    return F.element_at(listed, place + 1).cast("int")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns an operator reads, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def byte_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text in UTF-8: bytes know no other letters and no other white space than the word rule's."""
    return text.lower().split() if text else []


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words: runs without ASCII white space; null has none."""
    if not text:
        return []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if _ODD_SPACE.search(low):
        return [w.decode("utf-8", "surrogatepass") for w in byte_words(low.encode("utf-8", "surrogatepass"))]
    return low.split()


#: Characters at which str.split() cuts though the word rule does not.
_ODD_SPACE = re.compile("[" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \t\n\x0b\x0c\r") + "]")


def one_thread() -> None:
    """Matrix products of this process stay on its own core: those of the models here are too small to share, and waiting threads burn time."""
    for lib in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(lib)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def crc_of_id(doc_id: int | None) -> int:
    """crc32 of the id as decimal text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode())


def crc_column(name: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary"))


_KEPT: dict = {}


def kept(key, build=None):
    """What a Python worker keeps between tasks: one thing at a time, so that operators run one after another don't add up.

    Without build, what another operator kept is let go.
    """
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            given_back()
        if build:
            _KEPT[key] = build()
    return _KEPT.get(key)


def given_back() -> None:
    """Memory that this process has freed goes back to the system: a Python worker lives as long as its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def in_pieces(rows, weight, limit: int):
    """Consecutive rows in lists of at most `limit` weight, one row at least: bounds a batch of very long texts."""
    held, total = [], 0
    for row in rows:
        w = weight(row)
        if held and total + w > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += w
    if held:
        yield held
