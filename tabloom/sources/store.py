"""Files of any store that Spark reaches, through the Hadoop file system in Spark's own JVM."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

#: Footers asked for at once.
AT_ONCE = 32


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return bool(fs.exists(where))


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def claim(spark: SparkSession, path: str) -> bool:
    """Make an empty file unless there is one: of two writers one succeeds."""
    fs, where = _at(spark, path)
    try:
        return bool(fs.createNewFile(where))
    except Exception as e:  # a store whose create fails instead of saying no
        if "exists" in str(e).lower():
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """Data files of a file, a pattern or a tree."""
    fs, where = _at(spark, path)
    out: list[str] = []
    for status in fs.globStatus(where) or []:
        if status.isFile():
            out.append(status.getPath().toString())
            continue
        found = fs.listFiles(status.getPath(), True)
        while found.hasNext():
            name = found.next().getPath()
            if name.getName().endswith(".parquet") and not name.getName().startswith(("_", ".")):
                out.append(name.toString())
    return sorted(out)


def sizes(spark: SparkSession, files: list[str]) -> list[tuple[int, int]]:
    """Rows and row groups of each file, from its footer."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def one(name: str) -> tuple[int, int]:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            return reader.getRecordCount(), reader.getRowGroups().size()
        finally:
            reader.close()

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(one, files))


def footers(spark: SparkSession, files: list[str]) -> list[dict[str, str]]:
    """Names and types of the columns of each file, in their order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def one(name: str) -> dict[str, str]:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            schema = reader.getFooter().getFileMetaData().getSchema()
            lines = [x.strip().rstrip(";") for x in schema.toString().split("\n")[1:-2]] if schema.getFieldCount() else []
            if len(lines) == schema.getFieldCount():  # flat: one line a column, "optional int64 name (type)"
                return {schema.getFieldName(k): line.replace(f" {schema.getFieldName(k)}", "", 1) for k, line in enumerate(lines)}
            return {schema.getFieldName(k): schema.getType(k).toString() for k in range(schema.getFieldCount())}
        finally:
            reader.close()

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(one, files))
