"""Typed delimited text, two-column relations, parquet, and the sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_type(name: str) -> T.DataType:
    """int*, long*, dec* and char(n) by name; anything else raises ValueError."""
    low = name.strip().lower()
    for start, kind in (("int", T.IntegerType()), ("long", T.LongType()), ("dec", T.DoubleType())):
        if low.startswith(start):
            return kind
    if re.fullmatch(r"char\(\d+\)", low):
        return T.StringType()
    raise ValueError(f"unknown type {name!r}")


def schema_of(types: list[str], names: list[str] | None = None) -> T.StructType:
    return T.StructType([T.StructField(n, parse_type(t)) for n, t in zip(names or [f"c{i + 1}" for i in range(len(types))], types, strict=True)])


def _head(spark: SparkSession, path: str) -> bytes:
    """The first three bytes of the first file of a path that isn't empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(where) or []:
        for f in fs.listStatus(found.getPath()):
            name = f.getPath().getName()
            if f.isFile() and f.getLen() and not name.startswith(("_", ".")) and not name.endswith((".bz2", ".gz")):
                stream = fs.open(f.getPath())
                try:
                    return bytes(b for b in (stream.read() for _ in range(min(3, f.getLen()))) if b >= 0)
                finally:
                    stream.close()
    return b""


def _bunzipped(spark: SparkSession, path: str) -> DataFrame:
    """The lines of bzip2 files, a file in each task, unpacked by pieces of 1 MB; several streams in one file follow each other."""

    def lines(batches):  # noqa: ANN001, ANN202
        import bz2
        import io

        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                with bz2.open(io.BytesIO(content.as_py())) as unpacked:
                    while got := unpacked.readlines(1 << 20):
                        yield pa.RecordBatch.from_pydict({"value": [g.rstrip(b"\r\n").decode("utf-8", "replace") for g in got]})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string").where("value != ''")


def read_delimited(spark: SparkSession, path: str, types: list[str], names: list[str] | None = None, sep: str = "|", compression: str | None = None) -> DataFrame:
    """Typed rows of separated text. An empty field is null, and a field that doesn't parse is null as well; quotes are text, and a
    separator at the end of a line adds no column. `.bz2` and `.gz` files are opened by their extension; bzip2 under another name is known
    by how the first file begins (all files of a path are of one kind; each is then read by one task, 2 GB at most), gzip raises ValueError."""
    schema = schema_of(types, names)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    reader = spark.read.schema(text).option("mode", "PERMISSIVE")
    begins = b"" if path.endswith((".bz2", ".gz")) else _head(spark, path)
    if begins[:2] == b"\x1f\x8b":
        raise ValueError(f"{path} is gzip by content; give it the extension .gz")
    source = _bunzipped(spark, path) if begins == b"BZh" else path
    if isinstance(source, DataFrame):
        fields = F.split("value", re.escape(sep))
        raw = source.select(*[F.nullif(F.get(fields, F.lit(i)), F.lit("")).alias(f.name) for i, f in enumerate(text)])
    else:
        raw = (reader.option("compression", compression) if compression else reader).option("quote", "").csv(path, sep=sep)
    return raw.select(*[F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in schema])


def read_relation(spark: SparkSession, path: str, n: int | None = None, wide: bool = True) -> DataFrame:
    """(key, payload) of text with a header line and `key payload`, `key,payload` or `key` rows; a payload that isn't there is 0.

    n keeps that many rows at most; a shorter file gives what it has. Negative keys are kept.
    """
    kind = "bigint" if wide else "int"
    lines = spark.read.option("header", True).option("quote", "").schema("line string").csv(path, sep="\u0001").where(F.trim("line") != "")
    parts = F.split(F.trim("line"), r"[\s,]+")
    rows = lines.select(F.expr("1").alias("one"), parts.alias("p")).selectExpr(f"try_cast(p[0] as {kind}) as key", f"coalesce(try_cast(get(p, 1) as {kind}), cast(0 as {kind})) as payload")
    return rows if n is None else rows.limit(n)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_relation(df: DataFrame, path: str) -> None:
    """`KEY VAL` with a header and a blank between."""
    df.select(F.col("key").alias("KEY"), F.col("payload").alias("VAL")).write.mode("overwrite").csv(path, sep=" ", header=True)


def write_result(df: DataFrame, path: str, ordered: bool = False) -> None:
    """Rows of a join, a blank between fields, in any order or sorted by all columns."""
    (df.orderBy(*df.columns) if ordered else df).write.mode("overwrite").csv(path, sep=" ")


def printed(df: DataFrame) -> Column:
    """A row as text: fields with | between, doubles with two digits."""
    return F.concat_ws("|", *[F.format_string("%.2f", f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).cast("string") for f in df.schema])
