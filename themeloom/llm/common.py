"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.joins import BROADCAST_ROWS
from themeloom.session import materialise, materialise_counted

ROWS_OF_A_FILE = 1 << 40


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def full_text(text: str | Column) -> Column:
    """The text, a null read as the empty one."""
    return F.coalesce(text, F.lit(""))


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def in_fold(doc_id: str | Column, parts: int, part: int) -> Column:
    """Whether crc32 of ``doc_id`` as text leaves ``part``; a null id is in no fold."""
    crc = F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), "UTF-8"))
    return F.coalesce(F.pmod(crc, F.lit(parts)) == part, F.lit(False))


def with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row that stays the same however often it is read.

    A stored table has one already: the file and the place in it. Only the files are listed and
    numbered, no row is copied. Any other table is stored once with its numbers.
    """
    file, at, number = (fresh(docs, c) for c in ("_file", "_at", "_number"))
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    except AnalysisException:
        return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    files = placed.select(file).distinct().withColumn(number, F.row_number().over(Window.orderBy(file)).cast("bigint"))
    files, n = materialise_counted(files, "files")
    placed = placed.join(F.broadcast(files) if n <= BROADCAST_ROWS else files, file)
    return placed.select(*docs.columns, (F.col(number) * ROWS_OF_A_FILE + F.col(at)).alias(name))
