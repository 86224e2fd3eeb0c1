"""Reading and writing tables with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What an unquoted empty field is read as on its way to NULL; a quoted one stays ''.
NULL_MARK = "\u0001"
# The backslash comes first on the way out and last on the way back.
LINE_CODES = [("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r")]


def read_table(
    spark: SparkSession,
    source: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    header: bool = True,
    multiline: bool = False,
    index: str | None = None,
    id_col: str = "id",
    escaped: bool = False,
) -> DataFrame:
    """Read a CSV or parquet path, or a catalog table (``fmt='table'``).

    CSV needs ``schema``: inference would read the data twice and guess types.
    Doubled quotes inside a quoted field are read as one quote. ``multiline``
    allows line breaks in quoted fields but makes each file one task, so it is
    off unless asked for. ``escaped`` restores what ``write_table`` escaped, which
    keeps one row on one line and the file splittable.

    ``index`` says what to do with a leading index column: ``'drop'`` removes it,
    ``'rename'`` calls it ``id_col``.
    """
    if fmt == "table":
        df = spark.table(source)
    elif fmt == "csv":
        if schema is None:
            raise ValueError("a CSV source needs an explicit schema")
        df = spark.read.schema(schema).csv(
            source,
            header=header,
            multiLine=multiline,
            quote='"',
            escape='"',
            nullValue=NULL_MARK,
            emptyValue="",
            mode="FAILFAST",
        )
        df = _on_strings(df, reversed([(b, a) for a, b in LINE_CODES])) if escaped else df
    elif fmt == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.parquet(source)
    else:
        raise ValueError(f"unknown format {fmt!r}")

    if index == "drop":
        return df.drop(df.columns[0])
    if index == "rename":
        return df.withColumnRenamed(df.columns[0], id_col)
    return df


def _on_strings(df: DataFrame, codes: Iterable[tuple[str, str]]) -> DataFrame:
    """Every string column with each first text of ``codes`` replaced by the second, in turn."""
    changed = {}
    codes = list(codes)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            column = F.col(f"`{field.name}`")
            for a, b in codes:
                column = F.replace(column, F.lit(a), F.lit(b))
            changed[field.name] = column
    return df.withColumns(changed)


def write_table(
    df: DataFrame, target: str, fmt: str = "parquet", header: bool = True, path: str | None = None, escaped: bool = False
) -> None:
    """Overwrite a CSV or parquet folder, or a catalog table (``fmt='table'``).

    In CSV an empty string is written quoted and NULL is not, so both come back.
    ``escaped`` writes line breaks and backslashes of strings as backslash codes.
    """
    if fmt == "csv" and escaped:
        df = _on_strings(df, LINE_CODES)
    writer = df.write.mode("overwrite")
    if fmt == "table":
        if path:
            writer = writer.option("path", path)
        writer.saveAsTable(target)
    elif fmt == "csv":
        writer.csv(target, header=header, quote='"', escape='"')
    elif fmt == "parquet":
        writer.parquet(target)
    else:
        raise ValueError(f"unknown format {fmt!r}")
