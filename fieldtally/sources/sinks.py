"""Overwriting sinks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.zorder import z_key


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which the list expressions read back."""
    nested = {
        f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    }
    return df.withColumns(nested) if nested else df


#: Rows of one CSV file: with line breaks inside quotes a file is read by one task, so files must not grow with the table.
CSV_ROWS = 200_000
#: Rows of one file in Z-order: a task sorts them.
SORTED_ROWS = 1_000_000


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", by_year: bool = False, date_col: str = "date", csv_rows: int = CSV_ROWS,
    compression: str | None = None,
) -> DataFrame:
    """Replace the table at ``path`` and read it back; ``by_year`` partitions the files by the year of the date.

    No CSV file gets more than ``csv_rows`` rows. ``compression`` is by default that of the format: CSV files are plain."""
    columns = df.columns
    if fmt == "csv":
        df = flat_for_csv(df)
    if by_year:
        df = df.withColumn("year", F.year(date_col))
    writer = df.write.mode("overwrite").format(fmt)
    if by_year:
        writer = writer.partitionBy("year")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("maxRecordsPerFile", csv_rows)
    if compression:
        writer = writer.option("compression", compression)
    writer.save(path)
    reader = df.sparkSession.read.schema(df.schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.load(path).select(*[F.col(f"`{c}`") for c in columns])


def write_in_z_order(
    df: DataFrame, path: str, lat_col: str = "latitude", lon_col: str = "longitude", key: str = "z", files: int | None = None,
    sorted_rows: int = SORTED_ROWS, **options: str
) -> DataFrame:
    """Replace the Parquet table at ``path`` by the rows in the order of ``key``, a Z-order key of their point, and read it back.

    Rows are dealt to files by ranges of the key, so files do not overlap; rows without a point come first.
    ``files`` defaults to the shuffle partitions. There are more where these would hold more than ``sorted_rows`` rows on
    average, for a task sorts a file; that takes a count. ``options`` go to the writer (row group and page sizes).
    """
    least = math.ceil(df.count() / sorted_rows)
    if least > (files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))):
        files = least
    keyed = df.withColumn(key, z_key(F.col(lat_col), F.col(lon_col)))
    dealt = keyed.repartitionByRange(files, key) if files else keyed.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(keyed.schema).parquet(path)
