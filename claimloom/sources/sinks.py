"""Writers for the tables of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tables(tables: dict[str, DataFrame], folder: str, force: bool = False, as_json: bool = False) -> None:
    """A folder for each table; an existing one is an error unless force. JSON export is one record a line."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite" if force else "errorifexists")
        (writer.json if as_json else writer.parquet)(f"{folder}/{name}")


def write_run(tables: dict[str, DataFrame], folder: str, force: bool = False, as_json: bool = False) -> None:
    """All tables of a run in one folder: an existing folder is an error unless force, before anything is written.

    With force, tables of an earlier run that this one does not have go; what Spark has not written stays.
    """
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(path)
    if there and not force:
        raise FileExistsError(folder)
    write_tables(tables, folder, force, as_json)
    for status in fs.listStatus(path) if there else ():
        table = status.getPath()
        if table.getName() not in tables and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(table, "_SUCCESS")):
            fs.delete(table, True)
