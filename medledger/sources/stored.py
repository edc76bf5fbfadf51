"""Stored forms of the six tables: folders by month, tables of the catalog, and what file footers tell.

``write_by_month`` keeps a fact table in one folder a month, so a report over a range of dates lists and reads
those months only (``reports`` adds the month filter where the column is there). ``create_tables`` declares the
tables in the catalog with their VARCHAR limits, optionally bucketed by the key that the reports join and group by.
``footer_counts`` and ``footer_extent`` answer counts and least and greatest values from Parquet footers.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medledger.operators.reports import month_column, month_of, row_counts
from medledger.sources.schemas import LENGTH_LIMITS, TABLES

# ---------------------------------------------------------------- by month


def write_by_month(df: DataFrame, path: str, date_column: str, key: str, mode: str = "errorifexists") -> None:
    """Write ``df`` under ``path`` with one folder for each month of ``date_column`` (``<date_column>_Month``, yyyymm).

    Rows are ranged by (month, ``key``): a month of a third of all rows is written by many tasks, and a task writes few
    months. ``mode='append'`` adds files to the months of the new rows. ``mode='replace'`` replaces the months
    that ``df`` has rows of, whole, and leaves the others as they are (dynamic partition overwrite); ``df`` may be computed
    from the same folder if it was materialised before. A null date has a folder of its own, which no range of dates reads.
    """
    month = month_column(date_column)
    rows = df.withColumn(month, month_of(F.col(date_column))).repartitionByRange(month, key)
    w = rows.write.partitionBy(month)
    if mode == "replace":
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode(mode)
    w.parquet(path)


def months_touched(df: DataFrame, changed: DataFrame, date_column: str) -> DataFrame:
    """The rows of ``df`` (read from a folder by month) in the months that ``changed`` has rows of."""
    month = month_column(date_column)
    there = changed.select(month_of(F.col(date_column)).alias(month)).distinct()
    return df.join(there, df[month].eqNullSafe(there[month]), "left_semi")


# ---------------------------------------------------------------- footers


def _footer_session(spark: SparkSession) -> SparkSession:
    """A session of its own settings (same context) whose Parquet reader takes aggregates from footers."""
    own = spark.newSession()
    v1 = [s for s in own.conf.get("spark.sql.sources.useV1SourceList").split(",") if s.strip() != "parquet"]
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(v1))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def _at_least_zero(count: str) -> Column:
    """A pushed count of no row groups comes as NULL in a column declared without NULLs, where ``coalesce`` is optimised away."""
    return F.greatest(F.col(count), F.lit(0).cast("bigint"))


def footer_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(Table_Name, Record_Count) of stored Parquet tables, by name; one row a file is read, no data pages."""
    own = _footer_session(spark)
    counts = row_counts({name: own.read.parquet(path) for name, path in paths.items()})
    return counts.withColumn("Record_Count", _at_least_zero("Record_Count"))


def footer_extent(spark: SparkSession, path: str, column: str) -> DataFrame:
    """rows, lowest and highest of a number or date column of a stored Parquet table (nulls are left out of the extent).

    Footers answer numbers and dates. Spark does not take text or decimal values from them: such a column is read.
    """
    df = _footer_session(spark).read.parquet(path)
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("lowest"), F.max(column).alias("highest"))
    return found.withColumn("rows", _at_least_zero("rows"))


# ---------------------------------------------------------------- tables of the catalog

#: The key that the reports join and group a table by.
BUCKET_KEYS = {"PATIENT": "Patient_ID", "BILLING": "Patient_ID", "LABTEST": "Patient_ID", "PRESCRIPTION": "Patient_ID",
               "DOCTOR": "Doctor_ID", "APPOINTMENT": "Doctor_ID"}


def declaration(table: str) -> str:
    """The column list of a table: VARCHAR where a length is declared, NOT NULL as declared."""
    limits = LENGTH_LIMITS[table]
    return ", ".join(
        f"{f.name} {f'VARCHAR({limits[f.name]})' if f.name in limits else f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
        for f in TABLES[table].fields)


def create_tables(spark: SparkSession, database: str, location: str | None = None, names: Iterable[str] = TABLES,
                  buckets: int | None = None) -> None:
    """CREATE DATABASE and its tables, empty, under ``location`` (default: the warehouse).

    With ``buckets`` each table is bucketed by ``BUCKET_KEYS`` into that many, so reports that group and join by that key need no
    shuffle. A bucket is read by one task: choose it where no key holds a large share of the rows. Where one does, leave
    ``buckets`` out, or set ``spark.sql.sources.bucketing.enabled=false`` to read the same tables split by size, with a shuffle of partial sums.
    """
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    for name in names:
        layout = f" CLUSTERED BY ({BUCKET_KEYS[name]}) INTO {buckets} BUCKETS" if buckets else ""
        spark.sql(f"CREATE TABLE {database}.{name} ({declaration(name)}) USING parquet{layout}")


def insert_rows(spark: SparkSession, database: str, table: str, rows: DataFrame) -> None:
    """INSERT INTO with named columns: an omitted one takes its default or NULL; a text beyond its column's length
    fails the insert (EXCEED_LIMIT_LENGTH), which then adds nothing. NOT NULL is not held by a Parquet table: rows go through
    ``tables.append_rows`` or ``insert_each`` first where that is needed. Rows of a hot key are written by the tasks that have them."""
    names = ", ".join(rows.columns)
    spark.sql(f"INSERT INTO {database}.{table} ({names}) SELECT {names} FROM {{rows}}", rows=rows)


def add_column(spark: SparkSession, database: str, table: str, name: str = "version", dtype: str = "INT", default: str = "1") -> None:
    """ALTER TABLE .. ADD COLUMN with a default, if the table lacks it: rows stored before read the default, no file is rewritten."""
    if name.lower() not in [c.lower() for c in spark.table(f"{database}.{table}").columns]:
        spark.sql(f"ALTER TABLE {database}.{table} ADD COLUMNS ({name} {dtype} DEFAULT {default})")

