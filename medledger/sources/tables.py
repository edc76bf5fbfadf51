"""Loading, schema evolution, appends and snapshot writes for the six tables.

Parquet tables have no UPDATE/DELETE/MERGE, so every change operator returns
a new DataFrame; ``write_snapshot`` stores it in a new folder (never the
folder being read).
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Mapping, Sequence
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medledger.operators.quality import Rule, enforce, tag_violations
from medledger.sources.schemas import FOREIGN_KEYS, LENGTH_LIMITS, PRIMARY_KEYS, TABLES, not_null_columns


def load_tables(spark: SparkSession, path: str, names: Iterable[str] = TABLES, fmt: str = "parquet",
                ) -> dict[str, DataFrame]:
    """Read each table from ``path/<NAME>`` and check it against its declared schema.

    Declared columns must exist with the declared type; an optional
    ``version`` column is kept when present.
    """
    out = {}
    for name in names:
        df = spark.read.format(fmt).load(f"{path.rstrip('/')}/{name}")
        declared = TABLES[name]
        have = {f.name: f.dataType for f in df.schema.fields}
        missing = [f.name for f in declared.fields if f.name not in have]
        wrong = [f.name for f in declared.fields if f.name in have and have[f.name] != f.dataType]
        if missing or wrong:
            raise ValueError(f"{name}: missing columns {missing}, wrong types {wrong}")
        cols = [f.name for f in declared.fields] + (["version"] if "version" in have else [])
        out[name] = df.select(*cols)
    return out


def tables_present(spark: SparkSession, names: Sequence[str], database: str | None = None) -> DataFrame:
    """(name, present) for each expected table name, from the catalog (case-insensitive)."""
    listed = {t.name.lower() for t in spark.catalog.listTables(database)}
    rows = [(n, n.lower() in listed) for n in names]
    return spark.createDataFrame(rows, "name string, present boolean")


def ensure_column(df: DataFrame, name: str, dtype: T.DataType | str, default) -> DataFrame:
    """Add ``name`` with ``default`` for every existing row when the column is absent."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(default).cast(dtype))


#: Columns with a default, and its value (DDL ``DEFAULT``).
DEFAULTS = {"version": 1}


def append_rows(df: DataFrame, rows: DataFrame | Sequence[tuple] | Sequence[Mapping], table: str | None = None,
                rules: Sequence[Rule] = (), positional: bool = False) -> DataFrame:
    """INSERT: positional tuples use the table's column order; mappings or a DataFrame name their columns
    (with ``positional``, a DataFrame's columns are taken in the table's order, whatever their names).

    An omitted column takes its default (``version``: 1) or becomes NULL. With ``table`` the declared
    NOT NULL columns are enforced: an omitted one is refused at once, a NULL in one fails the query,
    as do ``rules`` (``billing_rules()`` for bills, ``appointment_date_rules(as_of)`` for appointments, like
    the insert triggers). A failed insert appends nothing.
    """
    spark = df.sparkSession
    if isinstance(rows, DataFrame):
        if positional and len(rows.columns) != len(df.columns):
            raise ValueError(f"{len(df.columns)} columns are needed, {len(rows.columns)} given")
        new = rows.toDF(*df.columns) if positional else rows
    elif rows and isinstance(rows[0], Mapping):
        fields = [f for f in df.schema.fields if any(f.name in r for r in rows)]
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        new = spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], schema)
    else:
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        new = spark.createDataFrame(list(rows), schema)
    required = not_null_columns(table) if table else []
    missing = [c for c in required if c not in new.columns]
    if missing:
        raise ValueError(f"{table}: columns without a default need a value: {missing}")
    unknown = [c for c in new.columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    new = new.select(*[
        (F.col(f.name) if f.name in new.columns else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)
        for f in df.schema.fields])
    nulls = [Rule("not_null", F.col(c).isNull(), f"Column '{c}' cannot be null") for c in required]
    return df.unionByName(enforce(new, [*nulls, *rules]))


# The database's messages for refused rows.
DUPLICATE_KEY_MESSAGE = "Duplicate entry for key 'PRIMARY'"
FOREIGN_KEY_MESSAGE = "Cannot add or update a child row: a foreign key constraint fails"


def insert_each(df: DataFrame, rows: DataFrame, table: str, order: str, rules: Sequence[Rule] = (),
                parents: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT statements of one row each, in ``order`` (a unique column of ``rows``); returns (table, outcome).

    A refused row is left out and reported; the others are appended. Refused are, in this order of reasons:
    rows that break ``rules`` (the insert triggers), a NULL in a NOT NULL column (``not_null``), a text longer than its
    column (``too_long``), a reference without its row in ``parents`` (``foreign_key``; tables by name), and a key that
    the table, or a row inserted before, has (``duplicate_key``). Outcome: ``order``, the key, ok, rule, message.
    """
    key = PRIMARY_KEYS[table]
    required = [c for c in not_null_columns(table) if c in df.columns]
    absent = [c for c in required if c not in rows.columns and DEFAULTS.get(c) is None]
    if absent:
        raise ValueError(f"{table}: columns without a default need a value: {absent}")
    new = rows.select(F.col(order).alias("_order"), *[
        (F.col(f.name) if f.name in rows.columns else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    held = [*rules, *[Rule("not_null", F.col(c).isNull(), f"Column '{c}' cannot be null") for c in required],
            *[Rule("too_long", F.length(c) > n, f"Data too long for column '{c}'") for c, n in LENGTH_LIMITS[table].items() if c in df.columns]]
    for k, (child, column, parent, parent_key) in enumerate(FOREIGN_KEYS):
        if child == table and parents is not None and parent in parents:
            there = parents[parent].select(F.col(parent_key).alias(f"_p{k}")).join(
                new.select(F.col(column).alias(f"_p{k}")).distinct(), f"_p{k}", "left_semi").distinct()
            new = new.join(there, new[column] == there[f"_p{k}"], "left")
            held.append(Rule("foreign_key", F.col(f"_p{k}").isNull(), FOREIGN_KEY_MESSAGE))
    tagged = tag_violations(new, held)
    taken = df.select(F.col(key).alias("_key")).join(new.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi").distinct()
    first = tagged.where("rule IS NULL").groupBy(F.col(key).alias("_key")).agg(F.min("_order").alias("_first"))
    first = first.join(taken.withColumn("_taken", F.lit(True)), "_key", "left")
    tagged = tagged.join(first, tagged[key] == first["_key"], "left")
    again = F.col("rule").isNull() & (F.col("_taken").isNotNull() | (F.col("_first") < F.col("_order")))
    tagged = tagged.withColumns({"rule": F.when(again, "duplicate_key").otherwise(F.col("rule")),
                                 "message": F.when(again, DUPLICATE_KEY_MESSAGE).otherwise(F.col("message"))})
    good = tagged.where("rule IS NULL").select(*df.columns)
    outcome = tagged.select(F.col("_order").alias(order), key, F.col("rule").isNull().alias("ok"), "rule", "message") if order != key else (
        tagged.select(key, F.col("rule").isNull().alias("ok"), "rule", "message"))
    return df.unionByName(good), outcome


def _norm(path: str) -> str:
    """Location without scheme differences that do not matter here (``file:///x`` vs ``/x``)."""
    u = urlparse(path)
    where = u.path if u.scheme in ("", "file") else f"{u.scheme}://{u.netloc}{u.path}"
    return posixpath.normpath(where)


def _roots(df: DataFrame) -> list[str]:
    """The folders or files named in the plan's scans: one entry per path given to a reader, not per file."""
    out = []
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and "HadoopFsRelation" in leaf.relation().getClass().getName():
            paths = leaf.relation().location().rootPaths()
            out += [paths.apply(k).toString() for k in range(paths.size())]
    return out


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a new table version to ``path``; refuses a folder the plan reads from."""
    target = _norm(path)
    for root in _roots(df):
        if _norm(root) == target or _norm(root).startswith(target + "/"):
            raise ValueError(f"{path} is read by this plan; write the snapshot to a new folder")
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
