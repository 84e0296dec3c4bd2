"""Files in and out: text facts, JSON results, SQLite artifacts, compile commands."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SCHEMAS


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated facts without a header; tabs and line ends in texts become blanks, nulls 0 or empty."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        text = isinstance(f.dataType, T.StringType)
        cols.append((F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ") if text else F.coalesce(c.cast("string"), F.lit("0"))).alias(f.name))
    df.select(*cols).write.mode("overwrite").option("sep", "\t").option("quote", "\u0000").option("emptyValue", "").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "\u0000").csv(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A derived relation as a table that replaces the one before."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json(rows: list[dict], path: str) -> None:
    """Bounded results as indented JSON, on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2)


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(directory, file, command) of a compile command file; argument lists are joined by blanks."""
    df = spark.read.schema("directory string, file string, command string, arguments array<string>").option("multiLine", True).json(path)
    return df.select("directory", "file", F.coalesce("command", F.array_join("arguments", " ")).alias("command"))


def _sqlite_type(declared: str) -> T.DataType:
    d = (declared or "").upper()
    return T.BooleanType() if "BOOL" in d else T.LongType() if "INT" in d else T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else T.StringType()


def read_sqlite(spark: SparkSession, path: str, table: str, slices: int = 8, schema: T.StructType | None = None) -> DataFrame:
    """A table of a SQLite file that all workers can read, opened read-only, in slices of its row ids.

    Columns and types come from the table's declaration unless a schema is given. Tables without row ids are one slice.
    """
    quoted = '"' + table.replace('"', '""') + '"'
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        if schema is None:
            declared = con.execute(f"PRAGMA table_info({quoted})").fetchall()
            if not declared:
                raise ValueError(f"no table {table}")
            schema = SCHEMAS.get(table) if table in SCHEMAS and {d[1] for d in declared} >= set(SCHEMAS[table].names) else T.StructType([T.StructField(d[1], _sqlite_type(d[2])) for d in declared])
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted}").fetchone()
        except sqlite3.OperationalError:
            low = high = None
            slices = 1
    names = ", ".join('"' + n.replace('"', '""') + '"' for n in schema.names)
    if low is None:
        parts = [(None, None)]
    else:
        step = max(1, -(-(high - low + 1) // slices))
        parts = [(a, a + step) for a in range(low, high + 1, step)]
    arrow = _arrow(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
                    where = "" if a is None else f" WHERE rowid >= {a} AND rowid < {b}"
                    cursor = c.execute(f"SELECT {names} FROM {quoted}{where}")
                    while rows := cursor.fetchmany(50_000):
                        cols = [[None if v is None else str(v) if pa.types.is_string(f.type) else bool(v) if pa.types.is_boolean(f.type) else v for v in col] for col, f in zip(zip(*rows), arrow)]
                        yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(cols, arrow)], schema=arrow)

    return spark.createDataFrame(parts, "a bigint, b bigint").repartition(len(parts)).mapInArrow(read, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema.fields])
