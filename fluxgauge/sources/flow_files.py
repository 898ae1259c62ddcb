"""Flow CSV files of different layout as one table.

Every file has its own header. Headers are read by a job that takes the first line of each file and
stops there; files with the same header are read together by Spark's CSV reader under explicit
names, and the groups are united by name. Lines with more fields than their header are kept apart
instead of shifting or vanishing, and files that are not UTF-8 are read as Latin-1.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.operators.flows import normalize_name

UTF8, LATIN1 = "UTF-8", "ISO-8859-1"
#: Where a line that does not fit its header is kept while reading.
BROKEN = "__broken"
_FILE = "__file"


@dataclass(frozen=True)
class Layout:
    """Files that share a header and an encoding."""

    names: tuple[str, ...]
    encoding: str
    paths: tuple[str, ...]


def column_names(header: str) -> tuple[str, ...]:
    """Normalised names of a header line; a name that comes again gets a number, a missing one its place."""
    names: list[str] = []
    for k, cell in enumerate(next(csv.reader([header.removeprefix("﻿")]), [])):
        base = normalize_name(cell) or f"column_{k}"
        name, copies = base, 0
        while name in names:
            copies += 1
            name = f"{base}_{copies}"
        names.append(name)
    return tuple(names)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def file_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, header)``: the first line of every file that has one.

    A task takes one whole file and leaves it after the first line. The session for it is a new one
    on the same cluster: how files are dealt to tasks is a setting of the session.
    """
    apart = spark.newSession()
    whole = str(1 << 50)
    for key, value in {
        "spark.sql.files.maxPartitionBytes": whole,
        "spark.sql.files.openCostInBytes": whole,
        "spark.sql.files.minPartitionNum": "1",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
    }.items():
        apart.conf.set(key, value)
    lines = apart.read.text(path).select("_metadata.file_path", "value")
    return lines.mapInArrow(_first_lines, "file string, header string")


def not_utf8(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file)``: the files with a line that is no valid UTF-8; one pass over the text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.where(~F.is_valid_utf8("value")).select("file").distinct()


def layouts(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> list[Layout]:
    """The groups of files below ``path``, most columns first.

    Only file names and headers reach the driver, which holds the names of all files of a scan
    anyway. ``encoding`` saves the pass that looks for files that are not UTF-8.
    """
    strange = set() if encoding else {r["file"] for r in not_utf8(spark, path).collect()}
    groups: dict[tuple, list[str]] = {}
    for row in file_headers(spark, path).collect():
        kind = encoding or (LATIN1 if row["file"] in strange else UTF8)
        names = column_names(row["header"])
        if row["file"] in strange:
            # The header came as UTF-8 with its strange bytes replaced; it is read again below.
            names = column_names(_header_in(spark, row["file"], kind))
        if names:
            groups.setdefault((names, kind), []).append(row["file"])
    found = [Layout(names, kind, tuple(sorted(paths))) for (names, kind), paths in groups.items()]
    return sorted(found, key=lambda g: (-len(g.names), g.names, g.encoding))


def _header_in(spark: SparkSession, file: str, encoding: str) -> str:
    first = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").csv(file).limit(1).collect()
    return first[0][0] or "" if first else ""


def _lines(spark: SparkSession, layout: Layout) -> DataFrame:
    """All lines of a group: its columns as text, the file, and the whole line where it does not fit."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*layout.names, BROKEN)])
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
        .option("encoding", layout.encoding)
        .option("escape", '"')
        # A reader that skips columns does not see how many fields a line has.
        .option("columnPruning", False)
    )
    rows = reader.csv(list(layout.paths)).withColumn(_FILE, F.col("_metadata.file_path"))
    wider = ", ".join(f"c{k} STRING" for k in range(len(layout.names) + 1))
    # Only lines that do not fit are parsed again, to tell too many fields from too few. Spark refuses
    # plans that read nothing but the broken lines, so an always true test names a column besides.
    again = F.from_csv(BROKEN, wider, {"escape": '"', "columnPruning": "false"})
    beyond = again[f"c{len(layout.names)}"]
    read = F.coalesce(F.length(F.col(f"`{layout.names[0]}`")), F.lit(0)) >= 0
    return rows.withColumn("__long", F.col(BROKEN).isNotNull() & beyond.isNotNull() & read)


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def read_flow_files(
    spark: SparkSession, path: str | list[str], encoding: str | None = None, rejects: Observation | None = None
) -> DataFrame:
    """All lines of all files as text columns under normalised names, whatever their order per file.

    A column that a file lacks is NULL in its rows, as are fields missing at the end of a line. Lines
    with more fields than their header are left out (see ``rejected_lines``); ``rejects`` counts
    ``lines`` and ``rejected`` as the result is used. Files without a line give nothing.
    """
    found = layouts(spark, path, encoding)
    if not found:
        return spark.createDataFrame([], T.StructType([]))
    rows = _united([_lines(spark, layout) for layout in found])
    if rejects is not None:
        rows = rows.observe(rejects, F.count(F.lit(1)).alias("lines"), F.count_if("__long").alias("rejected"))
    return rows.where(~F.col("__long")).drop("__long", BROKEN, _FILE)


def rejected_lines(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """``(file, n_columns, line)``: the lines with more fields than their file's header."""
    found = layouts(spark, path, encoding)
    if not found:
        return spark.createDataFrame([], "file string, n_columns int, line string")
    tables = [
        _lines(spark, layout)
        .where("__long")
        .select(F.col(_FILE).alias("file"), F.lit(len(layout.names)).alias("n_columns"), F.col(BROKEN).alias("line"))
        for layout in found
    ]
    return _united(tables)
