"""CSV logs: one file per drive, headers may differ between files."""

from __future__ import annotations

import csv
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheeltrace.operators.scale import compiled_stages, known_small, materialize
from wheeltrace.schemas import (
    CHUNK,
    LINEAGE_COLUMNS,
    NUMERIC_SOURCE_COLUMNS,
    POSITION,
    TEXT_SOURCE_COLUMNS,
)

_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("bytes", T.LongType()),
    ]
)
_KNOWN_COLUMNS = (*NUMERIC_SOURCE_COLUMNS, *TEXT_SOURCE_COLUMNS)
# The raw line of a row whose number of cells differs from the scan's.
_ODD_LINE = "_odd_line"
_PARSED = "_parsed"
_CELLS = "_cells"
_PLACES = "_places"
# A byte order mark.
_MARK = "\ufeff"
# The folder is listed once; a path pattern would make Spark look at every file by itself.
_ONLY_CSV = {"pathGlobFilter": "*.csv"}
_CSV_OPTIONS = {"escape": '"', "mode": "PERMISSIVE"}

# Files with an unusual header whose column places are broadcast, some 200 bytes each; more
# than these are joined by shuffle.
BROADCAST_FILES = 100_000

# Besides its length a log counts as this many bytes when logs are dealt out to tasks. Spark's own
# 4 MB make a task, and a file of each table written from it, of some four logs.
LOG_OPEN_BYTES = 128 << 10


def _literal_path(path: str) -> str:
    """Escape the characters a path pattern treats specially."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", path)


def _whole_path(spark: SparkSession, data_dir: str) -> str:
    """The folder's path with scheme, without "." and ".." pieces."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(str(data_dir))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(folder).toString().rstrip("/")


def many_logs_a_task(spark: SparkSession) -> None:
    """Have Spark deal out short logs by their length, in this session."""
    if spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() > LOG_OPEN_BYTES:
        spark.conf.set("spark.sql.files.openCostInBytes", str(LOG_OPEN_BYTES))


def discover_csv_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """The CSV files directly in a folder: `path`, `source_file`, `bytes`.

    Spark lists the folder; file contents are not read. A missing folder has no files. Spark
    passes over names that begin with "_" or "."; such logs are an error, not a silent loss.
    """
    many_logs_a_task(spark)
    whole = _whole_path(spark, data_dir)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(whole).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hidden = system.globStatus(hadoop.Path(f"{_literal_path(whole)}/[_.]*.csv")) or []
    if len(hidden):
        names = ", ".join(sorted(status.getPath().getName() for status in hidden))
        raise ValueError(f"Rename logs whose names begin with '_' or '.': {names}")
    try:
        listed = spark.read.format("binaryFile").options(**_ONLY_CSV).load(_literal_path(whole))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _FILE_SCHEMA)
        raise
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return listed.where(parent == whole).select(
        "path", F.substring_index("path", "/", -1).alias("source_file"), F.col("length").alias("bytes")
    )


def _header_cells(line: str) -> list[str]:
    return next(csv.reader([line.removeprefix(_MARK)]), [])


def _cell_columns(count: int) -> list[str]:
    return [f"_c{k}" for k in range(count)]


def _text_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """All lines of a folder's logs as text. The folder is listed here, once per frame."""
    many_logs_a_task(spark)
    whole = _whole_path(spark, data_dir)
    return spark.read.options(**_ONLY_CSV).text(_literal_path(whole))


def scan_positions(
    spark: SparkSession, data_dir: str, width: int, text: DataFrame | None = None
) -> DataFrame:
    """All lines of a folder's logs in one scan: file, chunk, position, cells by position.

    `width` is the number of cells most lines have. A line with another number keeps its raw
    text in `_odd_line`. Header lines are among the rows, blank lines are not. The position must
    be taken on the scan itself; large files are split; a split is one `_chunk`. Lines are read
    as text and parsed by `from_csv`, as Spark's CSV scan sets up a parser for every file. `text`
    are the folder's lines where the caller has listed them.
    """
    whole = _whole_path(spark, data_dir)
    names = [*_cell_columns(width), _ODD_LINE]
    schema = ", ".join(f"{name} string" for name in names)
    options = {**_CSV_OPTIONS, "columnNameOfCorruptRecord": _ODD_LINE}
    rows = _text_lines(spark, data_dir) if text is None else text

    def decoded(name: str) -> Column:
        # Metadata names are URL-encoded, and a plus sign in them is just a plus.
        return F.url_decode(F.replace(F.col(f"_metadata.{name}"), F.lit("+"), F.lit("%2B")))

    # A folder called x=1 or x.csv may be listed too; its files are not directly in data_dir.
    bare = r"^[A-Za-z0-9+.-]+:/*"
    parent = F.regexp_replace(F.regexp_replace(decoded("file_path"), bare, ""), "/[^/]*$", "")
    placed = rows.select(
        decoded("file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias(CHUNK),
        F.monotonically_increasing_id().alias(POSITION),
        parent.alias("_parent"),
        "value",
    )
    # A line of white space and control characters alone is blank to a CSV scan.
    own = placed.where(
        (F.col("_parent") == re.sub(bare, "", whole)) & F.col("value").rlike(r"[^\x00-\x20]")
    )
    return own.withColumn(_PARSED, F.from_csv("value", schema, options)).select(
        "source_file", CHUNK, POSITION, *[F.col(_PARSED)[name].alias(name) for name in names]
    )


def _with_cells(rows: DataFrame, width: int, widest: int) -> DataFrame:
    """Add `_cells`: the cells of a line as an array.

    A line with an unusual number of cells is parsed from its raw text, up to `widest` cells. The
    parsed line is a column of its own, so it is parsed once and not once a cell.
    """
    usual = F.array(*_cell_columns(width))
    if not widest:
        return rows.withColumn(_CELLS, usual)
    names = _cell_columns(widest)
    schema = ", ".join(f"{name} string" for name in names)
    parsed = F.from_csv(F.col(_ODD_LINE), schema, _CSV_OPTIONS)
    odd = F.array(*[F.col(_PARSED)[name] for name in names])
    return (
        rows.withColumn(_PARSED, F.when(F.col(_ODD_LINE).isNotNull(), parsed))
        .withColumn(_CELLS, F.when(F.col(_ODD_LINE).isNull(), usual).otherwise(odd))
        .drop(_PARSED)
    )


def _places(header: Column) -> Column:
    """Where each known column stands in a header, from 0; -1 where it is missing.

    Of equal names the first counts. A byte order mark before the first name does not.
    """
    clean = F.transform(header, lambda cell: F.regexp_replace(cell, "^" + _MARK, ""))
    return F.array(
        *[F.array_position(clean, F.lit(name)).cast("int") - 1 for name in _KNOWN_COLUMNS]
    )


def header_places(lines: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(source_file, _head: position of the header line, _places) per file, and the widest header.

    The header is a file's first line that is not blank. All of this is found by Spark in the
    written lines.
    """
    heads = (
        lines.where(F.col(CHUNK) == 0)
        .groupBy("source_file")
        .agg(F.min(POSITION).alias("_head"))
        .withColumnRenamed("source_file", "_file")
    )
    # Written and counted first: only as a known small side it spares lines the shuffle.
    heads = known_small(materialize(heads, "heads"), BROADCAST_FILES)
    headers = lines.where(F.col(CHUNK) == 0).join(
        heads, (F.col("source_file") == F.col("_file")) & (F.col(POSITION) == F.col("_head"))
    )
    headers = materialize(headers.drop("_file"), "headers")
    commas = F.char_length(_ODD_LINE) - F.char_length(F.replace(_ODD_LINE, F.lit(",")))
    widest = headers.agg(F.max(commas + 1).alias("n")).first().n or 0
    places = _places(F.col(_CELLS)).alias(_PLACES)
    return _with_cells(headers, width, widest).select("source_file", "_head", places), widest


def read_csv_logs(spark: SparkSession, data_dir: str, files: DataFrame | None = None) -> DataFrame:
    """All rows of a folder's logs, matched by column name, whatever the headers.

    `files` are the folder's files, at least one, where the caller has discovered them.

    The text is read once, by position, and written to the shared folder. A file's header
    then tells which position holds which column. Files whose columns stand where they do in
    the first header seen need nothing else; the places of the others are joined by file.
    What reaches the driver is one header line and a few counts, no list of files.
    """
    names = [T.StructField(name, T.StringType()) for name in ("source_file", "drive_id")]
    numbers = [T.StructField(name, T.LongType()) for name in (CHUNK, POSITION)]
    empty = spark.createDataFrame([], T.StructType(names + numbers))
    if files is None and discover_csv_files(spark, data_dir).isEmpty():
        return empty
    compiled_stages(spark)
    text = _text_lines(spark, data_dir)
    first = text.where(F.trim("value") != "").take(1)
    if not first:
        return empty
    usual = _header_cells(first[0].value.lstrip())
    width = len(usual)
    lines = materialize(scan_positions(spark, data_dir, width, text), "lines")
    headers, widest = header_places(lines, width)

    usual_places = [usual.index(name) if name in usual else -1 for name in _KNOWN_COLUMNS]
    usual_places_column = F.array(*[F.lit(place) for place in usual_places])
    unusual = F.col(_PLACES) != usual_places_column
    found = headers.agg(
        *[F.max(F.col(_PLACES)[k]).alias(f"_{k}") for k in range(len(_KNOWN_COLUMNS))],
        F.count_if(unusual).alias("_others"),
        F.count(F.lit(1)).alias("_files"),
    ).first()
    known = [(k, name) for k, name in enumerate(_KNOWN_COLUMNS) if found[f"_{k}"] >= 0]

    # One join tells both a file's header line and, where it is unusual, its places.
    heads = headers.select("source_file", "_head", F.when(unusual, F.col(_PLACES)).alias(_PLACES))
    few = found["_files"] <= BROADCAST_FILES
    rows = lines.join(F.broadcast(heads) if few else heads, "source_file", "left").where(
        F.col("_head").isNull() | (F.col(POSITION) != F.col("_head"))
    )
    values = {k: F.col(f"_c{p}") if p >= 0 else F.lit(None) for k, p in enumerate(usual_places)}
    if found["_others"]:
        rows = _with_cells(rows, width, widest)
        place = F.col(_PLACES)
        values = {
            k: F.when(place.isNull(), value).otherwise(
                F.when(place[k] >= 0, F.get(_CELLS, place[k]))
            )
            for k, value in values.items()
        }
    return rows.select(
        F.regexp_replace("source_file", r"\.[^.]*$", "").alias("drive_id"),
        "source_file",
        CHUNK,
        POSITION,
        *[values[k].cast("string").alias(name) for k, name in known],
    ).select(*LINEAGE_COLUMNS, *[F.col(f"`{name}`") for _, name in known])
