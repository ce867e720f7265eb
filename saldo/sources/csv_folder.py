"""A folder of unlike CSV files as one all-text table with provenance.

The files of a folder differ in charset, delimiter and header. One pass over the raw lines tells,
per file, which charset it has and what its header is; files that agree are then read together, so
the number of scans follows the number of layouts and not the number of files. Only file names and
headers reach the driver, as they must for Spark to plan the reads. Files whose records span lines are cut into
records by :mod:`saldo.sources.csv_records`, with many tasks a file.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from urllib.parse import quote, unquote

from saldo.functions.names import plain_name, reader_names, unique_names
from saldo.functions.periods import file_month, file_period, file_year, run_time
from saldo.settings import NULL_TOKENS
from saldo.sources.csv_records import CHUNK_BYTES, split_records
from saldo.sources.scratch import discard

DELIMITERS = (",", ";", "\t", "|")
PROVENANCE = ("source_file", "source_url", "year", "ingested_at")
MONTH = "period_month"

UTF8, WINDOWS, LATIN = "utf-8", "cp1252", "latin-1"
BYTE_ORDER_MARK = "\ufeff"
# Bytes 0x80 to 0x9F are the only ones on which the two single-byte charsets differ.
_HIGH = [bytes([b]) for b in range(0x80, 0xA0)]
_DEFINED = [b for b in _HIGH if b.decode(WINDOWS, "ignore")]
_C1 = "".join(b.decode(LATIN) for b in _DEFINED)
_C1_AS_WINDOWS = "".join(b.decode(WINDOWS) for b in _DEFINED)
_C1_UNDEFINED = "".join(b.decode(LATIN) for b in _HIGH if b not in _DEFINED)


@dataclass(frozen=True)
class FileLayout:
    path: str
    name: str
    charset: str
    delimiter: str
    header: tuple[str, ...]
    multiline: bool

    @property
    def group(self) -> tuple:
        return (self.charset, self.delimiter, self.header, self.multiline)


@dataclass(frozen=True)
class Ingest:
    """The combined table, and for each file its original names with the ones they became.

    Files whose records span lines are read from written tables; ``close`` deletes these once the table is used.
    """

    table: DataFrame
    column_maps: list[tuple[str, dict[str, str]]]
    ingested_at: str
    scratch: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        discard(self.table.sparkSession, *self.scratch)


def data_set_name(path: Column) -> Column:
    """As :func:`data_set`, for a column of paths. Plain text functions, as it runs on every row."""
    file = F.substring_index(path, "/", -1)
    parent = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    raw = F.when(file.startswith("part-"), F.substring_index(parent, "=", -1)).otherwise(file)
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(raw.contains("%"), decoded).otherwise(raw)


def data_set(path: str, folder: str) -> str | None:
    """Name of the data set a file belongs to; None for a file that only lies somewhere below.

    A data set is a file ``x.csv``, or a folder ``x.csv`` of parts as Spark writes it.
    """
    *_, parent, name = path.split("/")
    if parent == folder.rstrip("/").split("/")[-1]:
        return name
    named = parent.split("=")[-1]
    return named if name.startswith("part-") and named.endswith(".csv") else None


def detect_delimiter(header_line: str) -> str:
    """The candidate found most often outside quotes; a comma when there is none."""
    bare = "".join(header_line.split('"')[::2])
    return max(DELIMITERS, key=bare.count)


def split_header(header_line: str, delimiter: str) -> tuple[str, ...]:
    return tuple(next(csv.reader(io.StringIO(header_line), delimiter=delimiter), []))


def file_profiles(lines: DataFrame) -> DataFrame:
    """What each file's charset follows from, whether some line leaves a quote open, and its first line that is not blank.

    The charset is UTF-8 when every line is valid UTF-8; else windows-1252 unless a byte is undefined in it. The first line is
    the smallest row id of the block that starts the file, as bytes. The kinds of lines that a file has are collected as a set,
    so that Spark aggregates in a map with one entry a file; without it the texts in the aggregate would have every line sorted.
    """
    text = F.col("value")
    valid = F.is_valid_utf8(text)
    plain = valid & (F.octet_length(text) == F.char_length(text))
    as_latin = F.decode(text.cast("binary"), "ISO-8859-1")
    undefined = F.when(plain, F.lit(False)).otherwise(as_latin.rlike(f"[{_C1_UNDEFINED}]"))
    quotes = F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))
    kind = F.when(~valid, 1).otherwise(0) + F.when(undefined, 2).otherwise(0) + F.when(quotes % 2 == 1, 4).otherwise(0)
    blank = F.btrim("value", F.lit(BYTE_ORDER_MARK + " \t\r")) == ""
    row_id = F.monotonically_increasing_id()
    marked = lines.select("path", "value", kind.alias("kind"), F.when((F.col("block_start") == 0) & ~blank, row_id).alias("row_id"))
    seen = marked.groupBy("path").agg(
        F.collect_set("kind").alias("kinds"), F.min_by(F.col("value").cast("binary"), "row_id").alias("header")
    )

    def some(bit: int) -> Column:
        return F.exists("kinds", lambda k: k.bitwiseAND(F.lit(bit)) != 0)

    return seen.select("path", (~some(1)).alias("utf8"), some(2).alias("undefined"), some(4).alias("open_quote"), "header")


def literal_path(path: str) -> str:
    """The path with its pattern characters escaped, as readers take patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def plain_path(encoded: str) -> str:
    """A path as ``_metadata.file_path`` names it, without percent signs."""
    return unquote(encoded).replace(":///", ":/")


def layouts(spark: SparkSession, folder: str) -> list[FileLayout]:
    """Charset, delimiter and header of every data set in the folder, in order of name."""
    found_in = {"pathGlobFilter": "*.csv", "recursiveFileLookup": True}
    found = table_layouts(spark.read.options(**found_in).text(folder), folder)
    if not found:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return found


def table_layouts(table: DataFrame, folder: str) -> list[FileLayout]:
    """The same for files read as text, of which those count that are data sets of the folder."""
    path = F.col("_metadata.file_path")
    parent = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    # What only lies below the folder is left out before it is looked at.
    own = (parent == quote(folder.rstrip("/").split("/")[-1])) | parent.endswith(".csv")
    lines = (
        table.filter(own)
        .select(path.alias("path"), F.col("_metadata.file_block_start").alias("block_start"), "value")
    )
    profile = {row["path"]: row for row in file_profiles(lines).collect()}
    # A file without any line is listed, but no row of the table is from it.
    with_lines = {plain_path(path) for path in profile}
    for path in sorted({plain_path(path) for path in table.inputFiles()} - with_lines):
        if data_set(path, folder) and not path.rsplit("/", 1)[-1].startswith("part-"):
            raise ValueError(f"the file {path} is empty")
    found = []
    for encoded, seen in profile.items():
        path = unquote(encoded)
        name = data_set(path, folder)
        if name is None:
            continue
        if seen["header"] is None:
            raise ValueError(f"the file {path} has no header")
        charset = UTF8 if seen["utf8"] else LATIN if seen["undefined"] else WINDOWS
        line = bytes(seen["header"]).decode(charset).removeprefix(BYTE_ORDER_MARK).rstrip("\r")
        delimiter = detect_delimiter(line)
        header = split_header(line, delimiter)
        found.append(FileLayout(path, name, charset, delimiter, header, bool(seen["open_quote"])))
    return sorted(found, key=lambda f: (f.name, f.path))


def null_tokens(df: DataFrame, columns: Sequence[str], tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """NULL for every text that stands for a missing value."""
    return df.withColumns({c: F.when(~F.col(c).isin(list(tokens)), F.col(c)) for c in columns})


def column_names(header: Sequence[str]) -> list[tuple[str, str]]:
    """Original and final name of each source column, none clashing with the provenance columns."""
    original = reader_names(header)
    final = unique_names([*PROVENANCE, *[plain_name(n) for n in original]])
    return list(zip(original, final[len(PROVENANCE):]))


def add_provenance(df: DataFrame, ingested_at: str, path: str = "_path") -> DataFrame:
    """Source file, year and month from its name, and the time of the run."""
    name, period = data_set_name(F.col(path)), "_period"
    fixed = df.select(
        name.alias("source_file"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(ingested_at).alias("ingested_at"),
        *[c for c in df.columns if c != path],
    ).withColumn(period, file_period(F.col("source_file")))
    # One search in the name of each row serves the year and the month.
    added = {"year": file_year(F.col("source_file"), F.col(period))}
    if MONTH not in df.columns:
        added[MONTH] = file_month(F.col("source_file"), F.col(period))
    return fixed.withColumns(added).drop(period)


def as_windows(cell: Column) -> Column:
    """A cell read as latin-1 in the charset windows-1252. Cells of ASCII alone, which most are, stay without a look at each character."""
    return F.when(F.octet_length(cell) == F.char_length(cell), cell).otherwise(F.translate(cell, _C1, _C1_AS_WINDOWS))


def text_schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])


def shape(raw: DataFrame, header: Sequence[str], charset: str, ingested_at: str) -> DataFrame:
    """Final names, missing values and provenance for rows read with :func:`text_schema` beside their ``_path``.

    Rows with one column more than the header are checked: one that uses it is wider than the header, an error.
    """
    names = column_names(header)
    if f"_c{len(names)}" in raw.columns:
        beyond = F.col(f"_c{len(names)}")
        wide = F.raise_error(F.concat(F.lit("a row is wider than the header in "), F.col("_path"), F.lit(", at: "), beyond))
        raw = raw.filter(F.when(beyond.isNotNull(), wide.cast("boolean")).otherwise(F.lit(True)))
    cells = [F.col(f"_c{i}").alias(final) for i, (_, final) in enumerate(names)]
    df = raw.select("_path", *cells)
    finals = [final for _, final in names]
    if charset == WINDOWS:
        df = df.withColumns({c: as_windows(F.col(c)) for c in finals})
    df = add_provenance(null_tokens(df, finals), ingested_at)
    tail = [c for c in (MONTH,) if c not in finals]
    return df.select(*PROVENANCE, *tail, *finals)


def reader_options(charset: str, delimiter: str, multiline: bool) -> dict:
    return {
        "header": True,
        "enforceSchema": True,
        "sep": delimiter,
        "encoding": "UTF-8" if charset == UTF8 else "ISO-8859-1",
        "quote": '"',
        "escape": '"',
        "multiLine": multiline,
    }


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; missing columns are NULL, names keep the order they appear in."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_whole(spark: SparkSession, files: Sequence[FileLayout], multiline: bool) -> DataFrame:
    """Raw cells beside their path, by the file reader; files of several lines a record are read by one task each."""
    one = files[0]
    reader = spark.read.schema(text_schema(len(one.header) + 1)).options(**reader_options(one.charset, one.delimiter, multiline))
    return reader.csv([literal_path(f.path) for f in files]).select("*", F.col("_metadata.file_path").alias("_path"))


def read_records(spark: SparkSession, files: Sequence[FileLayout], chunk_bytes: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Raw cells of files whose records span lines, and the written tables they are read from.

    Every record is parsed by the same parser as a file is. Files with quotes out of place are left to the file reader.
    """
    one = files[0]
    records = split_records(spark, [literal_path(f.path) for f in files], one.delimiter, chunk_bytes)
    text = F.col("record").cast("string") if one.charset == UTF8 else F.decode("record", "ISO-8859-1")
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in reader_options(one.charset, one.delimiter, True).items() if k != "header"}
    cells = F.from_csv(text, text_schema(len(one.header) + 1).simpleString()[len("struct<"):-1].replace(":", " "), options)
    frames = [records.table.select(F.col("path").alias("_path"), cells.alias("cells")).select("cells.*", "_path")]
    odd = {plain_path(path) for path in records.odd}
    whole = [f for f in files if f.path.replace(":///", ":/") in odd]
    return frames + ([read_whole(spark, whole, True)] if whole else []), records.scratch


def read_csv_folder(spark: SparkSession, folder: str, ingested_at: str | None = None) -> Ingest:
    """All CSV files of a folder as one text table."""
    return read_csv_files(spark, layouts(spark, folder), ingested_at)


def read_csv_files(spark: SparkSession, files: Sequence[FileLayout], ingested_at: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> Ingest:
    """Files of known layout as one text table; those that agree in it are read together."""
    stamp = ingested_at or run_time()
    groups: dict[tuple, list[FileLayout]] = {}
    for f in files:
        groups.setdefault(f.group, []).append(f)
    frames, scratch = [], []
    for (charset, _, header, multiline), members in groups.items():
        raws = [read_whole(spark, members, False)]
        if multiline:
            raws, written = read_records(spark, members, chunk_bytes)
            scratch += written
        frames += [shape(raw, header, charset, stamp) for raw in raws]
    if len({f.schema[MONTH].dataType.simpleString() for f in frames}) > 1:
        frames = [f.withColumn(MONTH, F.col(MONTH).cast("string")) for f in frames]
    maps = [(f.name, {c: c for c in PROVENANCE} | dict(column_names(f.header))) for f in files]
    return Ingest(union_by_name(frames), list({name: (name, m) for name, m in maps}.values()), stamp, scratch)
