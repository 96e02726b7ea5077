"""Tables of any delimiter, quote and header in one folder, as a data source that reads byte ranges.

Each file's first SAMPLE bytes tell its dialect. A large file is cut into ranges; whether a range begins within quotes
follows from the number of quotes before it, so a first read counts the quotes of each range, and the second one starts
every range at the first end of a record in it.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

SAMPLE, RANGE = 4096, 64 << 20
DELIMITERS = ",;\t|"
ROWS = "path string, file_name string, byte_start long, record int, columns array<string>, cells array<string>"
QUOTES = "path string, byte_start long, quotes long"


@dataclass
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    columns: list[str] | None = None  # of the header; None without one
    body: int = 0  # bytes before the first record


def _open(path: str):
    """A file that can seek, by path or URI (of a local or shared folder, or what Arrow's file systems reach)."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def _is_number(x: str) -> bool:
    try:
        float(x.strip().rstrip("%"))
    except ValueError:
        return False
    return True


def has_header(rows: list[list[str]]) -> bool:
    """Whether the first record names the others' columns: no cell of it is blank, a number, or found in its column
    again, and it isn't alone unless nothing speaks against it."""
    if not rows or not rows[0]:
        return False
    first, rest = rows[0], [r for r in rows[1:] if len(r) == len(rows[0])]
    if len(set(first)) < len(first) or any(not x.strip() or _is_number(x) for x in first):
        return False
    return not any(x.strip() == r[i].strip() for r in rest for i, x in enumerate(first)) and (not rest or any(_is_number(x) or len(x) != len(first[i]) for r in rest for i, x in enumerate(r)))


def sniffed(sample: bytes, header: str = "auto") -> Dialect:
    """The dialect of a file that begins so. header: 'auto', 'first' (the first record is one) or 'none'."""
    mark = 3 if sample.startswith(b"\xef\xbb\xbf") else 0
    text = sample[mark:].decode("utf-8", "replace")
    try:
        found = csv.Sniffer().sniff(text, DELIMITERS) if text.strip() else csv.excel
    except csv.Error:
        found = csv.excel
    d = Dialect(found.delimiter if found.delimiter in DELIMITERS else ",", getattr(found, "quotechar", '"') or '"', None, mark)
    whole = text if len(sample) < SAMPLE else text[: text.rfind("\n") + 1] or text
    rows = [r for r in records(whole, d)]
    if rows and (header == "first" or header == "auto" and has_header(rows)):
        d.columns = rows[0]
        d.body = mark + len(_first(whole, d.quote).encode("utf-8"))
    return d


def _first(text: str, quote: str) -> str:
    """The text of the first record, with its line end."""
    within = False
    for i, x in enumerate(text):
        within ^= x == quote
        if x == "\n" and not within:
            return text[: i + 1]
    return text


def records(text: str, d: Dialect) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=d.delimiter, quotechar=d.quote, doublequote=True))


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    size: int
    within: bool = False  # whether the byte at start stands within quotes


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = json.loads(options["files"])  # [path, size]
        self.range = int(options.get("range_bytes", RANGE))
        self.header = options.get("header_rule", "auto")
        self.count = options.get("count_quotes", "false") == "true"
        self.within = {(p, s): w for p, s, w in json.loads(options.get("within", "[]"))}

    def partitions(self) -> list[Piece]:
        return [Piece(p, s, min(n, s + self.range), n, self.within.get((p, s), False)) for p, n in self.files for s in range(0, max(1, n), self.range)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        with _open(piece.path) as f:
            d = sniffed(f.read(SAMPLE), self.header)
            f.seek(piece.start)
            if self.count:
                yield piece.path, piece.start, f.read(piece.end - piece.start).count(d.quote.encode())
                return
            start = max(piece.start, d.body)
            data = _whole(f, start, piece, d)
        for i, cells in enumerate(records(data.decode("utf-8", "replace"), d)):
            if any(x.strip() for x in cells):
                yield piece.path, piece.path.rsplit("/", 1)[-1], start, i, d.columns, cells


def _whole(f, start: int, piece: Piece, d: Dialect) -> bytes:
    """The records that begin in the piece: those after the first record's end in it, and the last one to its end."""
    if start >= piece.end:
        return b""
    f.seek(start)
    data, quote = f.read(piece.end - start), d.quote.encode()
    if piece.start > d.body:
        f.seek(start - 1)
        if f.read(1) == b"\n" and not piece.within:
            skip = 0
        else:
            skip = _record_end(data, quote, piece.within)
            if skip < 0:
                return b""  # no record begins here
    else:
        skip = 0
    odd = data[skip:].count(quote) % 2 == 1
    f.seek(piece.end)
    while piece.end < piece.size and (odd or not data.endswith(b"\n")):
        more = f.read(1 << 16)
        if not more:
            break
        end = _record_end(more, quote, odd)
        if end >= 0:
            return data[skip:] + more[:end]
        data, odd = data + more, odd ^ (more.count(quote) % 2 == 1)
    return data[skip:]


def _record_end(data: bytes, quote: bytes, within: bool) -> int:
    """Behind the first line end outside quotes; -1 without one."""
    at = 0
    while (end := data.find(b"\n", at)) >= 0:
        within ^= data.count(quote, at, end) % 2 == 1
        if not within:
            return end + 1
        at = end + 1
    return -1


class Delimited(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delimited"

    def schema(self) -> str:
        return QUOTES if self.options.get("count_quotes") == "true" else ROWS

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read_delimited(spark: SparkSession, folder: str, header: str = "auto", range_bytes: int = RANGE) -> DataFrame:
    """path, file_name, byte_start, record (from 0 in its range, blank ones counted), columns (null without a header),
    cells of each record that isn't blank, of every file below the folder.

    Line breaks within quotes belong to their cell. Bytes that aren't UTF-8 become U+FFFD; a mark of byte order is
    dropped; a record may have fewer or more cells than the header. The driver holds a name and a bit for each range.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length").collect()
    spark.dataSource.register(Delimited)
    source = spark.read.format("delimited").option("files", json.dumps([list(r) for r in files])).option("range_bytes", range_bytes).option("header_rule", header)
    if any(r.length > range_bytes for r in files):
        before = F.sum("quotes").over(Window.partitionBy("path").orderBy("byte_start").rowsBetween(Window.unboundedPreceding, -1))
        counted = source.option("count_quotes", "true").load().withColumn("odd", F.coalesce(before, F.lit(0)) % 2 == 1)
        source = source.option("within", json.dumps([[r.path, r.byte_start, r.odd] for r in counted.where("odd").collect()]))
    return source.option("count_quotes", "false").load()


def labelled(rows: DataFrame) -> DataFrame:
    """rows with text: 'column': value. sentences of the cells that aren't blank, or without a header the cells with
    bars between; records without either are left out."""
    end = lambda x: F.when(x.rlike(r"[.!?;:]$"), x).otherwise(F.concat(x, F.lit(".")))
    pairs = F.filter(F.arrays_zip("columns", "cells"), lambda p: (F.coalesce(p["columns"], F.lit("")) != "") & (F.trim(F.coalesce(p["cells"], F.lit(""))) != ""))
    named = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("'"), p["columns"], F.lit("': "), end(F.trim(p["cells"])))), " ")
    plain = F.array_join(F.filter(F.transform("cells", F.trim), lambda x: x != ""), " | ")
    return rows.withColumn("text", F.when(F.col("columns").isNotNull(), named).otherwise(plain)).where("text <> ''")
