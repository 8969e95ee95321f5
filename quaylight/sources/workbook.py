"""Workbooks as a Python data source: many files of several sheets, written and read in streams.

A row is (book, sheet, row, cells): the file, the sheet, the row's number from 0, and the
texts of its cells. A task writes whole files, each sheet straight into its zip entry, and the
commit moves what finished tasks wrote into place. Reading plans a partition a sheet.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import unquote
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Rows that a sheet of a file holds; further rows are in further files of the book.
ROWS = 1 << 20
SCHEMA = "book string, sheet string, row long, cells array<string>"
#: Bytes of cells in a batch, files that the driver looks into at a time.
BATCH, THREADS = 4 << 20, 32

# Fixed values of the file format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
STYLES = (
    f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'
)

#: Texts that stay the same when a sheet keeps them as numbers.
NUMBER = re.compile(r"(?!-0$)-?(?:0|[1-9][0-9]{0,8})(?:\.[0-9]{0,4}[1-9])?")
#: Characters that XML can't hold, and what looks like their escape.
UNFIT = re.compile("[\x00-\x08\x0b-\x1f\ud800-\udfff\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
NO_SHEET = re.compile(r"[\[\]:*?/\\]")


def column_name(i: int) -> str:
    """Letters of a column from 0: A, Z, AA."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def column_number(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def safe(text: str) -> str:
    """A text as XML content from which ``plain`` makes it again."""
    return escape(UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def plain(text: str) -> str:
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def file_name(book: Column, volume: Column) -> Column:
    """The file of a book's volume; no two share one, and none is hidden."""
    stem = F.url_encode(book)
    for char, said in (("+", " "), (".", "%2E"), ("*", "%2A")):
        stem = F.replace(stem, F.lit(char), F.lit(said))
    return F.concat(stem, F.when((volume > 1) | (book == ""), F.concat(F.lit("+"), volume.cast("string"))).otherwise(""), F.lit(".xlsx"))


def book_of(name: str) -> tuple[str, int]:
    stem, _, volume = name.removesuffix(".xlsx").partition("+")
    return unquote(stem), int(volume or 1)


@dataclass
class Look:
    """How a sheet looks: bold rows at its head, widths of columns, and the values that a
    column's cells may take below the head."""

    bold: int = 0
    widths: tuple[int, ...] = ()
    choices: dict[int, list[str]] | None = None

    def before(self) -> str:
        cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(self.widths, 1))
        pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{self.bold}" topLeftCell="A{self.bold + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        return (pane if self.bold else "") + (f"<cols>{cols}</cols>" if cols else "")

    def after(self) -> str:
        each = []
        for i, values in (self.choices or {}).items():
            c, said = column_name(int(i)), escape('"' + ",".join(values) + '"')
            each.append(f'<dataValidation type="list" allowBlank="1" sqref="{c}{self.bold + 1}:{c}{ROWS}"><formula1>{said}</formula1></dataValidation>')
        return f'<dataValidations count="{len(each)}">{"".join(each)}</dataValidations>' if each else ""


def _cells(row: int, cells: list[str | None], bold: bool) -> str:
    style, out = ' s="1"' if bold else "", []
    for i, x in enumerate(cells or []):
        if x is None:
            continue
        at = f'<c r="{column_name(i)}{row + 1}"{style}'
        out.append(f"{at}><v>{x}</v></c>" if NUMBER.fullmatch(x) else f'{at} t="inlineStr"><is><t xml:space="preserve">{safe(x)}</t></is></c>')
    return f'<row r="{row + 1}">{"".join(out)}</row>'


def write_book(out, sheets: Iterator[tuple[str, Iterator[tuple[int, list[str | None]]]]], order: list[str], looks: dict[str, Look]) -> None:
    """One file on a stream that need not be sought: sheets as they come, each row as it
    comes; only the list of sheets, at the end, has them in the wanted order."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = []
        for name, rows in sheets:
            if not 0 < len(name) <= 31 or NO_SHEET.search(name) or UNFIT.search(name):
                raise ValueError(f"a workbook can't have a sheet {name!r}")
            names.append(name)
            look, last = looks.get(name, Look()), -1
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
                f.write(f'{HEAD}<worksheet xmlns="{MAIN}">{look.before()}<sheetData>'.encode())
                for row, cells in rows:
                    if row == last:
                        raise ValueError(f"sheet {name!r} has two rows {row}")
                    f.write(_cells(row, cells, row < look.bold).encode())
                    last = row
                f.write(f"</sheetData>{look.after()}</worksheet>".encode())
        place = {n: i for i, n in enumerate(order)}
        ids = sorted(range(len(names)), key=lambda i: (place.get(names[i], len(place)), i))
        listed = "".join(f'<sheet name={quoteattr(names[i])} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i in ids)
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        links += f'<Relationship Id="rId0" Type="{LINKS}/styles" Target="styles.xml"/>'
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{KIND}.worksheet+xml"/>' for i in range(len(names)))
        kinds += f'<Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/>'
        relations = f'xmlns="{PACKAGE}/relationships"'
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f"{HEAD}<Relationships {relations}>{links}</Relationships>")
        z.writestr("_rels/.rels", f'{HEAD}<Relationships {relations}><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class WorkbookWriter(DataSourceArrowWriter):
    """Rows come in the order of (file, sheet, row). Every attempt of a task writes to a folder
    of its own, so one that is lost leaves nothing behind in the target."""

    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.order = json.loads(options.get("order", "[]"))
        self.looks = {n: Look(**x) for n, x in json.loads(options.get("looks", "{}")).items()}
        self.job = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        folder = f"{self.job}/{uuid.uuid4().hex}"
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        rows = (r for b in iterator for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        files = []
        for name, own in groupby(rows, key=lambda r: r[0]):
            with fs.open_output_stream(f"{root}/{name}") as out:
                write_book(out, ((s, ((r[2], r[3]) for r in of)) for s, of in groupby(own, key=lambda r: r[1])), self.order, self.looks)
            files.append(name)
        return Written(folder, files)

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        moves = [(pafs.FileSystem.from_uri(m.folder)[1], f) for m in messages if m for f in m.files]
        found = {x.base_name for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.is_file and x.base_name.endswith(".xlsx")}
        if not self.overwrite and (twice := found & {f for _, f in moves}):
            self.abort(messages)
            raise FileExistsError(f"{self.path} has {sorted(twice)[:3]}")
        with ThreadPoolExecutor(THREADS) as pool:
            if self.overwrite:
                list(pool.map(lambda f: fs.delete_file(f"{root}/{f}"), found))
            list(pool.map(lambda m: fs.move(f"{m[0]}/{m[1]}", f"{root}/{m[1]}"), moves))
        self.abort(messages)

    def abort(self, messages):
        fs, folder = pafs.FileSystem.from_uri(self.job)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str):
        super().__init__((path, sheet))
        self.path, self.sheet = path, sheet


def _entries(z: zipfile.ZipFile) -> dict[str, str]:
    """Sheets of a file, in its order, and the entries that hold them."""
    targets = {}
    with z.open("xl/_rels/workbook.xml.rels") as f:
        for _, e in iterparse(f):
            if e.tag.endswith("}Relationship"):
                targets[e.get("Id")] = e.get("Target")
    with z.open("xl/workbook.xml") as f:
        sheets = [(e.get("name"), e.get(f"{{{LINKS}}}id")) for _, e in iterparse(f) if e.tag == f"{{{MAIN}}}sheet"]
    entry = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return {name: entry(targets[i]) for name, i in sheets if i in targets}


def _text(e) -> str:
    """The text of a string element: its plain text or that of its runs, without phonetics."""
    parts = [x for x in e if x.tag == f"{{{MAIN}}}t"] + [t for r in e if r.tag == f"{{{MAIN}}}r" for t in r if t.tag == f"{{{MAIN}}}t"]
    return plain("".join(t.text or "" for t in parts))


def _shared(z: zipfile.ZipFile) -> list[str]:
    """Strings that the cells of a file share; files of this writer have none."""
    if "xl/sharedStrings.xml" not in z.NameToInfo:
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in iterparse(f):
            if e.tag == f"{{{MAIN}}}si":
                out.append(_text(e))
                e.clear()
    return out


def _value(c, shared: list[str]) -> str | None:
    kind, v = c.get("t"), c.find(f"{{{MAIN}}}v")
    if kind == "inlineStr":
        i = c.find(f"{{{MAIN}}}is")
        return None if i is None else _text(i)
    if v is None:
        return None
    text = v.text or ""
    if kind == "s":
        return shared[int(text)]
    return {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else plain(text)


def read_sheet(z: zipfile.ZipFile, entry: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row, cells) of a sheet, one row in memory at a time."""
    shared, row, data = _shared(z), -1, None
    with z.open(entry) as f:
        for event, e in iterparse(f, events=("start", "end")):
            if event == "start":
                data = e if e.tag == f"{{{MAIN}}}sheetData" else data
            elif e.tag == f"{{{MAIN}}}row":
                row = int(e.get("r")) - 1 if e.get("r") else row + 1
                cells: list[str | None] = []
                for c in e:
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(c, shared)
                yield row, cells
                data.clear()


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.sheets = options["path"].rstrip("/"), json.loads(options.get("sheets", "null"))

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted(x.path for x in found if x.is_file and x.base_name.endswith(".xlsx") and not any(p.startswith(("_", ".")) for p in x.path[len(root) :].split("/")[:-1]) and not x.base_name.startswith((".", "~$")))
        uris = [self.path + f[len(root.rstrip("/")) :] for f in files]
        if self.sheets is not None:
            return [_Sheet(u, s) for u in uris for s in self.sheets]

        def names(u):
            with fs.open_input_file(pafs.FileSystem.from_uri(u)[1]) as f, zipfile.ZipFile(f) as z:
                return [_Sheet(u, s) for s in _entries(z)]

        with ThreadPoolExecutor(THREADS) as pool:
            return [p for some in pool.map(names, uris) for p in some]

    def read(self, part):
        if part is None:  # no file, no partition
            return
        fs, path = pafs.FileSystem.from_uri(part.path)
        book, volume = book_of(path.rpartition("/")[2])
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            if (entry := _entries(z).get(part.sheet)) is None:
                return
            rows, held = [], 0
            for row, cells in read_sheet(z, entry):
                rows.append((row + (volume - 1) * ROWS, cells))
                held += sum(len(x or "") for x in cells) + 100
                if held > BATCH:
                    yield self._batch(book, part.sheet, rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(book, part.sheet, rows)

    @staticmethod
    def _batch(book, sheet, rows):
        n = len(rows)
        columns = [pa.array([book] * n, pa.string()), pa.array([sheet] * n, pa.string()), pa.array([r for r, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["book", "sheet", "row", "cells"])


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("sheets", json).load(path)``"""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WorkbookReader(self.options)

    def writer(self, schema, overwrite):
        return WorkbookWriter(self.options, overwrite)


def read_workbooks(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """SRC8: (book, sheet, row, cells) of the workbooks under a folder, of named sheets only if
    they are named: then no file is opened to plan. Rows and cells that a file leaves out are
    left out, or null before the row's last cell; a file without the sheet gives no rows."""
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook")
    return (reader if sheets is None else reader.option("sheets", json.dumps(sheets))).load(path)


def save_workbooks(rows: DataFrame, path: str, mode: str = "append", order: list[str] | None = None, looks: dict[str, Look] | None = None) -> None:
    """SNK8, SNK10: a file for each book of ``rows`` (book, sheet, row, cells), its sheets in
    ``order``, then the others by name. What is read back is what was written, except for nulls
    at the end of a row. A null book or sheet, a null or negative row number, two rows of one
    number or a name that no sheet can have fail the write, and nothing is left of it; so does a
    book that is there already, unless the mode is ``overwrite``. A sheet of more than 2^20 rows
    goes on in further files of its book, which other tasks write."""
    spark = rows.sparkSession
    spark.dataSource.register(WorkbookSource)
    must = lambda ok, c: F.when(ok, c).otherwise(F.raise_error(F.lit("a workbook's rows need a book, a sheet and a number from 0")))
    row = must(F.col("book").isNotNull() & F.col("sheet").isNotNull() & (F.coalesce("row", F.lit(-1)) >= 0), F.col("row").cast("long"))
    file = file_name(F.col("book"), (F.floor(F.col("row") / ROWS) + 1).cast("int"))
    named = rows.select(file.alias("book"), "sheet", (row % ROWS).alias("row"), F.col("cells").cast("array<string>").alias("cells"))
    out = named.repartition("book").sortWithinPartitions("book", "sheet", "row").write.format("workbook").mode(mode)
    out.option("order", json.dumps(order or [])).option("looks", json.dumps({n: vars(x) for n, x in (looks or {}).items()})).save(path)
