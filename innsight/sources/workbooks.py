"""Workbooks as a Spark data source: spark.dataSource.register(Workbooks); spark.read.format("workbooks").load(path)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _open(path: str):
    """A file that can be read from any place, local or of a store that pyarrow knows."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def workbooks(path: str) -> list[str]:
    """The .xlsx files at a path: itself, or those in a folder and the folders in it, by name."""
    from pyarrow import fs

    uri = "://" in path
    store, name = fs.FileSystem.from_uri(path) if uri else (fs.LocalFileSystem(), path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(name, recursive=True))
    head = path[: len(path) - len(name)] if uri and path.endswith(name) else (path.split("://")[0] + "://" if uri else "")
    return sorted(head + f.path for f in found if f.is_file and f.path.lower().endswith(".xlsx") and not f.base_name.startswith("~$"))


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Names of a workbook's sheets, in order, and where they are inside it."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    entries = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return {e.get("name"): (t.lstrip("/") if t.startswith("/") else f"xl/{t}") for e in entries for t in [targets[e.get(_REL)]]}


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, one at a time: what is done is dropped."""
    with book.open(name) as f:
        root = None
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            root = e if root is None else root
            if event == "end" and e.tag == f"{_MAIN}{tag}":
                yield e
                root.clear()


def rows(book: zipfile.ZipFile, sheet: str) -> Iterator[list]:
    """The rows of a sheet (where it is), cells as text, float or bool; a gap is None."""
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
    shared = [text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
    for row in _elements(book, sheet, "row"):
        cells: dict[int, object] = {}
        for k, c in enumerate(row.iter(f"{_MAIN}c")):
            letters, at = re.match("[A-Z]*", c.get("r") or "")[0], 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            v, kind = c.find(f"{_MAIN}v"), c.get("t")
            if kind == "inlineStr":
                value = text(c)
            elif v is None or v.text is None:
                value = None
            else:
                value = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind in ("str", "e", "d") else float(v.text)
            cells[at - 1 if letters else k] = value
        yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def _header(row: list) -> list[str]:
    return [f"column_{i}" if h is None else str(int(h)) if isinstance(h, float) and h.is_integer() else str(h) for i, h in enumerate(row)]


def _as_text(v) -> str | None:
    return None if v is None else ("true" if v else "false") if isinstance(v, bool) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


class _Part(InputPartition):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet


class Workbooks(DataSource):
    """The rows of all sheets of all workbooks at a path, with their file and sheet. Options: sheet, the one to read of each workbook (default: all).

    A sheet's first row names its columns; the table has the columns of all, by name, in the order in which they are first met, null where a sheet lacks one, and of two columns of one name
    the first. A column is double or boolean if all its cells are, otherwise string; cells of a stated schema that don't fit are null. Each sheet is a partition, read row by row; the
    names of files and sheets are listed on the driver, and unless a schema is stated the files are read there once for it.
    """

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def _parts(self) -> list[_Part]:
        wanted = self.options.get("sheet")
        out = []
        for path in workbooks(self.options["path"]):
            with _open(path) as f, zipfile.ZipFile(f) as book:
                out += [_Part(path, s) for s in sheets(book) if wanted in (None, s)]
        return out

    def schema(self) -> StructType:
        kinds: dict[str, set] = {}
        for part in self._parts():
            with _open(part.path) as f, zipfile.ZipFile(f) as book:
                found = rows(book, sheets(book)[part.sheet])
                names = _header(next(found, []))
                for n in names:
                    kinds.setdefault(n, set())
                for r in found:
                    for n, v in zip(names, r):
                        if v is not None:
                            kinds[n].add(type(v))
        typed = lambda k: DoubleType() if k == {float} else BooleanType() if k == {bool} else StringType()
        return StructType([StructField("file", StringType()), StructField("sheet", StringType()), *(StructField(n, typed(k)) for n, k in kinds.items() if n not in ("file", "sheet"))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, schema)


class _Reader(DataSourceReader):
    def __init__(self, source: Workbooks, schema: StructType):
        self.parts, self.fields = source._parts(), [(f.name, f.dataType.typeName()) for f in schema.fields]

    def partitions(self) -> list[_Part]:
        return self.parts or [_Part("", "")]

    def read(self, part: _Part) -> Iterator[tuple]:
        if not part.path:
            return
        with _open(part.path) as f:
            data = io.BytesIO(f.read()) if not f.seekable() else f
            with zipfile.ZipFile(data) as book:
                found = rows(book, sheets(book)[part.sheet])
                names = _header(next(found, []))
                at = {n: names.index(n) for n in names}
                for r in found:
                    if any(v is not None for v in r):
                        yield tuple(part.path if n == "file" else part.sheet if n == "sheet" else self._value(r[at[n]] if n in at and at[n] < len(r) else None, kind) for n, kind in self.fields)

    @staticmethod
    def _value(v, kind: str):
        if kind == "string" or v is None:
            return _as_text(v)
        if kind == "boolean":
            return v if isinstance(v, bool) else None
        try:
            number = float(v)
        except ValueError:
            return None
        return number if kind in ("double", "float") else int(number) if number.is_integer() else None
