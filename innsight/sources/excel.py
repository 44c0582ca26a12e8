"""Excel workbooks through the standard library: a .xlsx file is a zip of XML. Sheets are of bounded size by their format, so they are the driver's."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_575  # of a sheet, beside its header
# fixed values
SHEETS = {
    "Basic Info": ["id", "name", "address", "city", "country", "stars", "price_range", "last_updated"], "Contact Info": ["id", "name", "phone", "email", "website"],
    "Facilities": ["id", "name", "facilities", "stars", "price_range"], "Risk Analysis": ["id", "name", "risk_score", "risk_level"],
}
SIMPLE = ["id", "name", "address", "city", "country", "stars", "data_source"]


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    text = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def workbook(sheets: dict[str, tuple[list[str], Iterable[tuple]]]) -> bytes:
    """A workbook of sheets: name to header and rows."""
    head, out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, (header, rows) in zip(n, sheets.values()):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for k, row in enumerate((header, *rows), 1):
                    f.write((f'<row r="{k}">' + "".join(_cell(f"{_letters(j)}{k}", v) for j, v in enumerate(row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def export_excel(df: DataFrame, path: str, kind: str = "multi_sheet") -> None:
    """df as a workbook: simple (seven columns), detailed (all columns) or multi_sheet (basic, contact, facilities and, where known, risk). Too many rows for a sheet are an error, none is left out."""
    if kind == "simple":
        wanted = {"Hotels": SIMPLE}
    elif kind == "detailed":
        wanted = {"Hotels Detailed": df.columns}
    else:
        wanted = {s: cs for s, cs in SHEETS.items() if s != "Risk Analysis" or "risk_score" in df.columns}
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS} rows; export CSV instead")
    sheets = {s: (cs, [tuple(r) for r in df.select([c for c in cs if c in df.columns]).toLocalIterator()]) for s, cs in ((s, [c for c in cs if c in df.columns]) for s, cs in wanted.items())}
    with open(path, "wb") as f:
        f.write(workbook(sheets))


def rows_of(raw: bytes, sheet: int = 0) -> list[list]:
    """The cells of a sheet of a workbook, texts as such, numbers as floats; a gap is None."""
    ns = {"m": _MAIN}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_MAIN}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        book, rels = ElementTree.fromstring(z.read("xl/workbook.xml")), ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        rel = book.findall("m:sheets/m:sheet", ns)[sheet].get(f"{{{_REL}}}id")
        target = next(r.get("Target") for r in rels if r.get("Id") == rel)
        root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    out = []
    for row in root.iter(f"{{{_MAIN}}}row"):
        cells: dict[int, object] = {}
        for k, c in enumerate(row.findall("m:c", ns)):
            letters = re.match("[A-Z]+", c.get("r") or _letters(k))[0]
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            v, kind = c.find("m:v", ns), c.get("t")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t"))
            elif v is None or v.text is None:
                value = None
            else:
                value = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind in ("str", "e") else float(v.text)
            cells[at - 1] = value
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def read_excel(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """Sheets of the workbooks at a path, by Spark's own readers; each row's columns by the first workbook's header, texts all, as files differ in types."""
    files = spark.read.format("binaryFile").load(path).select("content")
    header = [str(h) if h is not None else f"column_{i}" for i, h in enumerate((rows_of(bytes(files.first()["content"]), sheet) or [[]])[0])]

    def parsed(batches):
        import pandas as pd

        for b in batches:
            for raw in b["content"]:
                rows = rows_of(bytes(raw), sheet)
                names = [str(h) for h in (rows or [[]])[0]]
                text = lambda v: None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
                yield pd.DataFrame([{h: text(r[names.index(h)]) if h in names and names.index(h) < len(r) else None for h in header} for r in rows[1:]], columns=header, dtype=object)

    return files.mapInPandas(parsed, ", ".join(f"`{h}` string" for h in header)) if header else spark.createDataFrame([], "empty string")
