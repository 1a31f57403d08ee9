"""Small result tables as .xlsx workbooks, by the standard library alone."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows a sheet may have; a larger result belongs into Parquet or CSV.
MAX_ROWS = 1_000_000
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def _sheet(columns: list[str], rows: list[tuple]) -> str:
    def cell(r: int, c: int, v) -> str:
        at = f"{_column(c)}{r}"
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    wide = [min(50, max([len(str(n)), *(len(str(r[i])) for r in rows[:1000])]) + 2) for i, n in enumerate(columns)]
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(wide))
    body = "".join(f'<row r="{r + 1}">' + "".join(cell(r + 1, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([tuple(columns), *rows]))
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}">{pane}<cols>{cols}</cols><sheetData>{body}</sheetData></worksheet>'


def write_workbook(path: str, sheets: dict[str, DataFrame], max_rows: int = MAX_ROWS) -> None:
    """One sheet per result; names are cut to 31 characters and, where two then agree regardless of case, numbered. More than ``max_rows`` rows are an error."""
    parts, names = [], []
    for name, df in sheets.items():
        rows = [tuple(r) for r in df.limit(max_rows + 1).collect()]
        if len(rows) > max_rows:
            raise ValueError(f"{name} has more than {max_rows} rows; write it as a table")
        parts.append(_sheet(df.columns, rows))
        cut, k = name[:31], 2
        while cut.lower() in {n.lower() for n in names}:
            cut, k = f"{name[:31 - len(f' ({k})')]} ({k})", k + 1
        names.append(cut)
    n = range(1, len(parts) + 1)
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, p in zip(n, parts):
            z.writestr(f"xl/worksheets/sheet{i}.xml", p)


def sheet_names(path: str) -> dict[str, str]:
    """The sheets in order, and where each lies in the file."""
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(path) as z:
        at = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        return {s.get("name"): f"xl/{at[s.get(rel)]}".replace("xl//", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)}


def read_sheet(path: str, sheet: int | str = 1) -> list[list[str | None]]:
    """All cells of a sheet, by its number from 1 or its name, as text; a driver-side read for label sheets.

    A name the workbook does not have is an error.
    """
    have = sheet_names(path)
    if isinstance(sheet, int):
        sheet = list(have)[sheet - 1]
    elif sheet not in have:
        raise KeyError(f"no sheet {sheet}; there are {', '.join(have)}")
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        root = ElementTree.fromstring(z.read(have[sheet]))
    rows = []
    for row in root.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", _NS):
            letters = re.match(r"[A-Z]+", c.get("r", "A")).group()
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            v = c.find("m:v", _NS)
            if c.get("t") == "inlineStr":
                cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is not None:
                cells[at - 1] = shared[int(v.text)] if c.get("t") == "s" else v.text
        rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    width = max((len(r) for r in rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]
