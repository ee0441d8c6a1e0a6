"""Spreadsheets: list workbooks as rows, and a template writer.

Files are read by Spark's binaryFile source, so any store that Spark reads will do; each workbook is parsed in the
task that holds its bytes. The sheet named like "lista" is taken, else the first; cells may be shared or
inline strings, booleans or numbers; references may be sparse; blank rows are dropped. A file that isn't a
workbook, is damaged or encrypted, or whose parts are larger than ``MOST`` bytes gives no rows; only the parts that
are needed are unpacked, and never more of them than that.
"""

from __future__ import annotations

import io
import lzma
import re
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROW, CELL, VALUE, TEXT = (f"{MAIN}{tag}" for tag in ("row", "c", "v", "t"))
#: Bytes of a part that are unpacked at most.
MOST = 64 << 20
#: Of the compression: a sheet's tags repeat, so the least one is enough.
LEVEL = 1
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: Field of a header by its normalized text.
HEADERS = {
    "nome do item": "name", "nome": "name", "item": "name", "produto": "name", "descricao": "name", "marca": "brand", "categoria": "category", "setor": "category", "embalagem": "pack",
    "unidade": "unit", "quantidade": "quantity", "qtd": "quantity", "qtde": "quantity", "mercado preferido": "market", "mercado": "market", "codigo ean": "code", "codigo": "code", "ean": "code",
}
FIELDS = ["name", "brand", "category", "pack", "unit", "quantity", "market", "code"]
TEMPLATE = ["Nome do item", "Marca", "Categoria", "Embalagem", "Unidade", "Quantidade", "Mercado preferido", "Código/EAN"]


def plain(text: str) -> str:
    base = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", base).strip()


def column_name(n: int) -> str:
    """The letters of the n-th column, from 1."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


@lru_cache(4096)
def column_number(ref: str) -> int:
    """The column of a reference, or of its letters alone."""
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n


def _part(book: zipfile.ZipFile, name: str) -> bytes:
    """A member's bytes; what the directory says of its size isn't trusted."""
    with book.open(name) as member:
        found = member.read(MOST + 1)
    if len(found) > MOST:
        raise ValueError(f"{name} has more than {MOST} bytes")
    return found


def read_rows(data: bytes) -> list[list[str]]:
    """Dense rows of the list's sheet; none if the bytes aren't a workbook."""
    shared = []
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        sheets = ElementTree.fromstring(_part(book, "xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(_part(book, "xl/_rels/workbook.xml.rels"))}
        sheet = next((s for s in sheets if "lista" in plain(s.get("name") or "")), sheets[0])
        tree = ElementTree.fromstring(_part(book, "xl/" + targets[sheet.get(f"{OFFICE}id")].lstrip("/").removeprefix("xl/")))
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(TEXT)) for si in ElementTree.fromstring(_part(book, "xl/sharedStrings.xml"))]
    except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, KeyError, IndexError, ElementTree.ParseError, AttributeError, RuntimeError, ValueError, EOFError, OSError, struct.error):
        return []
    out = []
    for row in tree.iter(ROW):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.findall(CELL), 1):
            kind = c.get("t")
            value = "" if kind == "inlineStr" else c.findtext(VALUE) or ""
            if kind == "s":
                value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
            elif kind == "inlineStr":
                value = (c[0][0].text or "") if len(c) == 1 and len(c[0]) == 1 and c[0][0].tag == TEXT else "".join(t.text or "" for t in c.iter(TEXT))
            elif kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            cells[column_number((c.get("r") or "").rstrip("0123456789")) or k] = value.strip()
        if any(cells.values()):
            out.append([cells.get(i, "") for i in range(1, max(cells) + 1)])
    return out


def list_rows(data: bytes) -> list[dict[str, str]]:
    """The list's entries by field; rows without a name are dropped."""
    rows = read_rows(data)
    if not rows:
        return []
    fields = [HEADERS.get(plain(h)) for h in rows[0]]
    entries = [{f: v for f, v in zip(fields, r, strict=False) if f} for r in rows[1:]]
    return [e for e in entries if e.get("name")]


def write_rows(rows: list[list[str]], sheet: str = "Lista") -> bytes:
    """A workbook of one sheet with inline strings."""
    names = [column_name(k) for k in range(1, max(map(len, rows), default=0) + 1)]
    cells = lambda i, r: "".join([f'<c r="{n}{i}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for n, v in zip(names, r, strict=False)])
    body = "".join(f'<row r="{i}">{cells(i, r)}</row>' for i, r in enumerate(rows, 1))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    package, office = "http://schemas.openxmlformats.org/package/2006", OFFICE.strip("{}")
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN.strip("{}")}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN.strip("{}")}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL) as z:
        for name, text in files.items():
            z.writestr(name, head + text)
    return out.getvalue()


SCHEMA = "path string, row long, " + ", ".join(f"{f} string" for f in FIELDS)


def parse_lists(files: DataFrame) -> DataFrame:
    """Entries of workbooks in rows of path and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(p, i, *(e.get(f) for f in FIELDS)) for p, c in zip(batch["path"], batch["content"], strict=True) for i, e in enumerate(list_rows(bytes(c)), 1)]
            yield pd.DataFrame(out, columns=["path", "row", *FIELDS])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the workbooks under a path."""
    return parse_lists(spark.read.format("binaryFile").load(path))


def checksum(files: DataFrame) -> DataFrame:
    """CRC-32 of each file's bytes, as archives have it."""
    return files.select("path", F.crc32("content").alias("crc32"))
